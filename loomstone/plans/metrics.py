"""Metrics over documents, scored tokens and result pairs."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.functions import formulas as M
from loomstone.functions.text import words
from loomstone.operators import text_metrics as T
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()

_W = r"w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents)"
_G = "g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS g FROM w WHERE len(w) >= {n})"
_H = f"{_W}, t AS (SELECT doc_id, unnest(w) AS x FROM w), c AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY ALL), h AS (SELECT doc_id, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h, sum(c) AS n FROM c GROUP BY doc_id)"


def _words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", words(F.col("text")).alias("w"))


@plans.add("language_token_entropy", f"WITH {_H} SELECT lang, count(*) AS n_docs, round(avg(coalesce(h, 0)), 6) AS mean_entropy, coalesce(sum(n), 0)::BIGINT AS n_tokens FROM w LEFT JOIN h USING (doc_id) GROUP BY lang ORDER BY lang")
def language_token_entropy(spark, sf):
    """Mean word entropy per language over all documents, empty ones too."""
    rows = _words(spark, sf).select("lang", T.unigram_entropy(F.col("w")).alias("h"), F.size("w").cast("long").alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg("h"), 6).alias("mean_entropy"), F.sum("n").alias("n_tokens")).orderBy("lang")


@plans.add("document_entropy", f"WITH {_H} SELECT doc_id, round(coalesce(h, 0), 6) AS entropy FROM w LEFT JOIN h USING (doc_id)")
def document_entropy(spark, sf):
    return _words(spark, sf).select("doc_id", F.round(T.unigram_entropy(F.col("w")), 6).alias("entropy"))


for _n in (2, 3, 4):

    def _rep(spark, sf, n=_n):
        return T.repetition(_words(spark, sf), F.col("w"), n, ["lang"]).withColumn(f"rep_{n}", F.round(f"rep_{n}", 6))

    def _dist(spark, sf, n=_n):
        return T.distinctness(_words(spark, sf), F.col("w"), n, ["lang"]).withColumn(f"distinct_{n}", F.round(f"distinct_{n}", 6))

    plans.add(f"repetition_{_n}", f"WITH {_W}, {_G.format(n=_n)}, c AS (SELECT lang, doc_id, g, count(*) AS c FROM g GROUP BY ALL) SELECT lang, round(100.0 * sum(c - 1) / greatest(sum(c), 1), 6) AS rep_{_n} FROM c GROUP BY lang")(_rep)
    plans.add(f"distinct_{_n}", f"WITH {_W}, {_G.format(n=_n)} SELECT lang, round(100.0 * count(DISTINCT g) / greatest(count(*), 1), 6) AS distinct_{_n} FROM g GROUP BY lang")(_dist)


@plans.add("diversity", "WITH " + _W + "".join(f", {_G.format(n=n).replace('g AS', f'g{n} AS', 1)}, r{n} AS (SELECT coalesce(100.0 * (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM g{n} GROUP BY doc_id, g)) / greatest((SELECT count(*) FROM g{n}), 1), 0) AS r)" for n in (2, 3, 4)) + " SELECT round((1 - r2.r / 100) * (1 - r3.r / 100) * (1 - r4.r / 100), 6) AS diversity FROM r2, r3, r4")
def diversity(spark, sf):
    """Product of what the three repetitions leave, over all documents in one pass."""
    rows = _words(spark, sf)
    sums = []
    for n in (2, 3, 4):
        g = T.ngrams(F.col("w"), n)
        rows = rows.withColumn(f"n{n}", T.ngram_count(F.col("w"), n)).withColumn(f"r{n}", F.col(f"n{n}") - F.size(F.array_distinct(g)))
        sums += [F.sum(f"n{n}").alias(f"n{n}"), F.sum(f"r{n}").alias(f"r{n}")]
    left = [1 - F.col(f"r{n}") / F.greatest(F.col(f"n{n}"), F.lit(1)) for n in (2, 3, 4)]
    return rows.agg(*sums).select(F.round(left[0] * left[1] * left[2], 6).alias("diversity"))


_IDS = "ids AS (SELECT doc_id, lang, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM documents)"


@plans.add("token_id_entropy", f"WITH {_IDS}, t AS (SELECT doc_id, unnest(ids) AS x FROM ids), c AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY ALL), h AS (SELECT doc_id, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c GROUP BY doc_id) SELECT lang, round(avg(h), 6) AS mean_entropy FROM ids JOIN h USING (doc_id) GROUP BY lang")
def token_id_entropy(spark, sf):
    ids = table(spark, sf, "documents").select("lang", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids"))
    return ids.groupBy("lang").agg(F.round(F.avg(T.unigram_entropy(F.col("ids"))), 6).alias("mean_entropy"))


# Scored tokens: positions of line items within orders stand for tokens, quantities for log-likelihoods.
_NLL = "s AS (SELECT l_orderkey AS text_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_quantity / 10 AS nll, l_linenumber * 4 AS char_start, l_orderkey % 17 AS prompt_chars, l_returnflag AS grp FROM lineitem)"


def _scored(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("text_id"), (F.row_number().over(w) - 1).alias("pos"), (F.col("l_quantity") / 10).alias("nll"), (F.col("l_linenumber") * 4).alias("char_start"), (F.col("l_orderkey") % 17).alias("prompt_chars"), F.col("l_returnflag").alias("grp"))


@plans.add("perplexity", f"WITH {_NLL} SELECT grp, count(*) AS n, round(sum(nll) / (count(*) * ln(2)), 6) AS bits_per_token, round(exp(sum(nll) / count(*)), 6) AS perplexity FROM s WHERE pos > 0 GROUP BY grp")
def perplexity(spark, sf):
    """Ratios of sums over all scored tokens; the first token of a text is never scored."""
    s = T.perplexity(_scored(spark, sf).where("pos > 0"), "nll", ["grp"])
    return s.select("grp", "n", F.round("bits_per_token", 6).alias("bits_per_token"), F.round("perplexity", 6).alias("perplexity"))


@plans.add("completion_perplexity", f"WITH {_NLL} SELECT grp, count(x) AS n, CASE WHEN count(x) > 0 THEN round(sum(x) / (count(x) * ln(2)), 6) ELSE 'inf'::DOUBLE END AS bits_per_token, CASE WHEN count(x) > 0 THEN round(exp(sum(x) / count(x)), 6) ELSE 'inf'::DOUBLE END AS perplexity FROM (SELECT grp, CASE WHEN pos > 0 AND char_start >= prompt_chars THEN nll END AS x FROM s) GROUP BY grp")
def completion_perplexity(spark, sf):
    """Only tokens that begin at or after the prompt's end count."""
    s = _scored(spark, sf).withColumn("x", F.when((F.col("pos") > 0) & (F.col("char_start") >= F.col("prompt_chars")), F.col("nll")))
    return T.perplexity(s, "x", ["grp"]).select("grp", "n", F.round("bits_per_token", 6).alias("bits_per_token"), F.round("perplexity", 6).alias("perplexity"))


@plans.add("scoring_windows", r"""
WITH l AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents), k AS (SELECT doc_id, n, unnest(range(0, 1 + ceil(greatest(n - 256, 0) / 128)::BIGINT)) AS step FROM l WHERE n >= 2)
SELECT doc_id, step::BIGINT AS step, greatest(0, least(n, 256 + step * 128) - 256)::BIGINT AS begin_, CASE WHEN step = 0 THEN 1 ELSE least(n, 256 + (step - 1) * 128) END::BIGINT AS first_, least(n, 256 + step * 128)::BIGINT AS end_ FROM k""")
def scoring_windows(spark, sf):
    """Windows of 256 with a stride of 128 in which every token but the first is scored once."""
    n = table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    w = T.scoring_windows(n, "n", 256, 128)
    return w.select("doc_id", *[F.col(a).cast("long").alias(b) for a, b in (("step", "step"), ("begin", "begin_"), ("first", "first_"), ("end", "end_"))])


@plans.add("bits_per_token", "SELECT l_linestatus AS split, round(sum(l_quantity) / ln(2) / sum(l_linenumber), 6) AS bits FROM lineitem GROUP BY 1")
def bits_per_token(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("split")).agg(F.round(F.sum("l_quantity") / math.log(2) / F.sum("l_linenumber"), 6).alias("bits"))


@plans.add("mean_of_batch_means", "SELECT round(avg(m), 6) AS mean_loss FROM (SELECT event_id // 64 AS b, avg(value) AS m FROM events GROUP BY 1)")
def mean_of_batch_means(spark, sf):
    b = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 64).alias("b")).agg(F.avg("value").alias("m"))
    return b.agg(F.round(F.avg("m"), 6).alias("mean_loss"))


@plans.add("bound_bits_per_dimension", "SELECT event_type, count(*) AS n, round((avg(value / 10) + avg(value / 20) + avg(m)) / (ln(2) * 128), 6) AS bits FROM (SELECT event_type, value, value * value / (1 + value) / 4 * 1.5 AS m FROM events) GROUP BY 1")
def bound_bits_per_dimension(spark, sf):
    """Prior, reconstruction and importance-weighted diffusion terms, in bits per dimension."""
    v = F.col("value")
    e = table(spark, sf, "events").select("event_type", (v / 10).alias("prior"), (v / 20).alias("recon"), (v * v / (1 + v) / 4 * 1.5).alias("diff"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round((F.avg("prior") + F.avg("recon") + F.avg("diff")) / (math.log(2) * 128), 6).alias("bits"))


@plans.add("endpoint_divergence", """
WITH t AS (SELECT event_id, value / 50 AS s FROM events), p AS (SELECT event_id, exp(-s) AS k, (1 - exp(-s)) / 100 AS o FROM t)
SELECT event_id, round(k * ln(99), 6) AS absorbing, round((k + o) * ln((k + o) * 100) + 99 * o * ln(o * 100), 6) AS uniform, round(k + o, 6) AS stay FROM p""")
def endpoint_divergence(spark, sf):
    s = F.col("value") / 50
    return table(spark, sf, "events").select("event_id", F.round(M.endpoint_divergence(s, 100, True), 6).alias("absorbing"), F.round(M.endpoint_divergence(s, 100, False), 6).alias("uniform"), F.round(M.uniform_transition(s, 100)["stay"], 6).alias("stay"))


@plans.add("quantile_report", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (0, 1, 5, 50, 95, 99, 100)) + " FROM events GROUP BY 1")
def quantile_report(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p / 100)), 6).alias(f"p{p}") for p in (0, 1, 5, 50, 95, 99, 100)])


@plans.add("length_statistics", "SELECT lang, count(*) AS n, min(n_chars + 1) AS least, max(n_chars + 1) AS most, round(avg(n_chars + 1), 6) AS mean, round(stddev_pop(n_chars + 1), 6) AS spread, " + ", ".join(f"round(quantile_cont(n_chars + 1, {p / 100}), 6) AS p{str(p).replace('.', '_')}" for p in (50, 90, 95, 99, 99.9)) + " FROM documents GROUP BY lang")
def length_statistics(spark, sf):
    """Encoded lengths with their end mark."""
    s = T.length_statistics(table(spark, sf, "documents").select("lang", (F.col("n_chars") + 1).alias("n")), "n", ["lang"])
    return s.select("lang", "n", "least", "most", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "p50", "p90", "p95", "p99", "p99_9")])


@plans.add("whole_length_percentiles", "SELECT source, " + ", ".join(f"floor(round(quantile_cont(n_chars, {p / 100}), 6))::BIGINT AS p{str(p).replace('.', '_')}" for p in (50, 90, 95, 99, 99.9)) + " FROM documents GROUP BY source")
def whole_length_percentiles(spark, sf):
    return T.length_statistics(table(spark, sf, "documents"), "n_chars", ["source"], whole=True).select("source", "p50", "p90", "p95", "p99", "p99_9")


@plans.add("vocabulary_sweep", """
WITH l AS (SELECT bits, avg(n_chars / (bits - 10)) AS mean, max(n_chars / (bits - 10)) AS most, avg(n_chars) AS base FROM documents, (SELECT unnest([16, 17, 18, 19, 20]) AS bits) GROUP BY bits)
SELECT bits, round(base / mean, 6) AS compression, round(1024 / most, 6) AS safe_ratio, round((base / mean) * (base / mean), 6) AS attention_reduction, base / mean >= 8 AS passes FROM l""")
def vocabulary_sweep(spark, sf):
    """Derived ratios of a sweep over vocabulary sizes."""
    bits = F.explode(F.array(*[F.lit(b) for b in range(16, 21)])).alias("bits")
    rows = table(spark, sf, "documents").select("n_chars", bits).withColumn("x", F.col("n_chars") / (F.col("bits") - 10))
    s = rows.groupBy("bits").agg(F.avg("x").alias("mean"), F.max("x").alias("most"), F.avg("n_chars").alias("base"))
    r = F.col("base") / F.col("mean")
    return s.select("bits", F.round(r, 6).alias("compression"), F.round(1024 / F.col("most"), 6).alias("safe_ratio"), F.round(r * r, 6).alias("attention_reduction"), (r >= 8).alias("passes"))


@plans.add("length_histogram", "WITH b AS (SELECT min(n_chars) AS a, max(n_chars) AS z FROM documents) SELECT least(floor((n_chars - a) * 50 / (z - a)), 49)::BIGINT AS bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents) / ((any_value(z) - any_value(a)) / 50), 12) AS density FROM documents, b GROUP BY 1")
def length_histogram(spark, sf):
    d = table(spark, sf, "documents").select("n_chars")
    b = F.broadcast(d.agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("z"), F.count("*").alias("m")))  # one row
    rows = d.crossJoin(b).withColumn("bin", F.least(F.floor((F.col("n_chars") - F.col("a")) * 50 / (F.col("z") - F.col("a"))), F.lit(49)))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.first("m").alias("m"), F.first(F.col("z") - F.col("a")).alias("s")).select("bin", "n", F.round(F.col("n") / F.col("m") / (F.col("s") / 50), 12).alias("density"))


@plans.add("characters_per_example", "SELECT lang, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY lang")
def characters_per_example(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@plans.add("population_statistics", "SELECT event_type, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS spread FROM (SELECT event_type, value / (SELECT max(value) FROM events) AS x FROM events) GROUP BY 1")
def population_statistics(spark, sf):
    """Mean and population spread after scaling by the largest value, where that exceeds one."""
    e = table(spark, sf, "events")
    top = F.broadcast(e.agg(F.max("value").alias("top")))  # one row
    x = F.col("value") / F.greatest(F.col("top"), F.lit(1.0))
    return e.crossJoin(top).groupBy("event_type").agg(F.round(F.avg(x), 8).alias("mean"), F.round(F.stddev_pop(x), 8).alias("spread"))


@plans.add("throughput", "SELECT round(sum(n) / max(t), 6) AS rate, sum(n)::BIGINT AS total, round(max(t), 6) AS wall FROM (SELECT user_id % 8 AS r, count(*) AS n, sum(value) AS t FROM events GROUP BY 1)")
def throughput(spark, sf):
    """All work over the longest rank's time."""
    r = table(spark, sf, "events").groupBy(F.pmod("user_id", F.lit(8)).alias("r")).agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    return r.agg(F.round(F.sum("n") / F.max("t"), 6).alias("rate"), F.sum("n").alias("total"), F.round(F.max("t"), 6).alias("wall"))


_WER = """p AS (SELECT a.conv_id, a.turn, a.role, list_filter(regexp_split_to_array(lower(coalesce(a.text, '')), '\\s+'), lambda w: w <> '') AS r, list_filter(regexp_split_to_array(lower(coalesce(b.text, '')), '\\s+'), lambda w: w <> '') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@plans.add("word_error_rate", f"""
WITH RECURSIVE {_WER}, q AS (SELECT role, r, h, row_number() OVER () AS i FROM p), d AS (SELECT i, role, r, h, 0 AS k, list_transform(range(0, len(h) + 1), lambda j: j::BIGINT) AS row_ FROM q
UNION ALL SELECT i, role, r, h, k + 1, list_reduce(range(1, len(h) + 1), lambda acc, j: list_append(acc, least(acc[-1] + 1, row_[(j + 1)::INT] + 1, row_[j::INT] + (h[j::INT] <> r[k + 1])::BIGINT)), [(k + 1)::BIGINT]) FROM d WHERE k < len(r))
SELECT role, sum(row_[-1])::BIGINT AS edits, sum(len(r))::BIGINT AS words, CASE WHEN sum(len(r)) > 0 THEN round(sum(row_[-1]) / sum(len(r)), 6) END AS wer FROM d WHERE k = len(r) GROUP BY role""")
def word_error_rate(spark, sf):
    """The next turn read as a transcript of this one, corpus-level per role."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    pairs = c.select("conv_id", "turn", "role", F.col("text").alias("ref")).join(nxt, ["conv_id", "turn"])
    return T.word_error_rate(pairs, "ref", "hyp", ["role"]).select("role", "edits", "words", F.round("wer", 6).alias("wer"))


@plans.add("mean_opinion_score", "SELECT event_type, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 6) AS score, count(*) AS n FROM events GROUP BY 1")
def mean_opinion_score(spark, sf):
    """Mean over the samples that could be scored; null where none could."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("event_id") % 4 != 0, F.col("value"))), 6).alias("score"), F.count("*").alias("n"))


@plans.add("bit_error_rates")
def bit_error_rates(spark, sf):
    """Closed-form error rate beside the measured one, by noise level."""
    s = table(spark, sf, "events").select(F.round(0.1 + F.col("value") / 250, 1).alias("sigma"), (F.col("value") % 1 < 0.5).cast("double").alias("wrong"))
    return s.groupBy("sigma").agg(F.avg("wrong").alias("measured")).select("sigma", "measured", M.bit_error_rate(F.col("sigma")).alias("expected"))


@plans.add("masked_errors", "SELECT l_orderkey, round(sum(l_tax * l_tax * m) / greatest(sum(m), 1), 9) AS error FROM (SELECT *, (l_linenumber % 2)::DOUBLE AS m FROM lineitem) GROUP BY 1")
def masked_errors(spark, sf):
    """Mean squared error of an example over the places its mask counts, from arrays."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_tax"))).alias("x"))
    e, m = F.transform("x", lambda r: r["l_tax"] * r["l_tax"]), F.transform("x", lambda r: (r["l_linenumber"] % 2).cast("double"))
    return a.select("l_orderkey", F.round(M.masked_mean(e, m), 9).alias("error"))


@plans.add("entropy_integral", """
WITH b AS (SELECT floor(value / 25)::BIGINT AS t, avg(value) / ln(2) AS rate FROM events GROUP BY 1),
p AS (SELECT t, rate, coalesce((lead(rate) OVER (ORDER BY t) + rate) / 2 * (lead(t) OVER (ORDER BY t) - t), 0) AS part FROM b)
SELECT t, round(rate, 6) AS rate, round(3.0 - sum(part) OVER (ORDER BY t DESC), 5) AS entropy FROM p""")
def entropy_integral(spark, sf):
    """Rate per time in bits, integrated from the known right end by trapezoids."""
    b = table(spark, sf, "events").groupBy(F.floor(F.col("value") / 25).alias("t")).agg((F.avg("value") / math.log(2)).alias("rate"))
    up = W.orderBy("t")  # one row per time of a schedule
    p = b.withColumn("part", F.coalesce((F.lead("rate").over(up) + F.col("rate")) / 2 * (F.lead("t").over(up) - F.col("t")), F.lit(0.0)))
    return p.select("t", F.round("rate", 6).alias("rate"), F.round(3.0 - F.sum("part").over(W.orderBy(F.desc("t"))), 5).alias("entropy"))


@plans.add("weighted_correction_rates", "SELECT event_type, round(sum(value * n) / sum(n), 6) AS rate, sum(n)::BIGINT AS n_tokens FROM (SELECT event_type, value, (user_id % 16 + 1) * 128 AS n FROM events) GROUP BY 1")
def weighted_correction_rates(spark, sf):
    n = (F.pmod("user_id", F.lit(16)) + 1) * 128
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * n) / F.sum(n), 6).alias("rate"), F.sum(n).alias("n_tokens"))


@plans.add("logit_memory", """
WITH w AS (SELECT p_partkey, p_size::BIGINT AS b, (p_partkey % 8 + 1) * 128 AS t, p_partkey + 1 AS v, length(bin(p_partkey))::INT AS m FROM part)
SELECT p_partkey, b * t * v AS token_logits, b * t * m AS bit_logits, round(b * t * v * 2 / 1073741824.0, 6) AS token_gib, round(b * t * m * 2 / 1048576.0, 6) AS bit_mib, round(v / m, 6) AS reduction FROM w""")
def logit_memory(spark, sf):
    """Logits per step and their memory at two bytes, for token and bit outputs, of a table of settings."""
    from loomstone.functions.codecs import bits_for

    c = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("b"), ((F.col("p_partkey") % 8 + 1) * 128).alias("t"), (F.col("p_partkey") + 1).alias("v")).withColumn("m", bits_for(F.col("v")))
    n = F.col("b") * F.col("t")
    return c.select("p_partkey", (n * F.col("v")).alias("token_logits"), (n * F.col("m")).alias("bit_logits"), F.round(n * F.col("v") * 2 / 1073741824.0, 6).alias("token_gib"), F.round(n * F.col("m") * 2 / 1048576.0, 6).alias("bit_mib"), F.round(F.col("v") / F.col("m"), 6).alias("reduction"))


@plans.add("log_binned_means", """
WITH e AS (SELECT greatest(0.002, least(80, value + 1e-3)) AS s, user_id % 97 AS m FROM events), b AS (SELECT unnest(range(0, 8)) AS bin),
x AS (SELECT b.bin, e.s, e.m FROM b LEFT JOIN e ON e.s >= exp(ln(0.002) + bin * (ln(80) - ln(0.002)) / 8) * (1 - 1e-12) AND (e.s < exp(ln(0.002) + (bin + 1) * (ln(80) - ln(0.002)) / 8) * (1 - 1e-12) OR bin = 7))
SELECT bin::INT AS bin, count(s) AS n, round(avg(m), 6) AS mean, round(avg(m / (s * s)), 6) AS ratio, count(s) = 0 AS none FROM x GROUP BY bin""")
def log_binned_means(spark, sf):
    """Means per logarithmic bin, closed below (the last on both sides), empty bins too."""
    low, high, k = math.log(0.002), math.log(80), 8
    s = F.greatest(F.lit(0.002), F.least(F.lit(80.0), F.col("value") + 1e-3))
    e = table(spark, sf, "events").select(s.alias("s"), (F.col("user_id") % 97).alias("m"))
    e = e.withColumn("bin", F.greatest(F.lit(0), F.least(F.floor((F.log("s") - low) * k / (high - low) + 1e-12), F.lit(k - 1))).cast("int"))
    agg = e.groupBy("bin").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.avg(F.col("m") / (F.col("s") * F.col("s"))).alias("ratio"))
    spine = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    return spine.join(agg, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("mean"), F.round("ratio", 6).alias("ratio"), F.col("n").isNull().alias("none"))


@plans.add("binary_losses", """
WITH e AS (SELECT user_id, value / 60 - 4 AS x, (event_id % 2)::DOUBLE AS y FROM events)
SELECT user_id, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 9) AS cross_entropy, round(avg(pow(1 / (1 + exp(-x)) - y, 2)), 9) AS squared, round(avg(pow(1 / (1 + exp(-x)) - y, 2) / ln(2)), 9) AS squared_bits FROM e GROUP BY 1""")
def binary_losses(spark, sf):
    """Cross entropy of logits and squared error of their probabilities, averaged."""
    x, y = F.col("value") / 60 - 4, (F.col("event_id") % 2).cast("double")
    s = M.squared_error(M.sigmoid(x), y)
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg(M.binary_cross_entropy(x, y)), 9).alias("cross_entropy"), F.round(F.avg(s), 9).alias("squared"), F.round(F.avg(s / math.log(2)), 9).alias("squared_bits"))


@plans.add("top_probabilities", """
WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_quantity / 10 / 0.7 AS x, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem),
m AS (SELECT *, CASE WHEN r <= 3 THEN x ELSE -1e10 END AS z FROM o)
SELECT l_orderkey, round(max(z) + ln(sum(exp(z - t))), 9) AS log_total, round(max(exp(z - t)) / sum(exp(z - t)), 9) AS largest, sum((z > -1e9)::BIGINT)::BIGINT AS n_kept FROM (SELECT *, max(z) OVER (PARTITION BY l_orderkey) AS t FROM m) GROUP BY 1""")
def top_probabilities(spark, sf):
    """Scores at a temperature, those below the third largest masked, and their probabilities, from arrays."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") / 10 / 0.7).alias("x"))
    a = a.select("l_orderkey", M.keep_top(F.col("x"), 3).alias("z")).select("l_orderkey", "z", M.softmax(F.col("z")).alias("p"))
    return a.select("l_orderkey", F.round(M.log_sum_exp(F.col("z")), 9).alias("log_total"), F.round(F.array_max("p"), 9).alias("largest"), F.size(F.filter("z", lambda v: v > -1e9)).cast("long").alias("n_kept"))


@plans.add("sketched_distinct_2")
def sketched_distinct_2(spark, sf):
    """Distinct pairs of words of each language, estimated from sketches that were stored source by source."""
    from loomstone.functions.text import words
    from loomstone.operators import sketches
    from loomstone.session import scratch

    path = scratch(spark, "sketches")
    docs = table(spark, sf, "documents")
    made = sketches.ngram_sketches(docs.select("lang", "source", words(F.col("text")).alias("w")), F.col("w"), 2, ["lang", "source"])
    sketches.add_sketches(made, path)
    return sketches.distinctness_of_sketches(spark.read.parquet(path), 2, ["lang"])
