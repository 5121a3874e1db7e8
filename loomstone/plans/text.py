"""Text cleaning, splitting and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.functions.codecs import fit
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()


def _sql_rewrite(x: str, rules) -> str:
    for kind, old, new in rules:
        old, new = old.replace("'", "''"), new.replace("'", "''")
        x = f"replace({x}, '{old}', '{new}')" if kind == "s" else f"regexp_replace({x}, '{old}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return x


_STRIP = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@plans.add("detokenised_text", f"""
SELECT doc_id, md5({_STRIP.format(_sql_rewrite(_STRIP.format("replace(replace(coalesce(text, ''), ',', ' ,'), '.', ' .')"), X.DETOKENISE))}) AS digest,
  length({_STRIP.format(_sql_rewrite(_STRIP.format("replace(replace(coalesce(text, ''), ',', ' ,'), '.', ' .')"), X.DETOKENISE))})::BIGINT AS n FROM documents""")  # fmt: skip
def detokenised_text(spark, sf):
    """Texts with spaced punctuation, put back together by the ordered rewrites."""
    spaced = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(","), F.lit(" ,")), F.lit("."), F.lit(" ."))
    return table(spark, sf, "documents").select("doc_id", X.detokenise(spaced).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@plans.add("cleaned_text", f"""
SELECT doc_id, md5({_STRIP.format("replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")}) AS newlines,
  md5({_STRIP.format(_sql_rewrite("replace(text, '-', ' @-@ ')", X.ARTEFACTS))}) AS artefacts,
  md5(regexp_replace(lower(replace(text, '_', ' ')), '[^a-z ]', ' ', 'g')) AS letters, md5(regexp_replace(text, '[^A-Za-z0-9_.=-]+', '_', 'g')) AS sanitised,
  translate(source || '/' || lang || '-x:y', '/-:', '___') AS safe,
  len(regexp_extract_all(lower(coalesce(text, '')), '\\S+'))::BIGINT AS n_words FROM documents""".replace("\\\\S", "\\S"))  # fmt: skip
def cleaned_text(spark, sf):
    """Line ends, artefacts, the letters-only form, sanitised names and word counts."""
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.normalise_newlines(F.col("text"))).alias("newlines"), F.md5(X.clean_artefacts(F.replace("text", F.lit("-"), F.lit(" @-@ ")))).alias("artefacts"),
        F.md5(X.letters_only(F.col("text"))).alias("letters"), F.md5(X.sanitise(F.col("text"))).alias("sanitised"),
        X.safe_name(F.concat("source", F.lit("/"), "lang", F.lit("-x:y"))).alias("safe"), F.size(X.words(F.col("text"))).cast("long").alias("n_words"),
    )


@plans.add("character_codes", """
WITH c AS (SELECT item_id, list_transform(string_split(lower(text), ''), lambda c: greatest(instr('_abcdefghijklmnopqrstuvwxyz', c) - 1, 0)) AS ids FROM benchmark)
SELECT item_id, array_to_string(ids, ',') AS ids,
  replace(array_to_string(list_transform(ids, lambda i: substr('_abcdefghijklmnopqrstuvwxyz', (i + 1)::INT, 1)), ''), '_', ' ') AS decoded FROM c""")
def character_codes(spark, sf):
    """27-symbol ids of texts and the texts they decode to."""
    ids = table(spark, sf, "benchmark").select("item_id", X.character_ids(F.col("text")).alias("ids"))
    return ids.select("item_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), X.from_character_ids(F.col("ids")).alias("decoded"))


@plans.add("short_folders", """
WITH k AS (SELECT url AS key, regexp_replace(substr(regexp_replace(url, '[^A-Za-z0-9_.=-]+', '_', 'g'), 1, 64), '^[._-]+|[._-]+$', '', 'g') AS head FROM pages)
SELECT key, CASE WHEN head = '' THEN 'cache' ELSE head END || '__h=' || sha256(key) AS folder FROM k""")
def short_folders(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("key"), X.short_folder(F.col("url"), F.sha2("url", 256)).alias("folder"))


@plans.add("short_folders_blake2b")
def short_folders_blake2b(spark, sf):
    """The same with the 128-bit BLAKE2b hash, which SQL lacks."""
    return table(spark, sf, "pages").select(F.col("url").alias("key"), X.short_folder(F.col("url")).alias("folder"))


@plans.add("prompt_split", """
WITH t AS (SELECT conv_id, turn, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rest FROM conversations),
f AS (SELECT *, CASE WHEN turn % 3 = 0 THEN prompt || rest WHEN turn % 3 = 1 THEN 'x' || rest ELSE rest END AS whole, CASE WHEN turn % 3 = 2 THEN '' ELSE prompt END AS p FROM t WHERE rest IS NOT NULL)
SELECT conv_id, turn, CASE WHEN length(p) = 0 THEN whole WHEN starts_with(whole, p) THEN substr(whole, length(p) + 1) ELSE rest END AS suffix FROM f""")
def prompt_split(spark, sf):
    """What follows the prompt: cut off where the whole begins with it, else decoded apart."""
    from pyspark.sql import Window as W

    t = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("rest")).where("rest is not null")
    k = F.pmod("turn", F.lit(3))
    whole = F.when(k == 0, F.concat("prompt", "rest")).when(k == 1, F.concat(F.lit("x"), "rest")).otherwise(F.col("rest"))
    t = t.select("conv_id", "turn", whole.alias("whole"), F.when(k == 2, F.lit("")).otherwise(F.col("prompt")).alias("p"), "rest")
    return t.select("conv_id", "turn", X.split_prompt(F.col("whole"), F.col("p"), F.col("rest")).alias("suffix"))


@plans.add("prompt_split_by_words", r"""
SELECT doc_id, array_to_string(w[1:8], ' ') AS prompt, array_to_string(w[9:], ' ') AS suffix FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def prompt_split_by_words(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("w"))
    return d.select("doc_id", F.array_join(F.slice("w", 1, 8), " ").alias("prompt"), F.array_join(F.slice("w", F.lit(9), F.greatest(F.size("w"), F.lit(1))), " ").alias("suffix"))


@plans.add("text_probe", r"""
WITH t AS (SELECT lang, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '<|endoftext|><|endoftext|>' ELSE '' END AS t FROM documents)
SELECT lang, count(*) AS n, sum((regexp_replace(t, '\s', '', 'g') = '')::BIGINT)::BIGINT AS n_empty, sum((length(t) - length(replace(t, '<|endoftext|>', ''))) // 13)::BIGINT AS n_marks,
  min(length(t))::BIGINT AS least_chars, round(avg(length(t)), 6) AS mean_chars, max(length(t))::BIGINT AS most_chars,
  min(len(regexp_extract_all(t, '\S+')))::BIGINT AS least_words, round(avg(len(regexp_extract_all(t, '\S+'))), 6) AS mean_words, max(len(regexp_extract_all(t, '\S+')))::BIGINT AS most_words
FROM t GROUP BY lang""")
def text_probe(spark, sf):
    """Counts of texts, empty texts, end marks, characters and words in one aggregation."""
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("<|endoftext|><|endoftext|>")).otherwise(F.lit("")))
    d = table(spark, sf, "documents").select("lang", t.alias("t")).select(
        "lang", (X.strip(F.col("t")) == "").cast("long").alias("empty"), X.count_literal(F.col("t"), "<|endoftext|>").alias("marks"),
        F.length("t").cast("long").alias("c"), F.regexp_count("t", F.lit(r"\S+")).cast("long").alias("w"),
    )
    stats = [s for k, name in (("c", "chars"), ("w", "words")) for s in (F.min(k).alias(f"least_{name}"), F.round(F.avg(k), 6).alias(f"mean_{name}"), F.max(k).alias(f"most_{name}"))]
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("empty").alias("n_empty"), F.sum("marks").alias("n_marks"), *stats)


_TASKS = ("text_to_speech", "speech_to_text", "continuation", "unconditional")


@plans.add("position_masks", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['text_to_speech', 'speech_to_text', 'continuation', 'unconditional'][(l_suppkey % 4 + 1)::INT] AS task, l_partkey % 1000 AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, task, CASE task WHEN 'text_to_speech' THEN pos < 200 WHEN 'speech_to_text' THEN pos >= 168 WHEN 'continuation' THEN pos >= 168 AND pos < 275 ELSE false END AS given,
  pos < greatest(least(l_linenumber * 18 * 8, 1000), 0) AS prefix FROM t""")
def position_masks(spark, sf):
    """Whether a row's place in a multimodal sequence is given, by its task, and whether a prefix of tokens of 18 bits holds it."""
    from loomstone.operators.packing import task_given

    task = F.element_at(F.array(*[F.lit(t) for t in _TASKS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", task.alias("task"), (F.col("l_partkey") % 1000).alias("pos"))
    prefix = F.col("pos") < F.greatest(F.least(F.col("l_linenumber") * 18 * 8, F.lit(1000)), F.lit(0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "task", task_given(F.col("task"), F.col("pos"), 168, 32, 75).alias("given"), prefix.alias("prefix"))


@plans.add("fitted_ids", r"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)) AS ids FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, 17), lambda i: coalesce(ids[i], 0)), ',') AS fitted, (len(ids) > 16)::INT AS truncated,
  (SELECT sum((len(ids) > 16)::BIGINT)::BIGINT FROM w) AS n_truncated FROM w""")
def fitted_ids(spark, sf):
    """Sequences cut or filled up to 16, and how many were cut."""
    w = table(spark, sf, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda x: F.length(x)).alias("ids"))
    rows = w.select("doc_id", F.array_join(fit(F.col("ids"), 16, 0).cast("array<string>"), ",").alias("fitted"), (F.size("ids") > 16).cast("int").alias("truncated"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum(F.col("truncated").cast("long")).alias("n_truncated"))))  # one row


@plans.add("kept_chunks", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, len(w), 64)) AS s, w FROM w)
SELECT doc_id, s // 64 AS chunk, len(w[s + 1:s + 64])::BIGINT AS n, md5(array_to_string(w[s + 1:s + 64], ' ')) AS digest FROM c WHERE len(w[s + 1:s + 64]) >= 8""")
def kept_chunks(spark, sf):
    """Chunks of 64 words within documents; those of fewer than 8 are dropped."""
    w = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    c = w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(64)), lambda s: F.slice("w", s + 1, F.lit(64)))).alias("chunk", "c"))
    return c.where(F.size("c") >= 8).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", " ")).alias("digest"))


@plans.add("layered_defaults", """
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value * 2 END, CASE WHEN event_id % 5 = 0 THEN value * 3 END, 1.0) AS scale,
  array_to_string(list_transform(CASE WHEN event_id % 7 = 0 THEN [1.0, 2.0] ELSE [event_id % 4 + 0.5] END, lambda x: x::VARCHAR), ',') AS listed FROM events""")
def layered_defaults(spark, sf):
    """First setting that is there of evaluation, training, legacy and constant; a scalar becomes a list."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    pick = lambda m, k: F.when(i % m == 0, F.col("value") * k)
    listed = F.when(i % 7 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array((i % 4) + 0.5))
    return e.select("event_id", F.coalesce(pick(2, 1), pick(3, 2), pick(5, 3), F.lit(1.0)).alias("scale"), F.array_join(F.transform(listed, lambda x: x.cast("string")), ",").alias("listed"))


@plans.add("formatted_values", r"""
SELECT event_id, printf('%.3f', value) AS fixed, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
  printf('%.4f%%', 100 * value / 500) AS percent, format('{:,}', event_id * 1000) AS grouped,
  CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS clock
FROM (SELECT *, floor(value * 20)::BIGINT AS s FROM events)""")
def formatted_values(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.format_string("%.3f", v).alias("fixed"), X.html_escape(F.col("props")).alias("escaped"), F.format_string("%.4f%%", 100 * v / 500).alias("percent"),
        F.format_number((F.col("event_id") * 1000).cast("long"), 0).alias("grouped"), X.clock(v * 20).alias("clock"),
    )


@plans.add("general_number_format")
def general_number_format(spark, sf):
    """Eight significant digits, trailing zeros cut, in keys of fully named settings."""
    return table(spark, sf, "events").select("event_id", X.general_format(F.col("value")).alias("text"))


@plans.add("kept_examples", r"""
WITH t AS (SELECT doc_id, trim(text) AS t FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
s AS (SELECT doc_id, length(t) AS n, coalesce(sum(length(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT doc_id, n::BIGINT AS n, before::BIGINT AS before FROM s WHERE before < 400000 QUALIFY row_number() OVER (ORDER BY doc_id) <= 300""")
def kept_examples(spark, sf):
    """Examples in order until a number of examples or of characters is reached; the crossing one is included."""
    from loomstone.operators.packing import within_budget

    t = table(spark, sf, "documents").select("doc_id", F.trim("text").alias("t")).where(X.strip(F.col("t")) != "").select("doc_id", F.length("t").cast("long").alias("n"))
    return within_budget(t, "doc_id", "n", most_rows=300, budget=400_000)
