"""Tokens to bits and back, Gray code, error correction, code rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.functions import codecs as C
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()


def _tokens(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey"), F.lit(32768)).alias("t"))


_T = "t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 31 + l_suppkey) % 32768 AS t FROM lineitem)"
_M = 15


@plans.add("gray_codes", f"WITH {_T}, d AS (SELECT DISTINCT t, xor(t, t >> 1) AS g FROM t) SELECT t, g, t AS back, length(bin(greatest(t, 2) - 1))::INT AS width FROM d")
def gray_codes(spark, sf):
    d = _tokens(spark, sf).select("t").distinct().select("t", C.to_gray(F.col("t")).alias("g"))
    return d.select("t", "g", C.from_gray(F.col("g")).alias("back"), C.bits_for(F.col("t")).alias("width"))


_BITS = f"WITH {_T}, o AS (SELECT l_orderkey, list(t ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM t GROUP BY 1), b AS (SELECT l_orderkey, ids, flatten(list_transform(ids, lambda t: list_transform(range(14, -1, -1), lambda k: (t >> k) & 1))) AS bits FROM o)"


def _orders(spark, sf):
    rows = _tokens(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "t"))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda r: r["t"]).alias("ids"))


@plans.add("token_bits", f"{_BITS} SELECT l_orderkey, array_to_string(bits, '') AS bits, array_to_string(list_transform(ids, lambda x: x % 30522), ',') AS decoded, array_to_string(bits[1:12], '') || CASE WHEN len(bits) > 12 THEN '...' ELSE '' END AS preview FROM b")
def token_bits(spark, sf):
    """Bits of token rows, most significant first, and the ids they decode to (modulo the vocabulary)."""
    from loomstone.functions.text import bit_preview

    b = _orders(spark, sf).select("l_orderkey", C.sequence_bits(F.col("ids"), _M).alias("x"))
    return b.select("l_orderkey", F.array_join(F.col("x").cast("array<string>"), "").alias("bits"), F.array_join(C.bits_tokens(F.col("x"), _M, 30522).cast("array<string>"), ",").alias("decoded"), bit_preview(F.col("x"), 12).alias("preview"))


@plans.add("incomplete_bits", f"{_BITS}, c AS (SELECT l_orderkey, bits[1:len(bits) - l_orderkey % 15] AS bits FROM b) SELECT l_orderkey, array_to_string(list_transform(range(0, len(bits) // 15), lambda k: list_sum(list_transform(range(0, 15), lambda j: bits[(k * 15 + j + 1)::INT] << (14 - j)))::BIGINT), ',') AS ids, array_to_string(list_transform(range(0, least((len(bits) + 14) // 15, 2)), lambda k: array_to_string(bits[(k * 15 + 1)::INT:(k * 15 + 15)::INT], '')), ' | ') || CASE WHEN len(bits) > 30 THEN ' ...' ELSE '' END AS chunks FROM c WHERE len(bits) > 0")
def incomplete_bits(spark, sf):
    """Rows cut inside a token: the incomplete tail decodes to nothing."""
    from loomstone.functions.text import bit_chunks

    b = _orders(spark, sf).select("l_orderkey", C.sequence_bits(F.col("ids"), _M).alias("bits"))
    b = b.select("l_orderkey", F.slice("bits", F.lit(1), (F.size("bits") - F.col("l_orderkey") % 15).cast("int")).alias("bits")).where(F.size("bits") > 0)
    return b.select("l_orderkey", F.array_join(C.bits_tokens(F.col("bits"), _M).cast("array<string>"), ",").alias("ids"), bit_chunks(F.col("bits"), _M, 2).alias("chunks"))


def _masks(m: int) -> list[int]:
    return [C._parity_mask(m, k) for k in range(C.parity_size(m))]


def _sql_encode(t: str, m: int) -> str:
    parts = [f"(({t})::BIGINT << {C.parity_size(m)})"] + [f"((bit_count(({t})::BIGINT & {mask}) & 1)::BIGINT << {C.parity_size(m) - 1 - k})" for k, mask in enumerate(_masks(m))]
    body = "(" + " | ".join(parts) + ")"
    return f"(({body} << 1) | (bit_count({body}) & 1)::BIGINT)"


@plans.add("secded_words", f"WITH {_T}, d AS (SELECT DISTINCT t FROM t) SELECT t, {_sql_encode('t', _M)} AS word FROM d")
def secded_words(spark, sf):
    return _tokens(spark, sf).select("t").distinct().select("t", C.secded_encode(F.col("t"), _M).alias("word"))


def _sql_decode() -> str:
    r, m = C.parity_size(_M), _M
    data = f"(w >> {r + 1})"
    syndrome = " + ".join(f"(((bit_count({data} & {mask}) & 1) + ((w >> {r - k}) & 1)) & 1) * {1 << k}" for k, mask in enumerate(_masks(m)))
    flips = [0] * (m + r + 1)
    for i, p in enumerate(C._positions(m)):
        flips[p] = 1 << (m - 1 - i)
    return f"""x AS (SELECT t, n, w, {data} AS data, ({syndrome})::BIGINT AS s, (bit_count(w) & 1) = 1 AS odd FROM f),
y AS (SELECT t, n, CASE WHEN odd AND s > 0 AND s <= {m + r} THEN xor(data, {flips}[(s + 1)::INT]::BIGINT) ELSE data END AS data, ((odd AND s > 0 AND s <= {m + r}) OR (odd AND s = 0))::INT AS corrected, (NOT odd AND s > 0) OR (odd AND s > {m + r}) AS uncorrectable FROM x)"""


@plans.add("secded_repairs", f"""WITH {_T}, d AS (SELECT DISTINCT t, t % 4 AS n FROM t), f AS (SELECT t, n, xor(xor(xor({_sql_encode('t', _M)}, CASE WHEN n > 0 THEN 1::BIGINT << (t % 21)::INT ELSE 0 END), CASE WHEN n > 1 THEN 1::BIGINT << ((t + 5) % 21)::INT ELSE 0 END), CASE WHEN n > 2 THEN 1::BIGINT << ((t + 11) % 21)::INT ELSE 0 END) AS w FROM d), {_sql_decode()}
SELECT t, n, data, corrected, uncorrectable, CASE WHEN uncorrectable THEN 1 ELSE data % 30522 END AS token FROM y""")
def secded_repairs(spark, sf):
    """Words with none to three flipped bits; what cannot be put right becomes the unknown id."""
    d = _tokens(spark, sf).select("t").distinct().select("t", (F.col("t") % 4).alias("n"), C.secded_encode(F.col("t"), _M).alias("w"))
    flip = lambda k, by: F.when(F.col("n") > k, F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("t") + by) % 21).cast("int"))).otherwise(F.lit(0).cast("long"))
    w = F.col("w").bitwiseXOR(flip(0, 0)).bitwiseXOR(flip(1, 5)).bitwiseXOR(flip(2, 11))
    y = d.select("t", "n", C.secded_decode(w, _M).alias("r")).select("t", "n", "r.*")
    return y.select("t", "n", "data", "corrected", "uncorrectable", F.when(F.col("uncorrectable"), F.lit(1).cast("long")).otherwise(F.col("data") % 30522).alias("token"))


@plans.add("secded_statistics", f"""WITH {_T}, d AS (SELECT t, t % 4 AS n FROM t), f AS (SELECT t, n, xor(xor({_sql_encode('t', _M)}, CASE WHEN n > 0 THEN 1::BIGINT << (t % 21)::INT ELSE 0 END), CASE WHEN n > 1 THEN 1::BIGINT << ((t + 5) % 21)::INT ELSE 0 END) AS w FROM d), {_sql_decode()}
SELECT count(*) AS n_tokens, round(avg(corrected), 9) AS share_corrected, round(avg(uncorrectable::INT), 9) AS share_uncorrectable, round(sum(corrected) / count(*), 9) AS mean_corrections FROM y""")
def secded_statistics(spark, sf):
    flip = lambda k, by: F.when(F.col("n") > k, F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("t") + by) % 21).cast("int"))).otherwise(F.lit(0).cast("long"))
    d = _tokens(spark, sf).select("t", (F.col("t") % 4).alias("n"), C.secded_encode(F.col("t"), _M).alias("w"))
    r = d.select(C.secded_decode(F.col("w").bitwiseXOR(flip(0, 0)).bitwiseXOR(flip(1, 5)), _M).alias("r")).select("r.*")
    return r.agg(F.count("*").alias("n_tokens"), F.round(F.avg("corrected"), 9).alias("share_corrected"), F.round(F.avg(F.col("uncorrectable").cast("int")), 9).alias("share_uncorrectable"), F.round(F.sum("corrected") / F.count("*"), 9).alias("mean_corrections"))


@plans.add("stopped_codes", """
WITH e AS (SELECT user_id, list(c ORDER BY event_id) AS ids FROM (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 WHEN 'error' THEN 9999 ELSE event_id % 400 + 3 END AS c FROM events) GROUP BY 1),
s AS (SELECT user_id, ids, least(nullif(coalesce(list_position(ids, 0), 0), 0), nullif(coalesce(list_position(ids, 2), 0), 0)) - 1 AS stop FROM e), h AS (SELECT *, CASE WHEN stop IS NULL THEN ids ELSE ids[1:stop] END AS head FROM s),
k AS (SELECT *, list_filter(head, lambda t: (t >= 0 AND t < 300) OR t = 9999) AS kept FROM h)
SELECT user_id, array_to_string(kept, ',') AS kept, len(ids)::INT AS n_input, len(kept)::INT AS n_kept, (len(head) - len(kept))::INT AS n_invalid, len(list_filter(head, lambda t: t = 9999))::INT AS n_unknown,
  CASE WHEN stop IS NOT NULL AND ids[stop + 1] = 0 THEN 1 ELSE 0 END AS hit_pad, CASE WHEN stop IS NOT NULL AND ids[stop + 1] = 2 THEN 1 ELSE 0 END AS hit_end, coalesce(stop, -1)::INT AS stop FROM k""")
def stopped_codes(spark, sf):
    """Code rows cut at the first pad or end mark, with what was kept and why it stopped."""
    code = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 9999).otherwise(F.col("event_id") % 400 + 3)
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", code.alias("c")))).alias("x")).select("user_id", F.transform("x", lambda r: r["c"]).alias("ids"))
    s = e.select("user_id", C.stop_codes(F.col("ids"), 0, 2, 300, 9999).alias("s")).select("user_id", "s.*")
    return s.withColumn("kept", F.array_join(F.col("kept").cast("array<string>"), ","))


@plans.add("stripped_edges", """
WITH e AS (SELECT user_id, list(c ORDER BY event_id) AS ids FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE event_id % 50 + 1 END AS c FROM events) GROUP BY 1),
a AS (SELECT user_id, CASE WHEN ids[1] = 0 THEN ids[2:] ELSE ids END AS ids FROM e), b AS (SELECT user_id, CASE WHEN ids[-1] = 0 THEN ids[1:len(ids) - 1] ELSE ids END AS ids FROM a)
SELECT user_id, array_to_string(ids, ',') AS ids, len(ids)::BIGINT AS n, CASE WHEN len(ids) = 0 THEN '0' ELSE array_to_string(ids[1:4], ',') END AS shown FROM b""")
def stripped_edges(spark, sf):
    """One mark is taken off each end; an empty row shows the mark but counts nothing."""
    code = F.when(F.col("event_type").isin("view", "click"), F.lit(0)).otherwise(F.col("event_id") % 50 + 1)
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", code.alias("c")))).alias("x"))
    b = e.select("user_id", C.strip_edges(F.transform("x", lambda r: r["c"]), 0).alias("ids"))
    s = F.col("ids").cast("array<string>")
    return b.select("user_id", F.array_join(s, ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.when(F.size("ids") == 0, "0").otherwise(F.array_join(F.slice(s, 1, 4), ",")).alias("shown"))


@plans.add("best_indices", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best, array_to_string(list_transform(range(0, 8), lambda i: (embedding[((i * 5) % 8 + 1)::INT] > 0)::INT), '') AS reordered FROM embeddings")
def best_indices(spark, sf):
    """First largest score, and thresholded values in another order."""
    e = table(spark, sf, "embeddings")
    order = F.array(*[F.lit(i * 5 % 8) for i in range(8)])
    bits = F.transform(C.reorder(F.col("embedding"), order), lambda x: (x > 0).cast("int").cast("string"))
    return e.select("vec_id", C.best_index(F.col("embedding")).alias("best"), F.array_join(bits, "").alias("reordered"))


@plans.add("checksums", """
WITH RECURSIVE r AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM r WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS v FROM r WHERE k = 8),
s AS (SELECT url, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(url, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, v[((xor(c, b) & 255) + 1)::INT])), 4294967295) AS crc FROM pages, t)
SELECT url, crc, crc % 1000 + 2997 AS seed FROM s""")
def checksums(spark, sf):
    """CRC-32 of keys and seeds derived from it, whose SQL counterpart goes by table."""
    return table(spark, sf, "pages").select("url", F.crc32("url").alias("crc"), (F.crc32("url") % 1000 + 999 * 3).alias("seed"))


@plans.add("inverted_map", "SELECT v AS old_id, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT label AS v FROM embeddings)")
def inverted_map(spark, sf):
    """A permutation map and its inverse, read from entries."""
    from loomstone.functions.codecs import invert_map

    rows = table(spark, sf, "embeddings").select(F.col("label").alias("v")).distinct()
    ranked = rows.select((F.row_number().over(W.orderBy("v")) - 1).cast("long").alias("k"), "v")  # one row per label
    m = ranked.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return m.select(F.explode(invert_map(F.col("m"))).alias("old_id", "k"))


@plans.add("pair_counts", r"""
WITH w AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents), v AS (SELECT unnest(w) AS word FROM w), c AS (SELECT word, count(*) AS n FROM v GROUP BY 1),
p AS (SELECT n, unnest(list_transform(range(1, length(word)), lambda i: word[i] || ' ' || word[i + 1])) AS pair FROM c WHERE length(word) > 1)
SELECT pair, sum(n)::BIGINT AS n FROM p GROUP BY 1 ORDER BY n DESC, pair LIMIT 200""")
def pair_counts(spark, sf):
    """The 200 most frequent symbol pairs: one step of learning merges."""
    from loomstone.functions.text import words
    from loomstone.operators.merges import pair_frequencies, word_symbols

    symbols = word_symbols(table(spark, sf, "documents").select(words(F.col("text")).alias("w")), F.col("w"))
    return pair_frequencies(symbols).select(F.concat_ws(" ", "left", "right").alias("pair"), "n").orderBy(F.desc("n"), "pair").limit(200)


@plans.add("learned_merges")
def learned_merges(spark, sf):
    """Twenty merges learned from the words of all documents."""
    from loomstone.functions.text import words
    from loomstone.operators.merges import learn_merges

    return learn_merges(table(spark, sf, "documents").select(words(F.col("text")).alias("w")), F.col("w"), 20)


@plans.add("warm_start_check", """
WITH o AS (SELECT n_nationkey AS i, n_name AS m FROM nation WHERE n_nationkey < 10), n AS (SELECT n_nationkey AS i, CASE WHEN n_nationkey = 7 THEN 'OTHER' ELSE n_name END AS m FROM nation)
SELECT (SELECT count(*) FROM o JOIN n USING (i) WHERE o.m <> n.m) + (SELECT count(*) FROM o WHERE i NOT IN (SELECT i FROM n)) AS n_changed, (SELECT count(*) FROM o WHERE m NOT IN (SELECT m FROM n)) AS n_missing""")
def warm_start_check(spark, sf):
    """Old merges that the new list has not at the same place, and old entries that it lacks."""
    from loomstone.operators.merges import prefix_check

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("m"))
    return prefix_check(n.where("i < 10"), n.withColumn("m", F.when(F.col("i") == 7, "OTHER").otherwise(F.col("m"))), "i", "m")


@plans.add("private_use_text", f"{_BITS} SELECT l_orderkey, array_to_string(list_transform(ids, lambda t: chr((57344 + t)::INT)), '') AS text, array_to_string(ids, ',') AS back, array_to_string(list_transform(ids, lambda t: CASE WHEN t < 30000 THEN t ELSE 1 END), ',') AS ended, array_to_string(list_filter(ids, lambda t: t < 30000), ',') AS skipped FROM b")
def private_use_text(spark, sf):
    """Ids as private-use characters, the ids of such texts, and what characters outside the vocabulary become."""
    t = _orders(spark, sf).select("l_orderkey", C.private_text(F.col("ids"), 0xE000).alias("text"))
    joined = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    back = lambda n, *how: joined(C.private_ids(F.col("text"), 0xE000, n, *how))
    return t.select("l_orderkey", "text", back(32768).alias("back"), back(30000, "eos", 1).alias("ended"), back(30000, "skip").alias("skipped"))


@plans.add("trained_vocabulary")
def trained_vocabulary(spark, sf):
    """Marks, a forced alphabet, and the entries of merges learned after those of an earlier run."""
    from loomstone.functions.text import words
    from loomstone.operators.merges import train_vocabulary

    docs = table(spark, sf, "benchmark").select(words(F.col("text")).alias("w"))
    return train_vocabulary(docs, F.col("w"), 90, [chr(c) for c in range(97, 123)], warm=[("e", "n"), ("a", "r")])[0]


@plans.add("large_vocabulary")
def large_vocabulary(spark, sf):
    """65,536 entries, or as many as there are pairs for, learned from all documents in rounds of many merges."""
    from loomstone.functions.text import words
    from loomstone.operators.merges import train_vocabulary

    docs = table(spark, sf, "documents").select(words(F.col("text")).alias("w"))
    return train_vocabulary(docs, F.col("w"), 1 << 16, [chr(c) for c in range(32, 127)])[0]


@plans.add("grown_vocabulary")
def grown_vocabulary(spark, sf):
    """A vocabulary of 6,000 entries grown to 9,000 by a warm start, and whether it still has the old entries in place."""
    from loomstone.functions.text import words
    from loomstone.operators.merges import prefix_check, train_vocabulary

    docs = table(spark, sf, "documents").select(words(F.col("text")).alias("w"))
    old, merges = train_vocabulary(docs, F.col("w"), 6000)
    new, _ = train_vocabulary(docs, F.col("w"), 9000, warm=[(r["left"], r["right"]) for r in merges.orderBy("rank").collect()])
    counts = old.agg(F.count("*").alias("n_old")).crossJoin(new.agg(F.count("*").alias("n_new")))  # one row each
    return counts.crossJoin(prefix_check(old, new, "id", "token"))
