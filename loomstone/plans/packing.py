"""Vocabularies, streams, blocks, splits and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.codecs import finish_codes
from loomstone.functions.text import words
from loomstone.operators import packing as P
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()
SIZE, PAD, UNK, SEP, EOS, BOS = 2000, 0, 1, 2, 3, 4
RESERVED = 5

_VOCAB = r"""
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 + 5 AS id FROM (SELECT unnest(w) AS word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT 2000)),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM words),
enc AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM tok LEFT JOIN vocab USING (word) GROUP BY doc_id)"""
_BLOCK = "count(*)::BIGINT AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS digest"


def _vocab(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return docs, P.vocabulary(docs, F.col("w"), SIZE, RESERVED)


def _encoded(spark, sf):
    docs, vocab = _vocab(spark, sf)
    return P.encode(docs, "doc_id", F.col("w"), vocab, UNK)


def _digest(blocks):
    return blocks.select("seq_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


@plans.add("vocabulary", f"WITH {_VOCAB} SELECT word, n, id::INT AS id FROM vocab")
def vocabulary(spark, sf):
    return _vocab(spark, sf)[1]


@plans.add("encoded_documents", f"WITH {_VOCAB} SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n, md5(array_to_string(coalesce(ids, []), ',')) AS digest FROM words LEFT JOIN enc USING (doc_id)")
def encoded_documents(spark, sf):
    return _encoded(spark, sf).select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


@plans.add("packed_blocks", f"""WITH {_VOCAB}, full_ AS (SELECT doc_id, ids, row_number() OVER (ORDER BY doc_id) AS r FROM enc), s AS (SELECT unnest(CASE WHEN r = 1 THEN ids ELSE list_concat([2], ids) END) AS id, doc_id, unnest(range(0, len(ids) + (r > 1)::INT)) AS k FROM full_),
p AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM s) SELECT (pos // 128)::BIGINT AS seq_id, {_BLOCK} FROM p GROUP BY 1 HAVING count(*) = 128""")
def packed_blocks(spark, sf):
    """Examples with a boundary between them in blocks of 128; the tail is dropped."""
    return _digest(P.pack_between(_encoded(spark, sf), "doc_id", 128, SEP))


@plans.add("packed_blocks_padded", f"""WITH {_VOCAB}, s AS (SELECT unnest(ids) AS id, doc_id, unnest(range(0, len(ids))) AS k FROM enc), p AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM s),
b AS (SELECT pos // 128 AS seq_id, list(id ORDER BY pos) AS ids FROM p GROUP BY 1)
SELECT seq_id::BIGINT AS seq_id, 128::BIGINT AS n, md5(array_to_string(list_concat(ids, list_transform(range(len(ids), 128), lambda i: 0)), ',')) AS digest FROM b""")
def packed_blocks_padded(spark, sf):
    """No boundaries; the tail is filled up."""
    return _digest(P.pack_between(_encoded(spark, sf), "doc_id", 128, None, PAD))


@plans.add("flat_stream", f"""WITH {_VOCAB}, f AS (SELECT doc_id, list_concat(ids, [3]) AS run FROM enc)
SELECT doc_id, (coalesce(sum(len(run)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, len(run)::BIGINT AS n FROM f""")
def flat_stream(spark, sf):
    return P.flat_stream(_encoded(spark, sf), "doc_id", EOS).select("doc_id", "start", F.size("run").cast("long").alias("n"))


@plans.add("wrapped_blocks", f"""WITH {_VOCAB}, s AS (SELECT unnest(list_concat(ids, [3])) AS id, doc_id, unnest(range(0, len(ids) + 1)) AS k FROM enc), p AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM s)
SELECT (pos // 254)::BIGINT AS seq_id, 256::BIGINT AS n, md5('4,' || string_agg(id::VARCHAR, ',' ORDER BY pos) || ',3') AS digest FROM p GROUP BY 1 HAVING count(*) = 254""")
def wrapped_blocks(spark, sf):
    return _digest(P.pack_wrapped(_encoded(spark, sf), "doc_id", 256, BOS, EOS))


@plans.add("stream_statistics", f"""WITH {_VOCAB}, t AS (SELECT sum(len(ids)) + greatest(count(*) - 1, 0) AS t, count(*) AS m FROM enc)
SELECT t::BIGINT AS n_tokens, m::BIGINT AS n_examples, (t // 128)::BIGINT AS n_whole, ((t + 127) // 128)::BIGINT AS n_begun, (t % 128)::BIGINT AS dropped_tail, ((128 - t % 128) % 128)::BIGINT AS padded_tail FROM t""")
def stream_statistics(spark, sf):
    return P.stream_statistics(_encoded(spark, sf), 128, True)


@plans.add("finished_codes", f"""WITH {_VOCAB} SELECT doc_id, array_to_string(CASE WHEN len(ids) + 1 > 64 THEN list_concat(ids[1:63], [3]) ELSE list_concat(list_concat(ids, [3]), list_transform(range(len(ids) + 1, 64), lambda i: 0)) END, ',') AS codes FROM (SELECT doc_id, coalesce(ids, []) AS ids FROM words LEFT JOIN enc USING (doc_id))""")
def finished_codes(spark, sf):
    """Code rows closed by an end mark, cut or filled up to 64."""
    return _encoded(spark, sf).select("doc_id", F.array_join(finish_codes(F.col("ids"), EOS, PAD, 64).cast("array<string>"), ",").alias("codes"))


@plans.add("multimodal_blocks", f"""WITH {_VOCAB}, m AS (SELECT doc_id, ids, list_transform(range(0, 32), lambda k: (doc_id * 7 + k * 13) % 4096) AS speaker, list_transform(range(0, (doc_id % 900)::BIGINT), lambda k: (doc_id + k * 31) % 46656) AS speech FROM enc),
j AS (SELECT doc_id, list_concat(list_concat(list_transform(range(1, 169), lambda i: coalesce(ids[i], 250771)), list_transform(speaker, lambda x: x + 200019)), list_transform(range(1, 801), lambda i: coalesce(speech[i] + 204115, 250772))) AS ids, (len(ids) > 168)::INT AS cut FROM m)
SELECT doc_id, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS digest, len(list_filter(ids[1:168], lambda x: x <> 250771))::BIGINT AS n_text, len(list_filter(ids[201:], lambda x: x <> 250772))::BIGINT AS n_speech, cut FROM j""")
def multimodal_blocks(spark, sf):
    """Text, speaker and speech ids in one sequence of 1000, and the parts read back from it."""
    e = _encoded(spark, sf).where(F.size("ids") > 0)
    d = F.col("doc_id")
    speaker = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: (d * 7 + k * 13) % 4096)
    speech = F.when(d % 900 > 0, F.transform(F.sequence(F.lit(0), F.greatest((d % 900).cast("int"), F.lit(1)) - 1), lambda k: (d + k * 31) % 46656)).otherwise(F.array().cast("array<long>"))
    j = e.select("doc_id", P.join_modalities(F.col("ids").cast("array<long>"), speaker, speech).alias("x"), (F.size("ids") > 168).cast("int").alias("cut"))
    return j.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.col("x").cast("array<string>"), ",")).alias("digest"), F.size(P.text_part(F.col("x"))).cast("long").alias("n_text"), F.size(P.speech_part(F.col("x"))).cast("long").alias("n_speech"), "cut")


@plans.add("padded_audio_lengths", "SELECT event_id, ceil(value * 1000 / 320)::BIGINT AS n_tokens, (ceil(ceil(value * 1000) / 320) * 320)::BIGINT AS padded FROM events")
def padded_audio_lengths(spark, sf):
    v = F.col("value") * 1000
    return table(spark, sf, "events").select("event_id", F.ceil(v / 320).alias("n_tokens"), (F.ceil(F.ceil(v) / 320) * 320).alias("padded"))


@plans.add("position_split", "WITH n AS (SELECT greatest(1, round_even(count(*) * 0.0125, 0)::BIGINT) AS h, count(*) AS n FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 >= n.n - n.h THEN 'val' ELSE 'train' END AS split FROM documents, n")
def position_split(spark, sf):
    return P.split_by_position(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.0125)


@plans.add("holdout_tail", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) > (SELECT count(*) FROM documents) - 100 AS held FROM documents")
def holdout_tail(spark, sf):
    """The last 100 rows of a dataset as its test part."""
    d = table(spark, sf, "documents").select("doc_id")
    return P.row_numbers(d, "doc_id", "r").crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("doc_id", (F.col("r") >= F.col("n") - 100).alias("held"))  # one row


@plans.add("even_shards", "SELECT event_id, (ntile(7) OVER (ORDER BY event_id) - 1)::INT AS shard FROM events")
def even_shards(spark, sf):
    return P.even_shards(table(spark, sf, "events").select("event_id"), "event_id", 7)


@plans.add("batches_dropping_last", "WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch FROM documents) SELECT batch::BIGINT AS batch, count(*) AS n, min(doc_id) AS first FROM b GROUP BY 1 HAVING count(*) = 48")
def batches_dropping_last(spark, sf):
    b = P.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 48)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n = 48")


@plans.add("seeded_shuffle")
def seeded_shuffle(spark, sf):
    """A place in a shuffle from key and seed, the same in every run and on every cluster."""
    return P.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 42).orderBy("place", "doc_id")


@plans.add("pending_rows", "SELECT event_id, shard FROM (SELECT event_id, (ntile(4) OVER (ORDER BY value, event_id) - 1)::INT AS shard FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view'))")
def pending_rows(spark, sf):
    """Unfinished rows in order of length, in even shards: what a resumed run works on."""
    e = table(spark, sf, "events")
    from loomstone.operators.relational import ordered_shards

    return ordered_shards(P.pending(e.select("event_id", "value"), e.where("event_type = 'view'"), "event_id"), ["value", "event_id"], 4).select("event_id", "shard")


@plans.add("worker_totals", "SELECT (user_id % 8)::BIGINT AS worker, count(*) AS n, sum((value > 100)::BIGINT)::BIGINT AS n_cut, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def worker_totals(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.pmod("user_id", F.lit(8)).alias("worker")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 100).cast("long")).alias("n_cut"), F.round(F.sum("value"), 4).alias("seconds"))


@plans.add("collated_batches", r"""
WITH d AS (SELECT doc_id, doc_id % 8 AS bucket, list_transform(regexp_extract_all(lower(coalesce(text, '')), '\S+'), lambda w: length(w)) AS ids FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY len(ids), doc_id) - 1) // 16 AS batch FROM d), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY bucket, batch) AS width FROM r)
SELECT bucket, batch::INT AS batch, string_agg(doc_id::VARCHAR, ',' ORDER BY len(ids), doc_id) AS keys, string_agg(len(ids)::VARCHAR, ',' ORDER BY len(ids), doc_id) AS lengths,
  md5(string_agg(array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: -1)), ','), ';' ORDER BY len(ids), doc_id)) AS ids, sum(len(ids))::BIGINT AS n_real, any_value(width)::INT AS width FROM m GROUP BY 1, 2""")
def collated_batches(spark, sf):
    """Documents as batches of sixteen of similar length, filled up, with lengths and masks: a table function called by SQL."""
    from loomstone.functions.text import words
    from loomstone.operators import collation

    collation.register(spark)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 8).alias("bucket"), F.transform(words(F.col("text")), lambda w: F.length(w)).alias("ids"))
    b = spark.sql("SELECT * FROM collate(16, -1, TABLE(SELECT *, size(ids) AS n FROM {rows}) PARTITION BY bucket ORDER BY (n, id))", rows=d)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return b.select(
        "bucket", "batch", joined("keys").alias("keys"), joined("lengths").alias("lengths"), F.md5(F.array_join(F.transform("ids", joined), ";")).alias("ids"),
        F.aggregate(F.flatten("mask"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"), F.array_max(F.transform("mask", F.size)).alias("width"),
    )
