"""Representations of tokens, ranks and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import codecs as C
from loomstone.operators import representations as R
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()

_IDS = r"e AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w) % 24) AS ids FROM documents)"
_RANKS = "r AS (SELECT (k * 7) % 20 AS old_id, k AS new_id FROM (SELECT unnest(range(0, 20)) AS k))"


def _ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda w: F.length(w) % 24).alias("ids"))


def _ranks(spark):
    return spark.range(20).select((F.col("id") * 7 % 20).cast("int").alias("old_id"), F.col("id").cast("int").alias("new_id"))


@plans.add("semantic_ranks", f"WITH {_IDS}, {_RANKS}, x AS (SELECT doc_id, unnest(ids) AS t, unnest(range(0, len(ids))) AS p FROM e) SELECT doc_id, string_agg(coalesce(new_id, t)::VARCHAR, ',' ORDER BY p) AS ranks FROM x LEFT JOIN r ON t = old_id GROUP BY 1")
def semantic_ranks(spark, sf):
    """Ids as ranks; an id without a rank stays."""
    return R.to_ranks(_ids(spark, sf), "doc_id", "ids", _ranks(spark)).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ranks"))


@plans.add("ids_of_ranks", f"WITH {_IDS}, {_RANKS}, x AS (SELECT doc_id, greatest(0, least(unnest(ids), 20)) AS t, unnest(range(0, len(ids))) AS p FROM e) SELECT doc_id, string_agg(coalesce(old_id, 99)::VARCHAR, ',' ORDER BY p) AS ids FROM x LEFT JOIN r ON t = new_id GROUP BY 1")
def ids_of_ranks(spark, sf):
    """Ranks as ids: clamped, and the unknown id where no id has the rank."""
    return R.from_ranks(_ids(spark, sf), "doc_id", "ids", _ranks(spark), 19, 99).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@plans.add("decoded_representations", f"WITH {_IDS} SELECT doc_id, array_to_string(list_transform(ids, lambda t: t % 17), ',') AS plain, array_to_string(list_transform(ids, lambda t: t % 17), ',') AS gray, array_to_string(ids, ',') AS corrected FROM e")
def decoded_representations(spark, sf):
    """Bits in three forms, each read back by the decoder of its name; the last with one bit of every word flipped."""
    rows = _ids(spark, sf).withColumn("ids", F.col("ids").cast("array<long>"))
    gray = C.sequence_bits(F.transform("ids", lambda t: C.to_gray(t)), 5)
    words = F.transform(C.secded_words(F.col("ids"), 5), lambda w: w.bitwiseXOR(F.lit(1 << 7).cast("long")))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    wide = rows.select("doc_id", C.sequence_bits(F.col("ids"), 5).alias("a"), gray.alias("b"), C.sequence_bits(words, 5 + C.parity_size(5) + 1).alias("c"))
    return wide.select(
        "doc_id", text(R.decoder("bits", "binary", "token", width=5, vocabulary=17)(F.col("a"))).alias("plain"),
        text(R.decoder("bits", "gray", "token", width=5, vocabulary=17)(F.col("b"))).alias("gray"), text(R.decoder("bits", "secded", "token", width=5, vocabulary=32)(F.col("c"))).alias("corrected"),
    )


@plans.add("thresholded_bits", "SELECT vec_id, '1010' || array_to_string(list_transform(embedding[5:], lambda x: (x > 0.5)::INT), '') AS bits FROM embeddings")
def thresholded_bits(spark, sf):
    prefix = F.array(*[F.lit(b).cast("tinyint") for b in (1, 0, 1, 0)])
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(R.threshold_bits(F.col("embedding"), prefix).cast("array<string>"), "").alias("bits"))


@plans.add("tiled_rows", "WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS r, count(*) OVER () AS m FROM benchmark), p AS (SELECT unnest(range(0, 1000)) AS place) SELECT item_id, place FROM p JOIN i ON r = place % m")
def tiled_rows(spark, sf):
    """Rows repeated in order up to a number of them."""
    return R.tiled(table(spark, sf, "benchmark").select("item_id"), "item_id", 1000)


@plans.add("kept_texts", r"SELECT doc_id, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> '' ORDER BY doc_id LIMIT 50")
def kept_texts(spark, sf):
    """The first fifty texts that are not empty after cleaning."""
    from loomstone.functions.text import strip

    return R.keep_examples(table(spark, sf, "documents"), "doc_id", strip(F.coalesce("text", F.lit(""))), 50)


@plans.add("mixed_draws", "SELECT event_id, CASE WHEN (event_id % 100) / 100.0 < 0.3 THEN value * 2 ELSE value END AS level, greatest(0, least(48, 10 + floor((event_id % 997) / 997.0 * 51)::INT)) AS prompt FROM events")
def mixed_draws(spark, sf):
    """Levels and prompt lengths drawn by given uniform numbers."""
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", R.mixed_draw(F.col("value"), F.col("value") * 2, (i % 100) / 100.0, F.lit(0.3)).alias("level"), R.prompt_length((i % 997) / 997.0, 10, 60, 48).alias("prompt"))


@plans.add("injected_tokenizer", r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS n_tokens, array_to_string(regexp_extract_all(coalesce(text, ''), '\S+'), ' ') = decoded_ AS same FROM (SELECT *, array_to_string(regexp_extract_all(coalesce(text, ''), '\S+'), ' ') AS decoded_ FROM documents)""")
def injected_tokenizer(spark, sf):
    """A tokenizer object injected into the plan, and the texts that its ids decode to."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1)).alias("w"))
    d = d.select("doc_id", F.array_join("w", " ").alias("t"))
    coded = d.select("doc_id", "t", R.tokenize(_Lengths)(F.col("t")).alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (F.length(R.detokenize(_Lengths)(F.col("ids"))) == F.length("t")).alias("same"))


class _Lengths:
    """A stand-in tokenizer: the id of a word is its length."""

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join("x" * i for i in ids)
