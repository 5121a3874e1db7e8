"""Stored sketches against exact counts; batches of a table function; progress of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.text import words
from loomstone.operators import collation, sketches
from loomstone.plans.registry import QUERIES


def test_sketches_add_up_within_their_bound(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", words(F.col("text")).alias("w"))
    exact: dict = {}
    for r in docs.collect():
        s, n = exact.setdefault(r.lang, (set(), [0]))
        s.update(zip(r.w, r.w[1:], strict=False))
        n[0] += max(0, len(r.w) - 1)
    bound = 4 * 1.04 / 2 ** (sketches.REGISTERS / 2)
    for r in QUERIES["sketched_distinct_2"](spark, sf).collect():
        assert r.grams == exact[r.lang][1][0] and abs(r.distinct / len(exact[r.lang][0]) - 1) < bound
    # Shards come one after another, the same one twice, and no text is read again.
    for part in (docs.where("source < 'src2'"), docs.where("source >= 'src2'"), docs.where("source < 'src2'")):
        sketches.add_sketches(sketches.ngram_sketches(part, F.col("w"), 2, ["lang"]), f"{tmp_path}/s")
    for r in sketches.distinctness_of_sketches(spark.read.parquet(f"{tmp_path}/s"), 2, ["lang"]).collect():
        assert abs(r.distinct / len(exact[r.lang][0]) - 1) < bound
    assert sketches.ngram_sketches(docs.limit(0), F.col("w"), 2, ["lang"]).collect() == []


def test_batches_of_odd_rows(spark):
    collation.register(spark)
    rows = spark.createDataFrame([(0, 1, [5]), (0, 2, None), (0, 3, [7, 8, 9]), (1, 4, []), (1, 5, [1, 2])], "bucket long, id long, ids array<int>")
    got = spark.sql("SELECT * FROM collate(2, -1, TABLE({rows}) PARTITION BY bucket ORDER BY (id))", rows=rows).collect()
    found = sorted((r.bucket, r.batch, r["keys"], r.ids, r.lengths, r.mask) for r in got)
    assert found == [
        (0, 0, [1, 2], [[5], [-1]], [1, 0], [[1], [0]]), (0, 1, [3], [[7, 8, 9]], [3], [[1, 1, 1]]), (1, 0, [4, 5], [[-1, -1], [1, 2]], [0, 2], [[0, 0], [1, 1]]),
    ]
