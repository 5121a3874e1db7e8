from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").where("held_out").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_fold_follows_crc32(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long").select("doc_id", Q.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9 + 1)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit_quality(docs, labels), Q.fit_quality(docs, flipped)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_flat_trees_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] < -0.5)).astype(float)
    f = Q.grow(x, y, trees=15, depth=4)

    def walk(row):
        total = f.base
        for t in range(len(f.value)):
            node = 0
            while f.left[t, node] != node:
                node = f.left[t, node] if row[f.feature[t, node]] <= f.threshold[t, node] else f.right[t, node]
            total += f.value[t, node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x[:60]), [walk(r) for r in x[:60]])
    assert ((f.score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 1), (2, None)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (2, None, 0.5), (None, "", 0.5), (2, None, 0.5)], "doc_id long, text string, score double")
    got = Q.score_quality(docs.drop("score"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert Q.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), name="_score").columns == ["doc_id", "text", "score", "_score"]
    assert Q.score_quality(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "\n", "x", " ", "é" * 100_000, "a " * 200_000, "\ud800"):
        s = Q.statistics(t)
        assert len(s) == len(Q.FEATURES) and np.isfinite(s).all()
