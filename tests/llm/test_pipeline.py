from __future__ import annotations

import pytest

import corpus_pipeline as P
from loomstone.llm import decontam, lines, mixing, nearsets, quality
from loomstone.llm.registry import oracle_sql, queries
from oracle import connect, differences


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert differences(queries()[name](spark, sf), connect(sf), oracle_sql()[name]) == ([], [])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 11)}


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    scored = {r.doc_id: r.s for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"), name="s").collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        before, rows = {r.doc_id: r for r in docs.collect()}, out.collect()
        after = {r.doc_id: r for r in rows}
        if name != "mix":
            assert out.columns == docs.columns and len(rows) == len(after)
        if name == "quality":
            assert set(after) == {i for i in before if scored[i] >= 0.5} and len(after) < len(before)
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            found = nearsets.near_duplicates(docs, width=5).collect()
            assert set(after) == {r.component for r in found}
        elif name == "decontaminate":
            hit = {r.id for r in decontam.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.contaminated}
            assert hit and set(after) == set(before) - hit
        else:
            mixed = {r.id: r.copies for r in mixing.mix_sources(docs).collect() if r.size}
            copies: dict = {}
            for r in rows:
                copies.setdefault(r.doc_id, []).append(r.copy_no)
            assert {i: sorted(c) for i, c in copies.items()} == {i: list(range(1, n + 1)) for i, n in mixed.items() if n}
        docs = spark.createDataFrame(docs.sparkSession.createDataFrame(rows, out.schema).collect(), out.schema)


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and "copy_no" in out.columns


def test_odd_documents_pass_every_stage(spark, tmp_path):
    docs = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "plain words that say a little about nothing", "en", None, 43), (2, "plain words that say a little about nothing", "en", None, 43), (3, "x" * 100_000, "en", "s", 100_000), (4, "plain words that say a little about nothing more", "fr", "s", 48)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(2, 1), (4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, []):
        df = spark.createDataFrame(rows, schema).withColumn("k", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
        for _, stage in P.STAGES:
            assert stage(spark, df, str(tmp_path)).count() >= 0
