from __future__ import annotations

import math
import random

import pytest

from loomstone.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def _docs(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 12 + ["b", "c", "é", "z", None])
        rows.append((i, " ".join(["w"] * max(0, int(rng.lognormvariate(3, 1.2)) - 1)) if rng.random() > 0.02 else None, source, "x"))
    return rows


def test_targets_and_rates(spark):
    rows = _docs()
    got = M.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes: dict = {}
    for r in got:
        assert r.size == len((rows[r.id][1] or "").split())
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = _targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and mine[0].target == pytest.approx(target)
        assert sum(r.rate * r.size for r in mine) == pytest.approx(target, rel=1e-6)
        assert abs(sum(r.copies * r.size for r in mine) - target) <= max(r.size for r in mine)
        tilts = [math.log(r.rate) / r.size for r in mine if r.size and r.rate < 3 - 1e-9]
        assert not tilts or max(tilts) - min(tilts) < 1e-9  # one multiplier per source
    assert all(0 <= r.copies <= 3 and (r.copies in (math.floor(r.rate), math.ceil(r.rate)) or r.size == 0) for r in got)


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(_docs(), SCHEMA)
    a = {r.id: r.copies for r in M.mix_sources(df).collect()}
    assert a == {r.id: r.copies for r in M.mix_sources(df.repartition(13, "doc_id")).collect()}


def test_runs_number_a_large_group(spark, monkeypatch):
    rows = [(i, "five words of one size", "a", "x") for i in range(1000)] + [(5000, "w " * 2000, "b", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(M, "RUN", 64)
    got = [r for r in M.mix_sources(df).collect() if r.source == "a"]
    assert abs(sum(r.copies * r.size for r in got) - got[0].target) <= 5


def test_one_source_is_kept_as_it_is(spark):
    rows = [(i, "w " * (i % 7 + 1), "only", "x") for i in range(50)]
    got = M.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.copies for r in got} == {1}


def test_defined_cases(spark):
    assert M.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, "x"), (1, "", "a", "x"), (1, "", "a", "x"), (2, "w w", "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = M.mix_sources(df)
    assert sorted((r.id or 0, r.size, r.copies) for r in mixed.collect()) == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (2, 2, 1)]
    assert [(r.doc_id, r.copy_no) for r in M.deal_copies(df, mixed).collect()] == [(2, 1)]
    twice = spark.createDataFrame([(1, "w w w", "a", "x"), (1, "w w w", "a", "x"), (2, "v v", "a", "x")], SCHEMA)
    dealt = M.deal_copies(twice, M.mix_sources(twice)).collect()
    assert sorted((r.doc_id, r.copy_no) for r in dealt) == [(1, 1), (1, 2), (2, 1)]
