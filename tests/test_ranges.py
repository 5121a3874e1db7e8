from __future__ import annotations

import bisect
import random

import numpy as np
from pyspark.sql import functions as F

from loomstone.operators import ranges as R

POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def _check(spark, groups, **how):
    rows = [(g, v) for g, values in groups.items() for v in values]
    got = R.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", ["g"], POINTS).collect()
    want = {(g, p): float(np.percentile(x, p * 100)) for g, values in groups.items() for x in [[v for v in values if v is not None and np.isfinite(v)]] if x for p in POINTS}
    assert {(r.g, r.point) for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        assert np.isclose(r.value, want[r.g, r.point], rtol=1e-12, atol=0), r


def test_percentiles_of_every_kind_of_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.standard_normal(3000).tolist(), "ties": [1.0] * 500 + [2.0] * 3, "one": [7.5], "two": [1.0, 2.0], "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, 5e-324], "skew": (10.0 ** rng.uniform(-300, 300, 400)).tolist(),
        "odd": [None, float("nan"), float("inf"), 3.0, 4.0], "none": [None, float("nan")], None: [1.0, 2.0, 4.0],
    }
    _check(spark, groups)
    monkeypatch.setattr(R, "BROADCAST", 0)
    monkeypatch.setattr(R, "BUCKETS", 16)
    _check(spark, {k: groups[k] for k in ("normal", "ties", "two", "odd")})
    assert R.percentiles(spark.createDataFrame([], "g string, v double"), "v", ["g"], POINTS).collect() == []


def test_values_between_edges(spark):
    random.seed(3)
    edges = sorted({round(random.uniform(0, 100) ** 2 / 100, 2) for _ in range(400)})
    values = [random.uniform(-5, 110) for _ in range(2000)] + edges + [5.0] * 3000 + [None, -1.0, 1e9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    table = spark.createDataFrame([(e,) for e in [*edges, edges[0], None]], "x double")
    for how in ({}, {"ranges": 7, "each": 100}, {"ranges": 1}):
        got = {r.i: (r.edge, r.bin) for r in R.place_between(rows, "v", table, "x", **how).collect()}
        assert len(got) == len(values)
        for i, v in enumerate(values):
            k = -1 if v is None else bisect.bisect_left(edges, v) - 1
            assert got[i] == (edges[k] if k >= 0 else None, k), (v, how)
    plan = R.place_between(rows, "v", table, "x")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.bin for r in R.place_between(rows, F.col("v") * 2, table.limit(0), "x").collect()} == {-1}
    assert R.place_between(rows.limit(0), "v", table, "x").collect() == []
