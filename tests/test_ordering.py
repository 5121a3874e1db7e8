"""Orders of vectors: groups joined from fragments in many tasks, against the path of one task and against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from loomstone.operators import ordering as O


def _table(spark, groups):
    rows = [(g, k, [float(c) for c in v]) for g, x in groups.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "g int, k long, v array<float>").repartition(4)


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clustered(n, seed):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // 20, 16))
    return c[rng.integers(0, len(c), n)] + rng.standard_normal((n, 16)) * 0.7


def _mean(x, order):
    u = _unit(x)[order]
    return float((u[:-1] * u[1:]).sum(axis=1).mean())


def test_fragments_are_as_good_as_one_path(spark):
    groups = {0: _clustered(2000, 1), 1: _clustered(300, 2), 2: _clustered(40, 3)}
    seen = []
    for block, last in ((1 << 20, 1), (256, 64)):
        got: dict = {}
        for r in O.greedy_order(_table(spark, groups), "g", "k", "v", block=block, last=last).orderBy("place").collect():
            got.setdefault(r.g, []).append((r.place, r.k))
        for g, x in groups.items():
            assert [p for p, _ in got[g]] == list(range(len(x))) and sorted(k for _, k in got[g]) == list(range(len(x)))
        seen.append({g: _mean(x, [k for _, k in got[g]]) for g, x in groups.items()})
    assert seen[1][0] >= seen[0][0] - 0.002 and seen[1][1] >= seen[0][1] - 0.02 and seen[1][2] == seen[0][2]
    assert all(seen[1][g] > _mean(x, np.arange(len(x))) + 0.2 for g, x in groups.items())


@pytest.mark.parametrize("block", [40, 64, 1000])
def test_neighbours_by_blocks_are_the_nearest(spark, block):
    groups = {0: _clustered(200, 4), 1: _clustered(70, 5)}
    rows = _table(spark, groups).selectExpr("g", "k AS id", "v")
    got = {(r.g, r.u, r.v): r.s for r in O.nearest_neighbours(rows, 3, block).collect()}
    want = {}
    for g, x in groups.items():
        s = _unit(x) @ _unit(x).T
        np.fill_diagonal(s, -2)
        for u in range(len(x)):
            for v in np.argsort(-s[u])[:3].tolist():
                want[g, min(u, v), max(u, v)] = s[u, v]
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-5 for e in want)


def test_smoothing_keeps_the_ends_and_never_loses():
    for seed in range(30):
        x = _unit(np.random.default_rng(seed).standard_normal((3 + seed * 3, 5)))
        order = O.smoothed(x)
        assert sorted(order.tolist()) == list(range(len(x))) and order[0] == 0 and order[-1] == len(x) - 1
        assert _mean(x, order) >= _mean(x, np.arange(len(x))) - 1e-12
        link = x[order]
        gain = [link[i] @ link[j] + link[i + 1] @ link[j + 1] - link[i] @ link[i + 1] - link[j] @ link[j + 1] for i in range(len(x) - 1) for j in range(i + 2, len(x) - 1)]
        assert not gain or max(gain) <= 1e-7  # no reversal is left that gains


def test_equal_keys_ties_and_nulls(spark):
    x = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 30 + [[0.0, 0.0]] * 5
    df = spark.createDataFrame([(7, k % 10, v) for k, v in enumerate(x)] + [(7, 99, None), (None, 1, [1.0, 0.0])], "g int, k long, v array<double>")
    for block in (20, 1000):
        got = O.greedy_order(df, "g", "k", "v", block=block, last=16, window=16).orderBy("place").collect()
        assert [r.place for r in got] == list(range(65)) and sorted(r.k for r in got) == sorted(k % 10 for k in range(65))
    assert O.greedy_order(df.limit(0), "g", "k", "v").collect() == []
