from __future__ import annotations

import numpy as np
import pytest

from loomstone.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, k string"


def _rows():
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for label in (0, 1, 2):
        for centre in rng.standard_normal((6, 16)):
            for _ in range(25):
                rows.append((i, [float(v) for v in centre + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.08, 0.2])], label))
                i += 1
    v = rows[0][1]
    odd = [None, [], [0.0] * 16, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [None, *v[1:]], v[:8], [x * 1e30 for x in v], [x * 1e-30 for x in v]]
    rows += [(i + k, x, 0) for k, x in enumerate(odd)] + [(i + 20, v, None), (i + 21, v, 0), (i + 21, v, 0), (None, v, 0)]
    return [(a, b, c, "x") for a, b, c in rows]


def _brute(rows):
    usable = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) and r[2] is not None for r in rows]
    x = [np.array(r[1], np.float32).astype(float) / max(map(abs, np.array(r[1], np.float32).astype(float))) if u else None for r, u in zip(rows, usable, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((-1 if r[0] is None else r[0], links[i], least.get(find(i), -1)) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [None, 4])
def test_matches_brute_force(spark, block):
    rows = _rows()
    got = V.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_links, -1 if r.component is None else r.component) for r in got) == _brute(rows)


def test_chance_to_meet(spark):
    """Pairs at the very threshold share a bucket of some table as often as planned."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    zero = np.zeros(2000, np.int64)
    assert all((V.bucket_keys(a, zero, *V.hash_choice(n)) == V.bucket_keys(near, zero, *V.hash_choice(n))).any(axis=1).mean() > 0.998 for n in (10, 3000, 10**6))


def test_empty_table(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keys_do_not_depend_on_company():
    """A vector has the same keys alone, among others and in the first tables only, whatever its scale in powers of two."""
    rng = np.random.default_rng(5)
    for dim in (1, 3, 64, 5000):
        x, salt = rng.standard_normal((301, dim)), np.arange(301)
        whole = V.bucket_keys(x, salt, 7, 5)
        alone = np.concatenate([V.bucket_keys(x[i : i + 1] * 2.0 ** (i % 9), salt[i : i + 1], 7, 5) for i in range(301)])
        assert (whole == alone).all()
        assert (V.bucket_keys(x[::-1], salt[::-1], 7, 5, 2)[::-1] == whole[:, :2]).all()


def test_planted_links(spark):
    """Many links at the threshold in 64 dimensions, a component of three steps, counted once though pairs meet in many tables."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(300):
        x = rng.standard_normal(64)
        for step in range(4):
            rows.append((4 * g + step, [float(v) for v in x], g % 3, "x"))
            y = rng.standard_normal(64)
            y -= (x @ y) / (x @ x) * x
            x = 0.985 * x + np.sqrt(1 - 0.985**2) * np.linalg.norm(x) * y / np.linalg.norm(y)
    got = {r.id: (r.n_links, r.component) for r in V.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted((k, *v) for k, v in got.items()) == _brute(rows)
    assert sum(n for n, _ in got.values()) >= 1800  # every step; a few pairs two steps apart reach 0.98 by chance
