"""Queries that have no SQL counterpart, against values worked out in plain Python."""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomstone.functions import codecs as C
from loomstone.operators import distributions, merges
from loomstone.plans.registry import QUERIES


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_folders(spark, sf):
    for r in QUERIES["short_folders_blake2b"](spark, sf).collect():
        assert r.folder.endswith("__h=" + hashlib.blake2b(r.key.encode(), digest_size=16).hexdigest())


def test_number_format(spark, sf):
    values = {r.event_id: r.value for r in _table(spark, sf, "events").collect()}
    assert {r.event_id: r.text for r in QUERIES["general_number_format"](spark, sf).collect()} == {i: "none" if v is None else f"{v:.8g}" for i, v in values.items()}


def test_bit_error_rates(spark, sf):
    for r in QUERIES["bit_error_rates"](spark, sf).collect():
        assert math.isclose(r.expected, 0.5 * math.erfc(0.5 / (r.sigma * math.sqrt(2))), rel_tol=1e-12)


def test_seeded_shuffle_is_a_permutation(spark, sf):
    one, two = ([r.doc_id for r in QUERIES["seeded_shuffle"](spark, sf).collect()] for _ in range(2))
    assert one == two and sorted(one) == sorted(r.doc_id for r in _table(spark, sf, "documents").collect()) and one != sorted(one)


def _merged(words: Counter, n: int, warm=()):
    words = {tuple(w): c for w, c in words.items()}

    def join(a, b):
        out = Counter()
        for w, c in words.items():
            s = []
            for x in w:
                if s and s[-1] == a and x == b:
                    s[-1] = a + b
                else:
                    s.append(x)
            out[tuple(s)] += c
        return out

    found = []
    for a, b in warm:
        words = join(a, b)
    for _ in range(n):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] += c
        if not pairs or max(pairs.values()) < 2:
            break
        top = min(pairs, key=lambda p: (-pairs[p], p))
        found.append((*top, pairs[top]))
        words = join(*top)
    return found


def _words(spark, sf, name):
    return Counter(w for r in _table(spark, sf, name).collect() for w in (r.text or "").lower().split())


def test_learned_merges(spark, sf):
    got = [(r.left, r.right, r.n) for r in QUERIES["learned_merges"](spark, sf).orderBy("rank").collect()]
    assert got == _merged(_words(spark, sf, "documents"), 20)


def test_trained_vocabulary(spark, sf):
    words, warm = _words(spark, sf, "benchmark"), [("e", "n"), ("a", "r")]
    singles = sorted({c for w in words for c in w} | {chr(c) for c in range(97, 123)})
    head = [*merges.SPECIALS, *singles, "en", "ar"]
    want = list(dict.fromkeys([*head, *(a + b for a, b, _ in _merged(words, 90 - len(head), warm))]))
    assert [r.token for r in QUERIES["trained_vocabulary"](spark, sf).orderBy("id").collect()] == want[:90]


def test_frechet_distance(spark, sf):
    x = {g: np.array([r.embedding for r in _table(spark, sf, "embeddings").collect() if r.label == g], float) for g in (0, 1)}
    a, b = (np.cov(v, rowvar=False) for v in x.values())
    w, v = np.linalg.eigh(a)
    half = v @ np.diag(np.sqrt(np.maximum(w, 0))) @ v.T
    want = ((x[0].mean(0) - x[1].mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(np.maximum(np.linalg.eigvalsh(half @ b @ half), 0)).sum()
    assert abs(QUERIES["frechet_distance"](spark, sf).head().distance - want) < 1e-6 * max(1, abs(want))


def test_principal_order(spark, sf):
    rows = _table(spark, sf, "embeddings").collect()
    x = np.array([r.embedding for r in rows], float)
    axis = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, -1]
    axis *= np.sign(axis[np.abs(axis).argmax()])
    want = [k for _, k in sorted((round(float(s), 9), r.vec_id) for s, r in zip(x @ axis, rows, strict=True))]
    got = [r.vec_id for r in QUERIES["principal_order"](spark, sf).orderBy("place").collect()]
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 4  # scores that agree to nine digits


def test_greedy_order_is_a_path_of_near_neighbours(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in _table(spark, sf, "embeddings").collect()}
    groups: dict = {}
    for r in QUERIES["greedy_order"](spark, sf).orderBy("place").collect():
        groups.setdefault(r.label, []).append(r.vec_id)
    assert sorted(i for g in groups.values() for i in g) == sorted(vectors)
    mean = lambda ids: np.mean([vectors[a] @ vectors[b] for a, b in zip(ids, ids[1:], strict=False)])
    assert all(mean(g) > mean(sorted(g)) for g in groups.values() if len(g) > 20)


def test_start_positions(spark):
    one = spark.range(1)
    get = lambda n, k, *how: one.select(C.start_positions(one.id + n, k, *how).alias("x")).head().x
    assert get(10, 4, 3) == [3, 6, 8, 0] and get(3, 5) == [0, 1, 2] and get(5, 5, 7) == [2, 3, 4, 0, 1]
    drawn = get(1000, 20, 5, "random", 9)
    assert drawn[0] == 5 and len(set(drawn)) == 20 and all(0 <= d < 1000 for d in drawn) and drawn == get(1000, 20, 5, "random", 9) != get(1000, 20, 5, "random", 8)
    assert sorted(get(6, 9, 0, "random", 1)) == list(range(6))


def test_safe_decode(spark):
    rows = spark.createDataFrame([(b"ok",), (None,)], "b binary")
    assert [r.x for r in rows.select(C.safe_decode(rows.b).alias("x")).collect()] == ["ok", "<unk>"]


def _general(v):
    return "none" if v is None else f"{v:.8g}"


def test_stochastic_tags(spark, sf):
    values = {r.event_id: r.value for r in _table(spark, sf, "events").collect()}
    got = {r.event_id: r.suffix for r in QUERIES["stochastic_tags"](spark, sf).collect()}
    assert got.keys() == values.keys() and len({v for v in got.values() if v}) > 100
    for i, v in values.items():
        low = None if v is None else v / 1000
        window = ("-q0.1_0.9", f"-t{_general(low)}_none", "-wm-full")[i % 3]
        assert got[i] == (f"stoch-ch{_general(v)}-n1.003{window}" if i % 2 == 0 else None)


def test_cache_keys(spark, sf):
    rows = {r.event_id: r for r in _table(spark, sf, "events").collect()}
    given = ["ckpt", "split", "N", "steps", "mb", "sigma_max", "ema", "seed", "sampler"]
    for r in QUERIES["cache_keys"](spark, sf).collect():
        kind, v = rows[r.event_id].event_type, rows[r.event_id].value
        want = [kind, "test", r.event_id, r.event_id % 256, 8, _general(v), 1, 42, "heun"]
        parts = dict(p.split("=", 1) for p in r.key.split("|"))
        assert r.key.startswith("|".join(f"{a}={b}" for a, b in zip(given, map(str, want), strict=True)) + "|term=none|gs=")
        assert parts["gs"] == _general(None if v is None else v / 3)
        assert len(parts) == 22 and all(p == "none" for n, p in parts.items() if n not in (*given, "gs"))
        assert r.path == f"{kind.replace('-', '_')}/test/{hashlib.sha256(r.key.encode()).hexdigest()}/tag.jsonl"


def test_shuffled_similarity(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in _table(spark, sf, "embeddings").collect()}

    def place(i, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        return h - (1 << 64) if h >> 63 else h, i

    means = []
    for seed in (1, 2, 3):
        order = sorted(vectors, key=lambda i: place(i, seed))
        means.append(np.mean([vectors[a] @ vectors[b] for a, b in zip(order, order[1:], strict=False)]))
    got = QUERIES["shuffled_similarity"](spark, sf).head()
    assert abs(got.mean - np.mean(means)) < 1e-6 and abs(got.spread - np.std(means)) < 1e-6


def test_word_vectors_cover_the_vocabulary(spark, sf):
    want = {w for r in _table(spark, sf, "documents").collect() for w in (r.text or "").lower().split()}
    rows = QUERIES["word_vectors"](spark, sf).collect()
    assert len(rows) == len({r.word for r in rows}) and {r.word.lower() for r in rows} == want
    assert all(len(r.vector) == 64 and np.isfinite(r.vector.toArray()).all() for r in rows)


def test_frontier_score_of_known_histograms(spark):
    """Two far clusters, so that the histograms are known: equal ones score 1, disjoint and mixed ones by the formula."""

    def score(first, second):
        place = lambda c, k: [100.0 * c + 0.01 * k, -50.0 * c]
        rows = [(g, place(c, k)) for g, counts in enumerate((first, second)) for c, n in enumerate(counts) for k in range(n)]
        return distributions.frontier_score(spark.createDataFrame(rows, "g int, v array<double>"), "g", "v", 0, 1, clusters=2).head().score

    def formula(first, second):
        p, q = (np.array(c, float) / sum(c) for c in (first, second))
        kl = lambda a, b: sum(x * math.log(x / y) for x, y in zip(a, b, strict=True) if x)
        # From the second group (x = 1) to the first (x = 0): the order of the frontier itself.
        mixed = [w * p + (1 - w) * q for w in (k / 100 for k in range(99, 0, -1))]
        at = [(0.0, 1.0), *((math.exp(-5 * kl(q, r)), math.exp(-5 * kl(p, r))) for r in mixed), (1.0, 0.0)]
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(at, at[1:], strict=False))

    assert abs(score((20, 20), (30, 30)) - 1) < 1e-9
    for pair in (((40, 0), (0, 40)), ((30, 10), (5, 35))):
        assert abs(score(*pair) - formula(*pair)) < 1e-9
    assert formula((40, 0), (0, 40)) < 0.02


def test_frontier_score_takes_clusters_from_the_smaller_group(spark):
    rows = [(g, [10.0 * (k % 3), float(k % 3)]) for g, n in ((0, 30), (1, 90)) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    assert abs(distributions.frontier_score(df, "g", "v", 0, 1).head().score - 1) < 1e-9  # three clusters of a third each
    with pytest.raises(ValueError, match="no vectors"):
        distributions.frontier_score(df, "g", "v", 0, 7)


def test_words_of_like_neighbours_have_like_vectors(spark, monkeypatch):
    """Trained in several parts, none of which is a whole vocabulary; Spark's own model is not asked."""
    from loomstone.operators import word_vectors as V

    monkeypatch.setattr(V, "PART_WORDS", 4000)
    monkeypatch.setattr(V, "STEP", 32)
    rng = np.random.default_rng(2)
    texts = [[f"{'xy'[i % 2]}{k}" for k in rng.integers(0, 8, 30)] for i in range(2000)]
    rows = V.skip_grams(spark.createDataFrame([(t,) for t in texts], "w array<string>"), "w", size=16, rate=0.05).collect()
    unit = {r.word: np.array(r.vector) / np.linalg.norm(r.vector) for r in rows}
    assert len(unit) == len(rows) == 16
    alike = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] == b[0]]
    apart = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] != b[0]]
    assert np.mean(alike) > np.mean(apart) + 0.5
