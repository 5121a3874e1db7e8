"""Merges learned in rounds of many, against merging one pair at a time."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstone.operators import merges
from test_values import _merged


def _docs(spark, words: Counter):
    return spark.createDataFrame([([w] * n,) for w, n in words.items()], "w array<string>")


def _learned(spark, words, n, **how):
    return [(r["left"], r["right"], r.n) for r in merges.learn_merges(_docs(spark, words), F.col("w"), n, **how).orderBy("rank").collect()]


def _words(letters: str, n: int, seed: int) -> Counter:
    rng = random.Random(seed)
    return Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize(("letters", "pairs", "symbols"), [("ab", 3, 40), ("abc", 6, 300), ("abcdefgh", 5, 60), ("abcdefgh", 1 << 16, 1 << 22), ("aé漢🙂", 9, 200)])
def test_small_rounds_give_the_merges_of_one_at_a_time(spark, letters, pairs, symbols):
    """Few letters make runs of one symbol and many ties."""
    words = _words(letters, 120, len(letters))
    want = _merged(words, 60)
    assert _learned(spark, words, 60, pairs=pairs, most_symbols=symbols) == want


def test_rounds_in_memory_over_many_tables():
    """One round that sees all pairs, over tables of every kind, without Spark. Where a symbol may be there already, the
    round may end early, but merges nothing else."""
    import pyarrow as pa

    shorter = 0

    for seed in range(60):
        words = _words("abcd"[: 1 + seed % 4], 5 + seed, seed)
        pairs: Counter = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] += n
        table = pa.table({"symbols": pa.array([list(w) for w in words], pa.list_(pa.string())), "n": pa.array(list(words.values()), pa.int64())})
        run = lambda symbols: merges._merge_round(table, {p: n for p, n in pairs.items() if n > 1}, (-2, "\U0010ffff", ""), symbols, 200, 3)  # noqa: E731, B023
        want = _merged(words, 200)
        assert run(set()) == want
        some = run({a + b for k, (a, b, _) in enumerate(want) if k % 3 == 1})
        assert some == want[: len(some)] and bool(some) == bool(want)
        shorter += len(some) < len(want)
    assert shorter > 10


def test_warm_merges_of_any_number_are_one_pass(spark):
    words = _words("abcdef", 300, 3)
    first = _merged(words, 80)
    warm = [(a, b) for a, b, _ in first[:50]]
    assert _learned(spark, words, 30, warm=warm, pairs=20, most_symbols=500) == first[50:]
    many = [(chr(97 + k % 26), chr(97 + k // 26 % 26)) for k in range(676)] * 4
    rows = _docs(spark, words).select(F.explode("w").alias("x")).distinct().select("x", merges.encode_words(F.split("x", ""), many).alias("e")).collect()
    assert len(rows) == len(words) and all("".join(r.e) == r.x and max(map(len, r.e)) <= 2 for r in rows)


def test_symbols_follow_the_order_of_merges():
    places = merges._places([("b", "c"), ("a", "b"), ("a", "bc"), ("bc", "d"), ("a", "b")])
    assert merges._merged(list("abcd"), places) == ["abc", "d"]
    assert merges._merged(list("aab"), places) == ["a", "ab"]
    assert merges._merged(list("aaaaa"), merges._places([("a", "a"), ("aa", "aa")])) == ["aaaa", "a"]
    # A symbol made in a second way is not joined by a merge that came before.
    assert merges._merged(list("abcd"), merges._places([("ab", "c"), ("abc", "d"), ("b", "c"), ("a", "bc")])) == ["abc", "d"]


def test_words_without_pairs(spark):
    assert _learned(spark, Counter({"a": 5, "b": 1}), 10) == [] and _learned(spark, Counter({"ab": 1}), 10) == []


def test_far_fewer_rounds_than_merges(spark, sf, monkeypatch):
    rounds = []
    apply = merges._apply
    monkeypatch.setattr(merges, "_apply", lambda words, made: rounds.append(len(made)) or apply(words, made))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = Counter(w for r in docs.collect() for w in (r.text or "").lower().split())
    got = _learned(spark, words, 400, pairs=200, most_symbols=20_000)
    assert got == _merged(words, 400) and len(rounds) < 20


def test_a_grown_vocabulary_keeps_its_old_entries(spark, sf):
    from loomstone.plans.registry import QUERIES

    row = QUERIES["grown_vocabulary"](spark, sf).head()
    assert (row.n_changed, row.n_missing) == (0, 0) and 1000 < row.n_old <= 6000 and row.n_old <= row.n_new <= 9000


def test_finished_words_leave_the_rounds(spark):
    """A word of one symbol has no pairs: the next round does not carry it, and the merges stay the same."""
    from loomstone.operators import merges as M

    words = spark.createDataFrame([(["a", "b"], 5), (["c"], 9), (["a", "b", "d"], 3)], "symbols array<string>, n long")
    first = M._apply(words, [("a", "b")])
    assert sorted(map(tuple, (r.symbols for r in first.collect()))) == [("ab",), ("ab", "d")]
    assert [r.symbols for r in M._apply(first, [("x", "y")]).collect()] == [["ab", "d"]]
    got = [(r.left, r.right, r.n) for r in M.learn_merges(words, None, 5, pairs=1).orderBy("rank").collect()]
    assert got == [("a", "b", 8), ("ab", "d", 3)]
