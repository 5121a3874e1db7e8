from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from loomstone.llm import hostrules as H

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = " ".join(f"word{k}" for k in range(60))
POOR = "too few words"


def _want(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(again), len(lines)


def test_measures():
    texts = [None, "", " \n ", "a a a", "a a a a", "a b c a b c d", "x\nx\n\n y\n y\nx ", "# é\xa0漢字 *$%&|<> q", "a\x0bb\x0cc\rd\te", "n " * 300, GOOD, "a b c d a b c e a b"]
    for t in texts:
        assert H.measures((t or "").encode()) == _want(t), t


def _judged(spark, rows, schema="doc_id long, text string, source string", **how):
    return sorted(H.judge_documents(spark.createDataFrame(rows, schema), **how).collect(), key=lambda r: (-1 if r.id is None else r.id))


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(i, GOOD if i % 20 else POOR, f"good{i % 4}") for i in range(200)]
    rows += [(1000 + i, GOOD if i % 5 == 0 else POOR, "bad") for i in range(50)]
    rows += [(2000, POOR, "tiny"), (2001, GOOD, "tiny"), (2002, GOOD, None), (None, GOOD, "good0"), (2003, None, "good1"), (2004, "", None)]
    for r in _judged(spark, rows):
        few = r.n_words < 50
        assert r.base_failed == few and r.host_rejected == (r.host == "bad") and r.kept == (not few and r.host != "bad")


def test_rules_that_count_on_suspect_hosts_only(spark):
    noisy = GOOD + " ###### ******"
    rows = [(i, noisy if i % 2 else GOOD, "noisy") for i in range(100)] + [(1000 + i, noisy if i == 0 else GOOD, "clean") for i in range(100)]
    got = {r.id: r for r in _judged(spark, rows)}
    assert all(got[i].kept == (i % 2 == 0) for i in range(100)) and all(got[1000 + i].kept for i in range(100))
    assert not any(r.base_failed or r.host_rejected for r in got.values())


def test_shrinking_follows_the_prior(spark):
    """Rates of a rule against the same moments worked out in Python; a small host is drawn further than a large one."""
    counts = {"a": (40, 4), "b": (100, 60), "c": (2, 2), "d": (30, 0), "e": (500, 100)}
    rows = [(k, POOR if k < bad else GOOD, h) for h, (n, bad) in counts.items() for k in range(n)]
    measured = H.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.host: r for r in H.host_rates(measured, "source").where("rule = 'few_words'").collect()}
    k, total, bad = len(counts), sum(n for n, _ in counts.values()), sum(b for _, b in counts.values())
    p, z = bad / total, sum(b * b / n for n, b in counts.values())
    within, each = (bad - z) / (total - k), (total - sum(n * n for n, _ in counts.values()) / total) / (k - 1)
    w = min(H.MOST_WEIGHT, max(H.LEAST_WEIGHT, each * within / ((z - total * p * p) / (k - 1) - within)))
    assert {h: r.rate for h, r in got.items()} == {h: round((b + p * w) / (n + w), 9) for h, (n, b) in counts.items()}
    assert got["c"].rate < 1 and abs(got["e"].rate - 0.2) < 0.01


def test_one_host_none_and_empty(spark):
    assert _judged(spark, []) == []
    assert [r.kept for r in _judged(spark, [(1, GOOD, "a"), (2, POOR, None)])] == [True, False]
    assert [r.kept for r in _judged(spark, [(1, GOOD, None)])] == [True]
    assert [(r.id, r.kept) for r in _judged(spark, [(5, GOOD, "a"), (5, GOOD, "a")])] == [(5, True)] * 2


def test_many_hosts_are_joined_by_shuffling(spark, monkeypatch):
    rows = [(i, GOOD if i % 3 == 0 else POOR, f"h{i % 7}") for i in range(140)] + [(1000 + i, GOOD, f"g{i % 5}") for i in range(100)]
    want = _judged(spark, rows)
    monkeypatch.setattr(H, "BROADCAST", 0)
    assert _judged(spark, rows) == want and any(r.host_rejected for r in want)


def test_clashing_names_and_long_text(spark):
    schema = "doc_id long, text string, source string, n_words string, host string, kept string, rule string, id string, rejected string"
    rows = [(1, "word other thing " * 100_000, "a", *"xxxxxx"), (2, GOOD, "a", *"xxxxxx")]
    one, two = _judged(spark, rows, schema)
    assert (one.n_words, one.n_repeat_words, one.base_failed) == (300_000, 300_000, True) and two.n_words == 60


def test_hosts_of_urls(spark):
    df = spark.createDataFrame([("https://A.Example.com/x?y",), ("no url",), (None,)], "u string")
    assert [r.h for r in df.select(H.host_of(F.col("u")).alias("h")).collect()] == ["a.example.com", None, None]


def test_query_matches_its_sql(spark, sf):
    from oracle import connect, differences

    assert differences(H.op12_host_rules(spark, sf), connect(sf), H.ORACLES["op12_host_rules"]) == ([], [])
