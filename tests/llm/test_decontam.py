from __future__ import annotations

import random

from loomstone.llm import decontam as D

random.seed(4)
WORDS = ["".join(random.choice("abcdefghijklmnoprstu") for _ in range(random.randint(2, 9))) for _ in range(2000)]


def _text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


ITEMS = [(i, _text(40).capitalize() + ".") for i in range(12)]


def _run(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    return {r.id: r for r in D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_finds_passages_and_leaves_others(spark):
    docs = []
    for i, (item, text) in enumerate(ITEMS):
        w = text.split()
        changed = list(w)
        changed[20] = "other"
        docs += [
            (10 * i, f"{_text(50)} {text} {_text(30)}", "exact"), (10 * i + 1, f"{_text(50)} {text.upper().replace(' ', '  - ')}", "spaced"),
            (10 * i + 2, f"{_text(10)} {' '.join(changed)} {_text(5)}", "one word"), (10 * i + 3, f"{_text(30)} {' '.join(w[5:35])} {_text(5)}", "part"), (10 * i + 4, _text(200), "clean"),
        ]
    got = _run(spark, docs)
    for d, _, kind in docs:
        assert got[d].contaminated == (kind != "clean"), kind
        assert list(got[d].items) == ([] if kind == "clean" else [d // 10])
    start, end = map(int, got[0].spans.split(",")[0].split(":")[1:])
    assert ITEMS[0][1][10:100] in docs[0][1][start:end]


def _distance(a: str, b: str) -> int:
    """Least edits of ``a`` against any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_agrees_with_full_alignment():
    rng = random.Random(9)
    seg = D.cut_segments(ITEMS)
    for _ in range(25):
        item = rng.randrange(12)
        piece = list(D.normalise(D._points(ITEMS[item][1]))[0].tolist())
        text = "".join(map(chr, piece))[: rng.randint(70, 200)]
        chars = list(text)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], ["q"], [chars[k], "z"]])
        whole = f"{_text(12)} {''.join(chars)} {_text(12)}"
        x = D.normalise(D._points(whole))[0]
        flat = "".join(map(chr, x))
        got = {s for s, *_ in D.find_regions(x, seg)}
        want = {s for s in range(len(seg.item)) if _distance("".join(map(chr, seg.text[s][: seg.length[s]])), flat) <= seg.edits[s]}
        assert got == want


def test_defined_cases(spark):
    docs = [(1, None, "a"), (2, "", "b"), (None, ITEMS[0][1], "c"), (3, ITEMS[0][1], "d"), (3, ITEMS[0][1], "d"), (4, "\x00" + ITEMS[1][1] + "\x00", "e")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    rows = D.decontaminate(d, spark.createDataFrame([*ITEMS, (None, _text(30)), (50, None), (51, ""), (52, "tiny")], "item_id long, text string")).collect()
    assert sorted((r.id or 0, r.contaminated) for r in rows) == [(0, True), (1, False), (2, False), (3, True), (3, True), (4, True)]
    assert _run(spark, []) == {}
    assert not _run(spark, [(1, "some text of no interest", "x")], [])[1].contaminated
    assert D.keep_clean(d, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 2


def test_long_texts_of_benchmark_text(spark):
    docs = [(1, " ".join(t for _, t in ITEMS * 40), "x"), (2, _text(60_000), "y")]
    got = _run(spark, docs)
    assert list(got[1].items) == list(range(12)) and not got[2].contaminated


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    got = _run(spark, [(i, f"{_text(20)} {t} {_text(20)}", "x") for i, t in ITEMS])
    assert all(list(got[i].items) == [i] for i, _ in ITEMS)


def test_short_items_match_as_whole_words(spark):
    items = [("a", "Paris"), ("b", "Who wrote it?"), ("c", "four"), ("d", "Paris"), ("e", "  - - ")]
    docs = [(1, "in paris, once", "x"), (2, "parisian or comparis", "x"), (3, "Paris", "x"), (4, "tell me: WHO  wrote -- it", "x"), (5, "who wrote items", "x"), (6, "four", "x"), (7, "x" * 300_000 + " paris " + "y" * 300_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = {r.id: (list(r["items"]), r.spans) for r in D.decontaminate(d, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {
        1: (["a", "d"], "a:3:8,d:3:8"), 2: ([], ""), 3: (["a", "d"], "a:0:5,d:0:5"), 4: (["b"], "b:9:25"), 5: ([], ""), 6: ([], ""), 7: (["a", "d"], "a:300001:300006,d:300001:300006"),
    }


def test_short_items_agree_with_a_plain_search():
    rng = random.Random(3)
    words = ["ab", "abc", "bca", "cab", "aab", "bbbbb", "abcab"]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    seg = D.cut_segments(list(enumerate(items)))
    for _ in range(50):
        text = " ".join(rng.choice(words) for _ in range(30))
        x = D.normalise(D._points(text))[0]
        want = {(i, k, k + len(t)) for i, t in enumerate(items) if 5 <= len(t) < D.LEAST_CHARS for k in range(len(text)) if f" {text} "[k : k + len(t) + 2] == f" {t} "}
        assert set(D.find_short(x, seg)) == want


def test_an_item_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    long = _text(400)
    got = _run(spark, [(1, f"{_text(20)} {long[900:1100]} {_text(20)}", "x"), (2, _text(100), "x")], [(7, long), *ITEMS])
    assert list(got[1]["items"]) == [7] and not got[2].contaminated
