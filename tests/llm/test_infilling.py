from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import infilling as I

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    "hello world", "", None, " ", "\n\n", " lead and tail \t", "has <P> in it " * 5, "a <S>", "<M>", "漢字 かな 🙂 é\xa0ü x  y", "x", "one\ttwo\x0bthree\x0cfour\r\nfive", "w " * 999, "<" * 9 + " <P <S S> M> >", "é" * 3000,
]


def _want(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    u = UNIT.findall(text)
    assert "".join(u) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(u)
    if not text or any(m in text for m in I.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("every", "batch"), [(1, 10), (2, 1 << 23), (64, 200)])
def test_against_plain_python(spark, monkeypatch, every, batch):
    monkeypatch.setattr(I, "BATCH", batch)
    rows = [(i, t, "n!", "o!") for i, t in enumerate(TEXTS * 12)] + [(None, "no id here", "a", "b"), (3, "twice", "a", "b"), (3, "twice", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N string, extra string").repartition(2)
    got = I.fill_in_middle(df, every=every, rate=90).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    for r, w in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _want(w[0], w[1], 90), w
        assert r.back == (w[1] or "") and r.extra == w[3]
    assert got[0].asDict().keys() == {"doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_very_long_text(spark):
    schema = "doc_id long, text string"
    assert I.fill_in_middle(spark.createDataFrame([], schema)).collect() == []
    text = "lorem ipsum é " * 300_000
    for r in I.fill_in_middle(spark.createDataFrame([(k, text) for k in range(4)], schema), rate=100).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _want(r.doc_id, text, 100)


@pytest.mark.parametrize("scan", [1, 4, 1 << 20])
def test_every_cut_by_its_checkpoint(monkeypatch, scan):
    monkeypatch.setattr(I, "SCAN", scan)
    texts = [(t or "").encode() for t in TEXTS]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for every in (1, 3, 64):
        units, points, index = I.count_units(data, bounds, every)
        assert (np.diff(index.bytes) >= 0).all() and (np.diff(index.units) >= 0).all()
        for k, t in enumerate(texts):
            u = UNIT.findall(t.decode())
            assert units[k + 1] - units[k] == len(u)
            for a in range(len(u) + 1):
                place, upto = I.locate(data, index, int(units[k]) + a, int(bounds[k + 1]))
                head = "".join(u[:a])
                assert (place - bounds[k], upto - points[k]) == (len(head.encode()), len(head))


def test_query_matches_its_sql(spark, sf):
    from oracle import connect, differences

    assert differences(I.op11_fill_in_middle(spark, sf), connect(sf), I.ORACLES["op11_fill_in_middle"]) == ([], [])
