from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

from loomstone.llm import alignment as A

SCHEMA = "doc_id long, text string, chunk string"


def _brute(texts):
    """Everything token by token: ends as sets, groups by walking, counts by dictionaries."""
    a, b = A.byte_level(f"{A.TOKENIZERS}/byte_bpe_50k.json"), A.pieces_of(f"{A.TOKENIZERS}/piece_bpe_32k.model")
    rows, counts = [], Counter()
    for text in texts:
        sides = []
        for side in (a, b):
            ids = side.encode([text])[0] if text else []
            parts = [side.tokens[i] for i in ids]
            sides.append((ids, list(itertools.accumulate(map(len, parts))), b"".join(parts)))
        if not text or any(s[2] != (" " + text).encode() for s in sides):
            rows.append((0, 0, [], []))
            continue
        (ia, ea, _), (ib, eb, _) = sides
        shared = sorted(set(ea) & set(eb))
        groups = []
        low = 0
        for end in shared:
            groups.append((",".join(str(i) for i, e in zip(ia, ea, strict=True) if low < e <= end), ",".join(str(i) for i, e in zip(ib, eb, strict=True) if low < e <= end)))
            low = end
        pairs = [(x, y) for x, ex in zip(ia, ea, strict=True) for y, ey in zip(ib, eb, strict=True) if ex == ey]
        counts.update(pairs)
        rows.append((len(ia), len(ib), groups, pairs))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for n_a, n_b, groups, pairs in rows:
        text = ";".join(f"{x}|{y}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return out


def _run(df, **how):
    from pyspark.sql import functions as F

    from loomstone.llm.common import stored

    found = stored(A.align_tokens(df, **how).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups"), "t")
    pairs = A.chunk_pairs(found)
    rows = A.score_links(found, pairs, A.count_pairs(pairs)).collect()
    return sorted((-1 if r.id is None else r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in rows)


TEXTS = [
    "hello world", "", None, " ", "\n\n\t x", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ low line", "漢字とかな 🙂🙂 é é ﬁ", "a" * 500, "word " * 700, "\x00\x01 control", "  many   spaces ",
    "tail \n", "1234567890 3.14", "Ünïcödé – dash", "  separators \xa0", "x", "<P>", "é̂ stacked",
]


@pytest.mark.parametrize("chunk", [40, 1 << 22])
def test_against_token_by_token(spark, chunk):
    texts = [*TEXTS, *TEXTS[:3]]
    rows = [(None if i == 4 else i % 19, t, "x") for i, t in enumerate(texts)]
    want = sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, _brute(texts), strict=True))
    assert _run(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk) == want


def test_whole_table_against_token_by_token(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *w) for r, w in zip(rows, _brute([r.text for r in rows]), strict=True))
    got = A.op13_token_alignment(spark, sf).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert all(w[1] and w[3] for w in want if w[7])


def test_byte_alphabet_gives_back_every_byte():
    assert sorted(A._byte_of().values()) == list(range(256)) and A.decoded_bytes("Ġa") == b" a" and A.decoded_bytes("Ċ") == b"\n"


def test_both_ways_of_encoding_agree():
    """Random texts over settled characters of every kind, and texts that only the library itself encodes."""
    from tokenizers import Tokenizer

    path = f"{A.TOKENIZERS}/byte_bpe_50k.json"
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    quick, settled = A._by_ranks(path), A._settled()
    rng = np.random.default_rng(5)
    chars = [chr(c) for c in np.flatnonzero(settled)]
    common = [c for c in chars if c < "\u0250"] + list(" \n\t'") * 40 + ["'s", "'ll", "<|endoftext|>"] * 10
    texts = ["".join(rng.choice(pool, int(rng.integers(1, 60)))) for pool in (chars, common) for _ in range(3000)] + ["".join(chars[k : k + 500]) for k in range(0, len(chars), 500)]
    assert quick is not None and len(chars) > 40_000 and all(A._within(settled, t) for t in texts)
    for t in texts:
        assert quick(f" {t}") == slow.encode(f" {t}", add_special_tokens=False).ids, t
    assert not A._within(settled, "a \U0001f600") and not A._within(settled, "\u0378")
    side = A.byte_level(path)
    assert side.encode(["a \U0001f600", "b"]) == [slow.encode(f" {t}", add_special_tokens=False).ids for t in ("a \U0001f600", "b")]


def test_links_of_repeated_ends():
    ends, a, b = A.links(np.array([2, 2, 5, 7]), np.array([2, 4, 7, 7, 7]))
    assert ends.tolist() == [2, 7] and list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (3, 2), (3, 3), (3, 4)]
    ends, a, b = A.overlaps(np.array([2, 5]), np.array([3, 5]))
    assert list(zip(ends.tolist(), a.tolist(), b.tolist(), strict=True)) == [(2, 0, 0), (3, 1, 0), (5, 1, 1)]
    assert [len(x) for x in A.links(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_random_ends_against_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        a, b = (np.sort(np.append(rng.integers(1, n + 1, int(rng.integers(0, 12))), n)) for _ in range(2))
        ends, x, y = A.links(a, b)
        assert ends.tolist() == sorted(set(a) & set(b))
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]


def test_empty_table_and_very_long_text(spark):
    assert _run(spark.createDataFrame([], SCHEMA)) == []
    long = "lorem ipsum dolor, " * 60_000
    row = _run(spark.createDataFrame([(1, long, "x"), (2, "lorem", "x")], SCHEMA))[0]
    assert row[1] > 100_000 and row[7] and row[3] == row[4]


def test_places_of_four_bytes(spark, monkeypatch):
    monkeypatch.setattr(A, "NARROW", 12)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    want = sorted((r[0], *w) for r, w in zip(rows, _brute(TEXTS), strict=True))
    for chunk in (30, 1 << 22):
        assert _run(spark.createDataFrame(rows, SCHEMA), chunk=chunk) == want
