from __future__ import annotations

import random

import numpy as np
import tiktoken

from loomstone.llm import tokens as K

SCHEMA = "doc_id long, text string, n_tokens string"


def test_counts_match_the_tokenizer(spark):
    rows = [(i, t, "x") for i, t in enumerate(["hello world", "", None, "a" * 3000, "<|endoftext|> inside", "é ü 漢字 " * 50, *["lorem ipsum " * k for k in range(40)]])]
    rows += [(None, "no id", "x"), (7, "twice", "x"), (7, "twice", "x")]
    enc = tiktoken.Encoding("t", pat_str=K._piece_pattern(), mergeable_ranks=K.read_ranks(), special_tokens={})
    want = sorted((-1 if i is None else i, len(enc.encode_ordinary(t or ""))) for i, t, _ in rows)
    for block in (5, 64, 1 << 18):
        got = K.count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
        assert sorted((-1 if r.id is None else r.id, r.n_tokens) for r in got) == want
    assert K.count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stitching_of_random_blocks(spark):
    random.seed(2)
    rows, want = [], []
    for file in range(6):
        ids = [9 if random.random() < (0.02, 0.3, 0.9)[file % 3] else random.randrange(5) for _ in range(random.choice([0, 1, 40, 200]))]
        run, docs = 0, []
        for x in ids:
            if x == 9:
                docs.append((run, True))
                run = 0
            else:
                run += 1
        docs += [(run, False)] if run else []
        want += [(file, k, n, c) for k, (n, c) in enumerate(docs)]
        rows += [(file, b, b"".join(x.to_bytes(2, "little") for x in ids[8 * b : 8 * b + 8])) for b in range(-(-len(ids) // 8))]
    rows += [(99, 0, b""), (98, 0, None)]
    got = K.scan_separators(spark.createDataFrame(rows, "file int, block int, payload binary").repartition(4), 9).collect()
    assert sorted((r.file, r.ordinal, r.n_tokens, r.closed) for r in got) == want


def test_raw_files(spark, tmp_path):
    for name, ids in (("a.bin", [1, 2, 9, 9, 3]), ("b.bin", [])):
        (tmp_path / name).write_bytes(b"".join(x.to_bytes(2, "little") for x in ids))
    blocks = K.read_flat(spark, [f"{tmp_path}/a.bin", f"{tmp_path}/b.bin"], block=2)
    assert sorted((r.file, r.ordinal, r.n_tokens, r.closed) for r in K.scan_separators(blocks, 9).collect()) == [(0, 0, 2, True), (0, 1, 0, True), (0, 2, 1, False)]


def test_ranges_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGE", 3)
    test_stitching_of_random_blocks(spark)


def test_a_large_raw_file_is_read_block_by_block(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 100_003).astype("<u2")
    (tmp_path / "c.bin").write_bytes(ids.tobytes() + b"\x01")
    blocks = K.read_flat(spark, [f"{tmp_path}/c.bin"], block=1000)
    assert sorted((r.block, len(r.payload)) for r in blocks.collect()) == [(b, 2000) for b in range(100)] + [(100, 6)]
    at = np.flatnonzero(ids == 7)
    want = np.diff(np.concatenate(([-1], at))) - 1
    got = sorted((r.ordinal, r.n_tokens) for r in K.scan_separators(blocks, 7).collect() if r.closed)
    assert got == list(enumerate(want.tolist()))


def test_very_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "lorem ipsum " * 200_000, "a", "b", "c")], "doc_id long, text string, file string, block string, ids string")
    enc = tiktoken.Encoding("t", pat_str=K._piece_pattern(), mergeable_ranks=K.read_ranks(), special_tokens={})
    assert K.count_tokens(df, block=1 << 12).head().n_tokens == len(enc.encode_ordinary("lorem ipsum " * 200_000))
