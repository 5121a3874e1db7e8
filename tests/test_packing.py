from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomstone.operators import packing as P


def _rows(spark, lengths):
    return spark.createDataFrame([(k * 3 + 1, list(range(100 * k, 100 * k + n))) for k, n in enumerate(lengths)], "id long, ids array<int>")


def _stream(lengths, boundary):
    out, first = [], True
    for k, n in enumerate(lengths):
        if n:
            out += ([] if first or boundary is None else [boundary]) + list(range(100 * k, 100 * k + n))
            first = False
    return out


def test_blocks_hold_the_stream(spark):
    for lengths in ([3, 0, 5, 9, 1, 1, 30], [8], [7], [9], [0]):
        for boundary in (-1, None):
            stream = _stream(lengths, boundary)
            df = _rows(spark, lengths)
            whole = {r.seq_id: list(r.ids) for r in P.pack_between(df, "id", 8, boundary).collect()}
            assert whole == {k: stream[8 * k : 8 * k + 8] for k in range(len(stream) // 8)}
            padded = {r.seq_id: list(r.ids) for r in P.pack_between(df, "id", 8, boundary, -2).collect()}
            flat = [x for k in sorted(padded) for x in padded[k]]
            assert flat[: len(stream)] == stream and set(flat[len(stream) :]) <= {-2} and all(len(v) == 8 for v in padded.values())
            s = P.stream_statistics(df, 8, boundary is not None).head()
            assert (s.n_tokens, s.n_whole, s.n_begun, s.dropped_tail, s.padded_tail) == (len(stream), len(stream) // 8, -(-len(stream) // 8), len(stream) % 8, -len(stream) % 8)


def test_wrapped_blocks(spark):
    lengths = [3, 0, 5, 9, 1]
    stream = [x for k, n in enumerate(lengths) if n for x in [*range(100 * k, 100 * k + n), 7]]
    got = {r.seq_id: list(r.ids) for r in P.pack_wrapped(_rows(spark, lengths), "id", 6, 1, 2).collect()}
    assert got == {k: [1, *stream[4 * k : 4 * k + 4], 2] for k in range(len(stream) // 4)} or got == {k: [1, *[2 if x == 7 else x for x in stream[4 * k : 4 * k + 4]], 2] for k in range(len(stream) // 4)}


def test_shards_are_even(spark):
    for n, w in ((10, 3), (7, 7), (3, 5), (100, 7)):
        sizes = [r["count"] for r in P.even_shards(spark.range(n), "id", w).groupBy("shard").count().orderBy("shard").collect()]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_split_rounds_halves_to_even(spark):
    assert P.split_by_position(spark.range(10), "id", 0.25).where("split = 'val'").count() == 2
    assert P.split_by_position(spark.range(3), "id", 0.01).where("split = 'val'").count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, ids array<int>")
    assert P.pack_between(empty, "id", 8, 0).count() == 0
    assert P.running_total(empty, "id", F.size("ids")).count() == 0


def test_vocabulary_order(spark):
    docs = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "w array<string>")
    assert [(r.word, r.n, r.id) for r in P.vocabulary(docs, F.col("w"), 2, 5).orderBy("id").collect()] == [("a", 2, 5), ("b", 2, 6)]


def test_words_are_looked_up_a_few_rows_at_a_time():
    """Of a large batch the codes of few rows are held at once; null rows and words, slices and order are kept."""
    rows = [None, [], ["a", None, "x"], *([["b", "a"]] * 1000), ["x"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows) + 1)), pa.array([["a"]] + rows)], names=["id", "w"]).slice(1)
    out = list(P._looked_up(iter([batch]), "id", pa.array(["a", "b"]), np.array([5, 6], np.int32), 1))
    assert max(b.num_rows for b in out) <= 64
    got = [r for b in out for r in b.to_pylist()]
    assert [r["id"] for r in got] == list(range(1, len(rows) + 1))
    assert [r["ids"] for r in got] == [[], [], [5, 1, 1], *([[6, 5]] * 1000), [1]]
