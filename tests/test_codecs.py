from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from loomstone.functions import codecs as C

M = 15


def test_gray_round_trip(spark):
    rows = spark.range(1 << 16).select("id", C.to_gray(F.col("id")).alias("g")).select("id", "g", C.from_gray(F.col("g")).alias("b"), F.bit_count(F.col("g").bitwiseXOR(C.to_gray(F.col("id") + 1))).alias("step"))
    assert rows.where("id <> b or step <> 1").count() == 0


def test_bits_round_trip(spark):
    rows = spark.range(3000).select(F.array(F.col("id"), F.col("id") * 7 % 32768, F.lit(0).cast("long")).alias("ids"))
    back = rows.select("ids", C.bits_tokens(C.sequence_bits(F.col("ids"), M), M).alias("back"))
    assert back.where("ids <> back").count() == 0


def test_width_of_vocabularies(spark):
    got = spark.createDataFrame([(1,), (2,), (3,), (8,), (9,), (65536,), (65537,)], "v int").select("v", C.bits_for(F.col("v")).alias("b")).collect()
    assert [(r.v, r.b) for r in got] == [(1, 1), (2, 1), (3, 2), (8, 3), (9, 4), (65536, 16), (65537, 17)]


def test_single_flips_are_corrected_and_double_flips_flagged(spark):
    tokens = [0, 1, 5, 12345, 32767]
    flips = [(i,) for i in range(21)] + list(itertools.combinations(range(21), 2))
    rows = [(t, len(f), sum(1 << b for b in f)) for t in tokens for f in [(), *flips]]
    df = spark.createDataFrame(rows, "t long, n int, mask long").select("t", "n", C.secded_decode(C.secded_encode(F.col("t"), M).bitwiseXOR(F.col("mask")), M).alias("r")).select("t", "n", "r.*")
    assert df.where("n = 0 and (data <> t or corrected <> 0 or uncorrectable)").count() == 0
    assert df.where("n = 1 and (data <> t or corrected <> 1 or uncorrectable)").count() == 0
    assert df.where("n = 2 and not uncorrectable").count() == 0


def test_parity_sizes():
    assert [C.parity_size(m) for m in (1, 4, 5, 11, 12, 15, 16, 26)] == [2, 3, 4, 4, 5, 5, 5, 5]


def test_stopped_codes(spark):
    df = spark.createDataFrame([([5, 6, 0, 7],), ([5, 2, 0],), ([],), ([9, 99, -1, 8],)], "ids array<int>")
    got = [r.s for r in df.select(C.stop_codes(F.col("ids"), 0, 2, 10, 99).alias("s")).collect()]
    assert [(list(s.kept), s.hit_pad, s.hit_end, s.stop, s.n_invalid, s.n_unknown) for s in got] == [([5, 6], 1, 0, 2, 0, 0), ([5], 0, 1, 1, 0, 0), ([], 0, 0, -1, 0, 0), ([9, 99, 8], 0, 0, -1, 1, 1)]


def test_edges_lose_one_mark_each(spark):
    df = spark.createDataFrame([([0, 0, 1, 0, 2, 0, 0],), ([0],), ([],), ([1],)], "ids array<int>")
    assert [list(r.x) for r in df.select(C.strip_edges(F.col("ids"), 0).alias("x")).collect()] == [[0, 1, 0, 2, 0], [], [], [1]]


def test_finished_codes(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4],), ([],)], "ids array<int>")
    assert [list(r.x) for r in df.select(C.finish_codes(F.col("ids"), 9, 0, 4).alias("x")).collect()] == [[1, 2, 9, 0], [1, 2, 3, 9], [9, 0, 0, 0]]


def test_private_text_keeps_a_first_byte_order_mark(spark):
    """Id 7935 is U+FEFF, which decoders of UTF-32 take off the start of a text."""
    rows = spark.createDataFrame([([7935, 5],), ([7935, 7935],), ([5, 7935],), ([7935],), ([],)], "ids array<long>").select("ids", C.private_text(F.col("ids"), 0xE000).alias("t"))
    got = rows.select("ids", "t", C.private_ids(F.col("t"), 0xE000, 32768).alias("back")).collect()
    assert all(r.back == r.ids and r.t == "".join(chr(0xE000 + i) for i in r.ids) for r in got)


def test_words_of_an_array_are_decoded_like_single_ones(spark):
    """Every word of 10 bits, with none to all of them flipped; the plan makes a word's syndrome once."""
    from loomstone.functions import codecs

    words = F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long"))
    one = spark.range(1).select(F.transform(words, lambda w: codecs.secded_decode(w, 5)).alias("d")).head()["d"]
    out = spark.range(1).select(codecs.secded_ids(words, 5, 77, 17).alias("ids"))
    assert out.head()["ids"] == [77 if r["uncorrectable"] else r["data"] % 17 for r in one]
    tokens = F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))
    whole = spark.range(1).select(codecs.secded_words(tokens, 5).alias("a"), F.transform(tokens, lambda t: codecs.secded_encode(t, 5)).alias("b"), F.transform(tokens, lambda t: codecs.from_gray(codecs.to_gray(t), 5)).alias("c")).head()
    assert whole.a == whole.b and whole.c == list(range(32))
    column = spark.range(1).select(codecs.secded_ids(F.array("id"), 5, 77, 17).alias("ids"))
    assert column._jdf.queryExecution().analyzed().toString().count("getbit") <= 4
