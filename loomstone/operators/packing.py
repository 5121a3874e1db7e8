"""Token sequences: vocabularies, encoding, packing into blocks, splits, shards and resumption.

Positions in a corpus-wide stream come from a two-level prefix sum: rows are ordered within ranges of their key, and
only one total per range meets in one place. Ranges are at most ``RANGES``, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 4096
#: Rows whose words a worker looks up at a time.
LOOKED_UP = 64


def running_total(df: DataFrame, order: str, amount: Column, name: str = "start") -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before, in order of a whole-number key without repeats.

    The key is cut at approximate quantiles into at most ``RANGES`` ranges, so keys that lie close together in places
    fill them evenly; windows run within ranges, and the totals of the ranges (a table of that size) are added up and
    joined back by broadcast. The cuts read the key alone, the totals the key and the amount.
    """
    parts = min(RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = sorted(set(df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts).alias("c")).head()["c"] or []))
    rows = df.withColumn("_amount", amount.cast("long")).withColumn("_range", _place(F.col(order), cuts))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(F.sum("_amount").alias("_total")).select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return rows.join(F.broadcast(totals), "_range").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_range", "_amount", "_inside", "_offset")


def _place(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are smaller than ``value``, by halving."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(cuts)) & (F.try_element_at(array, n + s) < value), n + s).otherwise(n))


def row_numbers(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """``df`` with the zero-based place of every row in order of a whole-number key."""
    return running_total(df, order, F.lit(1), name)


def within_budget(df: DataFrame, order: str, size: str, most_rows: int, budget: int) -> DataFrame:
    """Rows in order until ``most_rows`` are taken or sizes before a row reach ``budget``; with ``before``."""
    counted = row_numbers(running_total(df, order, F.col(size), "before"), order, "_row")
    return counted.where((F.col("_row") < most_rows) & (F.col("before") < budget)).drop("_row")


def vocabulary(docs: DataFrame, words: Column, size: int, reserved: int = 0) -> DataFrame:
    """``word, n, id`` of the ``size`` most frequent words, ids by count (largest first), then word."""
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    return top.select("word", "n", (F.row_number().over(W.orderBy(F.desc("n"), "word")) - 1 + reserved).cast("int").alias("id"))


def encode(docs: DataFrame, key: str, words: Column, vocab: DataFrame, unknown: int) -> DataFrame:
    """``key, ids``: word ids in order, ``unknown`` for words outside the vocabulary. Documents without words have no ids.

    Words are looked up within their row, in Arrow batches, so no token is moved. The vocabulary travels with the tasks:
    its size is a parameter of ``vocabulary``.
    """
    known = vocab.select("word", "id").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(known["word"], pa.string()), known["id"].to_numpy(np.int32)))
    rows = docs.select(key, words.alias("_words"))
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(lambda batches: _looked_up(batches, key, *shared.value, unknown), schema)


def _looked_up(batches: Iterator[pa.RecordBatch], key: str, names: pa.Array, ids: np.ndarray, unknown: int) -> Iterator[pa.RecordBatch]:
    """Ids of batches of words, ``LOOKED_UP`` rows at a time: a worker holds a batch of Spark's and the codes of few rows."""
    for whole in batches:
        for begin in range(0, whole.num_rows, LOOKED_UP):
            batch = whole.slice(begin, LOOKED_UP)
            lists = batch.column(1)
            found = pc.index_in(lists.flatten(), value_set=names)
            at = found.fill_null(-1).to_numpy(zero_copy_only=False)
            codes = np.where(at >= 0, ids[np.maximum(at, 0)] if len(ids) else unknown, unknown).astype(np.int32)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))], names=[key, "ids"])


def _once(encoded: DataFrame) -> DataFrame:
    """Non-empty rows, encoded once: cuts, totals and rows all read what is kept."""
    return encoded.where(F.size("ids") > 0).persist(StorageLevel.MEMORY_AND_DISK)


def _cut(pieces: DataFrame, length: int) -> DataFrame:
    """Cut runs ``start, run`` of the stream into blocks and put each block together from its runs."""
    end = F.col("start") + F.size("run")
    spread = pieces.where(F.size("run") > 0).select("start", "run", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))).alias("seq_id"))
    first = F.greatest(F.col("seq_id") * length - F.col("start"), F.lit(0))
    last = F.least((F.col("seq_id") + 1) * length - F.col("start"), F.size("run").cast("long"))
    parts = spread.select("seq_id", F.struct((F.col("start") + first).alias("at"), F.slice("run", (first + 1).cast("int"), (last - first).cast("int")).alias("part")).alias("p"))
    return parts.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("ids"))


def pack_between(encoded: DataFrame, key: str, length: int, boundary: int | None, pad: int | None = None) -> DataFrame:
    """``seq_id, ids``: the stream of all non-empty examples with ``boundary`` between them (never first), in blocks
    of ``length``. The tail is dropped, or filled up with ``pad`` where one is given."""
    full = _once(encoded)
    if boundary is not None:
        placed = running_total(full.select(key, "ids"), key, F.size("ids") + 1)
        run = F.when(F.col("start") == 0, F.col("ids")).otherwise(F.concat(F.array(F.lit(boundary)), F.col("ids")))
        placed = placed.select(F.greatest(F.col("start") - 1, F.lit(0)).alias("start"), run.alias("run"))
    else:
        placed = running_total(full.select(key, "ids"), key, F.size("ids")).select("start", F.col("ids").alias("run"))
    blocks = _cut(placed, length)
    if pad is None:
        return blocks.where(F.size("ids") == length)
    return blocks.select("seq_id", F.concat("ids", F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size("ids"), F.lit(0)))).alias("ids"))


def flat_stream(encoded: DataFrame, key: str, end: int) -> DataFrame:
    """``key, start, run``: the stream with ``end`` after every non-empty document, the last one too."""
    full = _once(encoded).select(key, F.concat("ids", F.array(F.lit(end))).alias("run"))
    return running_total(full, key, F.size("run"))


def pack_wrapped(encoded: DataFrame, key: str, length: int, begin: int, end: int) -> DataFrame:
    """Blocks of ``length`` with a begin and an end mark around pieces of the flat stream; the tail is dropped."""
    inner = length - 2
    blocks = _cut(flat_stream(encoded, key, end).select("start", "run"), inner).where(F.size("ids") == inner)
    return blocks.select("seq_id", F.concat(F.array(F.lit(begin)), "ids", F.array(F.lit(end))).alias("ids"))


def stream_statistics(encoded: DataFrame, length: int, boundary: bool) -> DataFrame:
    """Tokens with boundaries, whole and begun blocks, dropped and padded tails, in one aggregation."""
    n, m = F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)), F.count(F.when(F.size("ids") > 0, 1))
    total = n + (F.greatest(m - 1, F.lit(0)) if boundary else F.lit(0))
    out = encoded.agg(total.cast("long").alias("n_tokens"), m.cast("long").alias("n_examples"))
    t = F.col("n_tokens")
    return out.select("n_tokens", "n_examples", F.floor(t / length).alias("n_whole"), F.ceil(t / length).alias("n_begun"), (t % length).alias("dropped_tail"), F.pmod(-t, F.lit(length)).alias("padded_tail"))


def split_by_position(df: DataFrame, order: str, share: float) -> DataFrame:
    """``df`` with ``split``: the last ``max(1, round(n * share))`` rows are ``val``, rounding halves to even."""
    counted = row_numbers(df, order, "_row")
    n = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    held = F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("long"))
    return counted.crossJoin(n).withColumn("split", F.when(F.col("_row") >= F.col("_n") - held, "val").otherwise("train")).drop("_row", "_n")


def even_shards(df: DataFrame, order: str, shards: int) -> DataFrame:
    """``df`` with ``shard``: consecutive rows, the first shards one longer where it does not come out even."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    rows = row_numbers(df, order, "_row").crossJoin(n)
    size, extra = F.floor(F.col("_n") / shards), F.col("_n") % shards
    head = extra * (size + 1)
    shard = F.when(F.col("_row") < head, F.floor(F.col("_row") / (size + 1))).otherwise(extra + F.floor((F.col("_row") - head) / F.greatest(size, F.lit(1))))
    return rows.withColumn("shard", shard.cast("int")).drop("_row", "_n")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    return row_numbers(df, order, "_row").withColumn("batch", F.floor(F.col("_row") / size)).drop("_row")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with a place in a shuffle that depends on key and seed only (ascending hash, then key)."""
    return df.withColumn("place", F.xxhash64(key, F.lit(seed)))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has finished."""
    return rows.join(done.select(key), key, "left_anti")


def task_given(task: Column, pos: Column, text: int, speaker: int, prefix: int) -> Column:
    """Places that a task is given in ``[text | speaker | speech]``."""
    return (
        F.when(task == "text_to_speech", pos < text + speaker).when(task == "speech_to_text", pos >= text)
        .when(task == "continuation", (pos >= text) & (pos < text + speaker + prefix)).otherwise(F.lit(False))
    )


# Where the parts of the multimodal vocabulary begin, and its pads.
TEXT_OFFSET, SPEAKER_OFFSET, SPEECH_OFFSET, TEXT_PAD, SPEECH_PAD = 0, 200_019, 204_115, 250_771, 250_772


def join_modalities(text: Column, speaker: Column, speech: Column, n_text: int = 168, n_speech: int = 800) -> Column:
    """One sequence of shifted ids: text and speech cut or filled up, the speaker between them."""
    shift = lambda a, by: F.transform(a, lambda x: x + by)
    fill = lambda a, pad, n: F.slice(F.concat(a, F.array_repeat(F.lit(pad), n)), 1, n)
    return F.concat(fill(shift(text, TEXT_OFFSET), TEXT_PAD, n_text), shift(speaker, SPEAKER_OFFSET), fill(shift(speech, SPEECH_OFFSET), SPEECH_PAD, n_speech))


def text_part(ids: Column, n_text: int = 168) -> Column:
    return F.filter(F.slice(ids, 1, n_text), lambda x: x != TEXT_PAD)


def speech_part(ids: Column, begin: int = 200) -> Column:
    """Speech codes without pads, clamped to zero from below."""
    return F.transform(F.filter(F.slice(ids, F.lit(begin + 1), F.greatest(F.size(ids) - begin, F.lit(0))), lambda x: x != SPEECH_PAD), lambda x: F.greatest(x - SPEECH_OFFSET, F.lit(0)))
