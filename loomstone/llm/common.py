"""Shared pieces of the training-data operators: durable tables, row keys, connected components, numpy text hashing."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import scratch

#: White space of the word rule ``[^\x20\x09-\x0D]+``; no other character separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"



#: Tables that results may still read; they go when the driver ends.
_LEFT: set[str] = set()


def _delete(path: str) -> None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is not None and sc._jvm is not None:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    _LEFT.discard(path)


@atexit.register
def _clear() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts lineage with files every executor can read, so a lost executor costs one task at most.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    _LEFT.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_slices(slices: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of all ``slices``, as ``stored``; they are made one after the other, and what is shuffled for one is given
    back before the next."""
    path = None
    for df in slices:
        if path is None:
            path, schema, spark = scratch(df.sparkSession, name), df.schema, df.sparkSession
            _LEFT.add(path)
        else:
            release(spark)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            df._stored_at = None
            _delete(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so when the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words_of(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def running_sums(sizes: Column, block: int = 128) -> Column:
    """Sums of an array of whole numbers up to and with each item, as an array of longs (empty: empty).

    In two levels, blocks and the sums of blocks, so that an array of n items takes about ``block`` times n steps.
    """
    zero = lambda: F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def within(s: Column) -> Column:
        n = F.size(s)
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / block).cast("int")), lambda b: F.slice(s, b * block + 1, F.lit(block)))
        inner = F.transform(cut, lambda part: F.aggregate(part, zero(), step)["out"])
        return F.when(n > 0, F.transform(F.array(inner), across)[0]).otherwise(F.array().cast("array<long>"))

    def across(rows: Column) -> Column:
        upto = F.aggregate(F.transform(rows, lambda r: F.element_at(r, -1)), zero(), step)["out"]
        return F.flatten(F.zip_with(rows, upto, lambda r, u: F.transform(r, lambda x: x + u - F.element_at(r, -1))))

    # Arrays of one, so that what is named is computed once.
    return F.transform(F.array(sizes), within)[0]


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every node that an edge touches; ``component`` is the smallest id reachable.

    Alternates large-star and small-star contraction. Each step is a pre-aggregated minimum and an equi-join, so a
    node with very many neighbours is never gathered in one place, and skewed joins are split by adaptive
    execution. Every round is written to the shared folder. Self-loops and nulls are ignored; an empty edge table
    gives an empty result.
    """
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    current = stored(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _min_neighbour(large)
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = stored(small, "cc")
        discard(current)
        current = after
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before or not state[0]:
            break
        before = state
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out._stored_at = current._stored_at
    return out


# ---------------------------------------------------------------------------------------------------------------
# Word hashing over whole batches of bytes

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=_U)
        out[:1] = 1
        return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all ``texts`` in order, and how many words each text has.

    A word's hash is a polynomial of its bytes, read from prefix sums over the whole batch, then finalised.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    if len(_POWERS[0]) < len(data) + 1:
        _POWERS[0], _POWERS[1] = _powers(len(data) + 1, _BASE), _powers(len(data) + 1, _BASE_INV)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * _POWERS[0][: len(data)], out=prefix[1:])
        raw = (prefix[end] - prefix[start]) * _POWERS[1][start]
        hashes = mix(raw + (end - start).astype(_U) * _U(0xA24BAED4963EE407))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(start, bounds)
    return hashes, np.diff(at)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, sorted within the text, and the sizes of the sets.

    A-Z are lower-cased. A text with fewer words than ``width`` has its whole word sequence as the one shingle; a
    null text or one without words has the empty set.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    hashes, counts = word_hashes(raw)
    n = len(raw)
    owner = np.repeat(np.arange(n), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    place = np.arange(len(hashes)) - first[owner] if len(hashes) else np.zeros(0, np.int64)
    left = counts[owner] - place
    value = np.zeros(len(hashes), _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            shifted = np.zeros(len(hashes), _U)
            shifted[: len(hashes) - k] = hashes[k:] if k else hashes
            inside = left > k
            value = np.where(inside, mix(value * _U(0x9FB21C651E98DF25) + shifted + _U(k + 1)), value)
    keep = (left >= width) | ((counts[owner] < width) & (place == 0))
    value, owner = value[keep], owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[fresh], owner[fresh]
    return value, np.bincount(owner, minlength=n).astype(np.int64)


def pieces(sizes: list[int], budget: int) -> list[tuple[int, int]]:
    """Cut a batch into runs whose sizes add up to about ``budget``, one item at least each."""
    out, begin, total = [], 0, 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > budget:
            out.append((begin, k))
            begin, total = k, 0
        total += size
    if sizes:
        out.append((begin, len(sizes)))
    return out


# ---------------------------------------------------------------------------------------------------------------
# Narrowing a wide table before a join

#: Rows that ``narrowed`` broadcasts at most, whatever the size of the tables; each has 64 bits of a filter.
BUCKETS = 1 << 20


def narrowed(df: DataFrame, key: str, keys: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be in ``keys`` (or, with ``inside`` false, the rows whose key is surely not).

    Decided by a filter of ``64 * BUCKETS`` bits (67 million), of which the words that have a bit set are broadcast: at
    most ``BUCKETS`` rows of two numbers. It saves moving wide rows that a join would drop, as long as the keys are
    fewer than the bits (10 % of others pass at 7 million keys); beyond that more rows are moved, with the same result.
    The two halves make up ``df``; a null key is surely not among the keys.
    """
    hashed = F.xxhash64(F.col(key), F.lit(11))
    word, bit = F.pmod(hashed, F.lit(BUCKETS)), F.shiftrightunsigned(hashed, 58).cast("int")
    set_ = keys.where(F.col(key).isNotNull()).select(word.alias("__ls_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__ls_bit"))
    hit = F.broadcast(set_.groupBy("__ls_word").agg(F.bit_or("__ls_bit").alias("__ls_bits")))
    tagged = df.withColumn("__ls_word", F.when(F.col(key).isNotNull(), word))
    may = F.coalesce(F.getbit("__ls_bits", bit) == 1, F.lit(False))
    return tagged.join(hit, "__ls_word", "inner" if inside else "left").where(may if inside else ~may).select(*df.columns)


def groups_of(batches, key: int = 0):
    """Arrow tables of one key value each, from batches sorted by their column ``key``."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        begin = 0
        if held and held[-1].column(key)[0].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for cut in cuts:
            held.append(batch.slice(begin, cut - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                self.parent = q
                return q
            p = q
