"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on random directions; a table's bucket is the tuple of quantised projections. Two
vectors of one label that share a bucket in any table are compared by exact cosine. A pair counts in the first table
in which it meets, so links are counted once without pairs being written out. Which table that is, workers find out by
hashing linked vectors again: projections are sums of whole numbers, the same on every machine and in every order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import Forest, connected_components, discard, mix, partitions, stored
from loomstone.session import table

#: The width of a quantisation step. A pair at cosine 0.98 is 0.2 apart and shares a step with probability 0.900; a
#: pair at right angles does so with probability 0.409.
STEP, SHARED, FAR = 1.6, 0.900, 0.409
#: Share of pairs at the threshold that may meet in no table.
MISSED = 1e-4
#: Rows of a bucket that are compared in one task; a larger bucket is compared block by block.
BLOCK = 2048

_U = np.uint64


def hash_choice(n: int) -> tuple[int, int]:
    """Projections of a bucket and tables for labels of ``n`` vectors at most: so many projections that about one pair
    in ``n`` at right angles shares a bucket, so many tables that a pair at the threshold is missed with ``MISSED``."""
    projections = min(48, max(6, math.ceil(math.log(max(n, 2)) / -math.log(FAR))))
    return projections, math.ceil(math.log(MISSED) / math.log1p(-(SHARED**projections)))


@lru_cache(maxsize=8)
def _directions(dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions as whole numbers of up to 20 bits (65536ths), a column each, and shifts."""
    rng = np.random.default_rng([dim, 20251])
    whole = np.rint(np.clip(rng.standard_normal((count, dim)), -15, 15) * 65_536)
    return np.ascontiguousarray(whole.T), np.random.default_rng([dim, 20252]).uniform(0, STEP, count)


def bucket_keys(x: np.ndarray, salt: np.ndarray, projections: int, tables: int, first: int | None = None) -> np.ndarray:
    """``[row, table]`` bucket keys of the rows of ``x`` in the ``first`` tables (none given: in all); ``salt`` tells
    labels apart.

    Components and directions are whole numbers so small that all sums stay below 2^53: floating-point numbers hold them
    exactly, and a vector has the same keys in whatever company it is hashed.
    """
    wide = math.ceil(math.log2(max(x.shape[1], 2)))
    first = tables if first is None else first
    a, b = _directions(x.shape[1], projections * tables)
    a, b = a[:, : first * projections], b[: first * projections]
    x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 2.0 ** ((52 - wide) // 2))
    scale = 2.0 ** min(20, 32 - wide)
    unit = np.rint(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * scale)
    steps = np.floor((unit @ a / (scale * 65_536) + b) / STEP).astype(np.int64).view(_U).reshape(len(x), first, projections)
    key = mix(salt.astype(np.int64).view(_U) + _U(x.shape[1]))[:, None] ^ mix(np.arange(1, first + 1, dtype=_U))[None, :]
    with np.errstate(over="ignore"):
        for k in range(projections):
            key = mix(key * _U(0x9FB21C651E98DF25) + steps[:, :, k])
    return key.view(np.int64)


def _usable(v: Column, label: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return np.matmul(x, np.swapaxes(y, -1, -2)) / (np.sqrt((x * x).sum(-1))[..., :, None] * np.sqrt((y * y).sum(-1))[..., None, :]) >= least


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows scaled by their largest component, so that squares neither overflow nor vanish."""
    flat = column.combine_chunks()
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.where((top > 1e-100) & (top < 1e100), x, x / top)


def _first_met(x: np.ndarray, salt: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """Whether rows ``a`` and ``b`` share no bucket of a table before ``at``; only these rows are hashed again."""
    before = int(at.max(initial=0))
    if not before:
        return np.ones(len(a), bool)
    fresh = np.empty(len(a), bool)
    for begin in range(0, len(a), 65_536):
        part = slice(begin, begin + 65_536)
        rows, place = np.unique(np.concatenate((a[part], b[part])), return_inverse=True)
        keys = np.concatenate([bucket_keys(x[rows[i : i + 4096]], salt[rows[i : i + 4096]], projections, tables, before) for i in range(0, len(rows), 4096)])
        n = len(a[part])
        for i in range(0, n, 4096):
            u, v = place[:n][i : i + 4096], place[n:][i : i + 4096]
            same = (keys[u] == keys[v]) & (np.arange(before)[None, :] < at[part][i : i + 4096, None])
            fresh[begin + i : begin + i + len(u)] = ~same.any(axis=1)
    return fresh


class _Tally:
    def __init__(self, ids: np.ndarray, weight: np.ndarray):
        self.ids, self.weight = ids, weight
        self.links, self.forest = np.zeros(len(ids), np.int64), Forest(len(ids))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count linked pairs that have met in no earlier table."""
        np.add.at(self.links, a, self.weight[b])
        np.add.at(self.links, b, self.weight[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if self.forest.parent[i] != self.forest.parent[j]:
                self.forest.union(i, j)


def _compare(least: float, projections: int, tables: int):
    schema = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        side, at, salt = (rows.column(i).to_numpy() for i in (1, 2, 6))
        x = _matrix(rows.column(5))
        tally = _Tally(rows.column(3).to_numpy(), rows.column(4).to_numpy())
        within = side[0] < 0
        left, right = (np.arange(len(x)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for begin in range(0, len(left), 512):
            part = left[begin : begin + 512]
            a, b = np.nonzero(_linked(x[part], x[right], least))
            a, b = part[a], right[b]
            if within:
                a, b = a[a < b], b[a < b]
            if len(a):
                fresh = _first_met(x, salt, a, b, at[a], projections, tables)
                tally.add(a[fresh], b[fresh])
        return _report(tally)

    def _report(tally: _Tally) -> pa.RecordBatch | None:
        roots, hit = tally.forest.roots(), tally.links > 0
        if not hit.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(tally.ids[hit]), pa.array(tally.links[hit]), pa.array(tally.ids[roots[hit]])], schema=schema)

    def small(rows: pa.Table, starts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        """All groups of one small size at once."""
        for begin in range(0, len(starts), max(1, 8192 // size)):
            at = (starts[begin : begin + max(1, 8192 // size), None] + np.arange(size)).ravel()
            part = rows.take(pa.array(at))
            x = _matrix(part.column(5))
            x = x.reshape(-1, size, x.shape[1])
            g, a, b = np.nonzero(np.triu(_linked(x, x, least), 1))
            if not len(g):
                continue
            a, b = g * size + a, g * size + b
            ids, weight = part.column(3).to_numpy(), part.column(4).to_numpy()
            fresh = _first_met(x.reshape(-1, x.shape[2]), part.column(6).to_numpy(), a, b, part.column(2).to_numpy()[a], projections, tables)
            a, b = a[fresh], b[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[a], ids[b]))), pa.array(np.concatenate((weight[b], weight[a]))), pa.array(np.concatenate((ids[a], ids[a])))], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = rows.column(0).to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            sizes = np.diff(cut)
            dims = rows.column(7).to_numpy()[cut[:-1]]
            for size, dim in {*zip(sizes.tolist(), dims.tolist(), strict=True)}:
                which = (sizes == size) & (dims == dim)
                if 1 < size <= 16:
                    whole = rows.column(1).to_numpy()[cut[:-1]] < 0
                    yield from small(rows, cut[:-1][which & whole], size)
                    which = which & ~whole
                if size > 1:
                    for c in cut[:-1][which]:
                        if (out := group(rows.slice(int(c), int(size)))) is not None:
                            yield out

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = rows.column(0).to_numpy()
            last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if last:
                yield from settle(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return compare


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int | None = None) -> DataFrame:
    """One row per input row: ``id, n_links, component``.

    Two rows are linked when their labels are equal and not null and their cosine, in double precision, is at least
    ``least``; ``component`` is the smallest id reachable. Equal vectors of a label are one class from the start, so
    copies cost nothing; a class is named by 128 bits. A vector may have any length. Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different length; a null id is larger than all ids; repeated rows are
    linked with each other; an empty table gives an empty result; other columns are not looked at.
    """
    most = block or BLOCK
    # Floats stay floats where they are moved; they are compared in double precision.
    kind = "array<float>" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    usable = _usable(F.col("v"), F.col("label"))
    rows = rows.withColumn("k", F.when(usable, F.xxhash64("label", "v"))).withColumn("k2", F.when(usable, F.xxhash64(F.lit(1), "label", "v")))
    named = stored(rows.select("id", "k", "k2"), "vector-names")
    classes = rows.where("k is not null").groupBy("k", "k2").agg(F.count("*").alias("m"), F.first("v").alias("v"), F.first(F.xxhash64("label")).alias("salt"))
    classes = classes.select(F.monotonically_increasing_id().alias("c"), "m", "v", "salt", "k", "k2")  # numbered once: they are stored below
    widest = vectors.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    projections, tables = hash_choice(widest)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                x = lists.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(which), -1)
                for begin in range(0, len(which), 4096):
                    keys[which[begin : begin + 4096]] = bucket_keys(x[begin : begin + 4096], batch.column(3).to_numpy()[which[begin : begin + 4096]], projections, tables)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["c", "m", "v", "salt", "k", "k2", "keys"])

    classes = stored(classes.mapInArrow(hashed, f"c long, m long, v {kind}, salt long, k long, k2 long, keys array<long>"), "vector-classes")
    places = classes.select("c", F.posexplode("keys").alias("at", "bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    dealt = places.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("size") / most).cast("int"))
    own = F.pmod(F.xxhash64("c", F.lit(3)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A task compares block i with block j > i, sides 0 and 1, or one block within itself, side -1.
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(pair).alias("g"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "at", "c")
    dealt = stored(dealt, "vector-buckets")
    n = partitions(vectors.sparkSession)
    payload = dealt.join(classes.select("c", "m", "v", "salt"), "c").select("g", "side", "at", "c", "m", "v", "salt", F.size("v").alias("dim")).repartition(n, "g").sortWithinPartitions("g")
    met = stored(payload.mapInArrow(_compare(least, projections, tables), "c long, links long, root long"), "vector-links")

    groups = connected_components(met.select(F.col("c").alias("src"), F.col("root").alias("dst")))
    linked = groups.withColumnRenamed("id", "c").withColumnRenamed("component", "root")
    counts = met.groupBy("c").agg(F.sum("links").alias("links"))
    by_class = classes.select("c", "k", "k2", "m").join(counts, "c", "left").join(linked, "c", "left").select("k", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"))
    placed = stored(named.join(by_class, ["k", "k2"], "left"), "vector-placed")
    tops = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("component"))
    discard(named, classes, dealt, met, groups)
    return placed.where("root is not null").join(tops, "root").select("id", "n_links", "component").unionByName(placed.where("root is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


_SQL = """
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN counts USING (vec_id)"""

QUERIES = {"op10_near_vectors": op10_near_vectors}
ORACLES = {"op10_near_vectors": _SQL}
