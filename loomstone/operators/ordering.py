"""Global ranks, vector orderings and their quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.functions.formulas import cosine
from loomstone.operators.durable import Written


def ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the zero-based rank in order of several ascending columns.

    Rows are partitioned by ranges of the order, which Spark samples; counts per partition, one row each, are carried
    over. Ranges come from a stored plan of quantiles of the first numeric column, so a retried task agrees.
    """
    numeric = [c for c, t in df.dtypes if c in order and t in ("int", "bigint", "double", "float", "smallint")]
    cuts: list = []
    if numeric and order.index(numeric[0]) <= 1:
        cuts = sorted(set(df.agg(F.percentile_approx(numeric[0], [k / 64 for k in range(1, 64)], 10000).alias("c")).head()["c"] or []))
    lead = order[: order.index(numeric[0])] if numeric else []
    where = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(numeric[0]))) if cuts else F.lit(0)
    rows = df.withColumn("_range", where)
    totals = rows.groupBy(*lead, "_range").agg(F.count("*").alias("_m"))
    before = W.orderBy(*lead, "_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_skip", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    rows = rows.withColumn("_row", F.row_number().over(W.partitionBy(*lead, "_range").orderBy(*order)) - 1)
    return rows.join(totals, [*lead, "_range"]).withColumn(name, (F.col("_row") + F.col("_skip")).cast("long")).drop("_range", "_row", "_skip")


def adjacent_similarity(df: DataFrame, order: str, vector: str) -> DataFrame:
    """Mean cosine of neighbours in order of a whole-number key.

    Neighbours are found by shifted keys of the rows' places, so that no task holds the table.
    """
    from loomstone.operators.packing import row_numbers

    rows = row_numbers(df.select(order, vector), order, "r")
    nxt = rows.select((F.col("r") - 1).alias("r"), F.col(vector).alias("_next"))
    return rows.join(nxt, "r").agg(F.count("*").alias("n"), F.avg(cosine(F.col(vector), F.col("_next"))).alias("mean"))


def shuffled_similarity(df: DataFrame, key: str, vector: str, seeds: list[int]) -> DataFrame:
    """Mean and spread, over seeded shuffles, of the mean cosine of neighbours."""
    out = None
    for seed in seeds:
        placed = ranks(df.select(key, vector, F.xxhash64(key, F.lit(seed)).alias("h")), ["h", key], "r")
        nxt = placed.select((F.col("r") - 1).alias("r"), F.col(vector).alias("_next"))
        one = placed.join(nxt, "r").agg(F.avg(cosine(F.col(vector), F.col("_next"))).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("spread"))


def principal_order(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Place of every row along the first principal component.

    The covariance is summed in the cluster (``size`` squared numbers come to the driver); the component's sign is
    fixed so that its largest entry is positive. Ties go by key.
    """
    item = lambda i: F.element_at(vector, i + 1).cast("double")
    mean = np.array(df.agg(F.array(*[F.avg(item(i)) for i in range(size)]).alias("m")).head()["m"])
    schema = "i int, row array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    sums = df.select(vector).mapInPandas(partial, schema)
    rows = sums.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(size)]).alias("row")).collect()
    cov = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis *= np.sign(axis[np.abs(axis).argmax()])
    score = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x.cast("double") * a), F.lit(0.0), lambda s, x: s + x)
    return ranks(df.select(key, F.round(score, 9).alias("score")), ["score", key], "place")


def even_starts(n: Column, k: int) -> Column:
    """``k`` places spread evenly over ``n``, rounding halves to even, without repeats."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / max(1, k - 1), 0).cast("long")))


def nearest_path(vectors: np.ndarray, start: int) -> np.ndarray:
    """A path that always goes on to the most similar row not visited yet."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
    left = np.ones(len(unit), bool)
    path = np.empty(len(unit), np.int64)
    at = start
    for k in range(len(unit)):
        path[k], left[at] = at, False
        if k + 1 < len(unit):
            score = unit @ unit[at]
            score[~left] = -np.inf
            at = int(score.argmax())
    return path


def smoothed(unit: np.ndarray, rounds: int = 60) -> np.ndarray:
    """A better order of a piece of a path: its first and last rows stay where they are.

    All reversals of a run are weighed at once by the similarities that they make and break. The best are made together,
    as many as do not touch each other, until none gains anything.
    """
    order = np.arange(len(unit))
    if len(unit) < 4:
        return order
    close = unit @ unit.T
    for _ in range(rounds):
        here = close[np.ix_(order, order)]
        link = np.diagonal(here, 1)
        gain = np.triu(here[:-1, :-1] + here[1:, 1:] - link[:, None] - link[None, :], 2)
        first, last = np.nonzero(gain > 1e-8)
        if not len(first):
            break
        free = np.ones(len(unit), bool)
        for k in np.argsort(-gain[first, last], kind="stable"):
            begin, stop = int(first[k]), int(last[k]) + 1
            if free[begin : stop + 1].all():
                free[begin : stop + 1] = False
                order[begin + 1 : stop] = order[begin + 1 : stop][::-1]
    return order


def _smoothed_path(path: np.ndarray, unit: np.ndarray, window: int) -> np.ndarray:
    path = path.copy()
    for shift in (0, window // 2):
        for begin in range(-shift, len(path), window):
            part = slice(max(0, begin), begin + window)
            path[part] = path[part][smoothed(unit[path[part]])]
    return path


#: Rows of a block whose similarities to another block are held at once, and rows that a task orders by itself.
BLOCK = 4096
#: Fragments of a group that one task joins in the end, and neighbours of a row that rounds of joining look at.
LAST, NEIGHBOURS = 2048, 8


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def nearest_neighbours(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``g, u, v, s``: every row's ``k`` most similar rows of its group, each pair once (``u < v``).

    ``rows`` has ``g, id, v``. All pairs of blocks of a group are compared, each in a task that holds two blocks and gives
    out the best of every row; the best over all blocks are taken by an aggregate of ``k`` a block.
    """
    counts = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = rows.join(counts, "g").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    pairs = dealt.select("g", "id", "v", "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    pairs = pairs.select("g", "id", "v", "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))
    kind = pa.struct([("s", pa.float32()), ("id", pa.int64())])

    def best(close: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        n = min(k, close.shape[1])
        at = np.argpartition(-close, n - 1, axis=1)[:, :n]
        values = pa.StructArray.from_arrays([pa.array(np.take_along_axis(close, at, axis=1).ravel()), pa.array(theirs[at].ravel())], fields=list(kind))
        return mine, pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(mine) + 1, n), pa.int32()), values)

    def compare(part: pa.Table) -> pa.Table:
        place, low, high = (part.column(c).to_numpy() for c in ("_block", "_low", "_high"))
        ids, unit = part.column("id").to_numpy(), _units(part.column("v"))
        one, two = place == low, place == high
        close = unit[one] @ unit[two].T
        if low[0] == high[0]:
            np.fill_diagonal(close, -2)
            found = [best(close, ids[one], ids[two])]
        else:
            found = [best(close, ids[one], ids[two]), best(close.T, ids[two], ids[one])] if one.any() and two.any() else []
        g = part.column("g")[0]
        tables = [pa.table({"g": pa.array([g.as_py()] * len(mine), g.type), "id": mine, "best": near}) for mine, near in found]
        return pa.concat_tables(tables) if tables else pa.table({"g": pa.array([], g.type), "id": pa.array([], pa.int64()), "best": pa.array([], pa.list_(kind))})

    group = rows.schema["g"].dataType.simpleString()
    found = pairs.groupBy("g", "_low", "_high").applyInArrow(compare, f"g {group}, id long, best array<struct<s: float, id: long>>")
    top = found.groupBy("g", "id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, k).alias("best"))
    edges = top.select("g", "id", F.explode("best").alias("e")).where("e.s > -2")
    return edges.select("g", F.least("id", "e.id").alias("u"), F.greatest("id", "e.id").alias("v"), "e.s").distinct()


def _open_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that still lead from an end of one path to an end of another, with the two paths ``fu`` and ``fv``."""
    ends = paths.select("g", "f", F.explode(F.array_distinct(F.array("a", "b"))).alias("r"))
    left, right = ends.select("g", F.col("r").alias("u"), F.col("f").alias("fu")), ends.select("g", F.col("r").alias("v"), F.col("f").alias("fv"))
    return edges.select("g", "u", "v", "s").join(left, ["g", "u"]).join(right, ["g", "v"]).where("fu <> fv").select("g", "u", "v", "s", "fu", "fv")


def _best_of_both(edges: DataFrame) -> DataFrame:
    """``g, f1, f2, u, v``: the edges that are the best of both their paths. A path is in one of them at most, so no circle
    comes about. Among equals a hash decides, so that not all wait for one.
    """
    best = edges.select("g", F.explode(F.array("fu", "fv")).alias("f"), F.struct("s", F.xxhash64("u", "v").alias("h"), "u", "v").alias("e")).groupBy("g", "f").agg(F.max("e").alias("e"))
    return best.groupBy("g", "e").agg(F.min("f").alias("f1"), F.max("f").alias("f2")).where("f1 < f2").select("g", "f1", "f2", "e.u", "e.v")


def _joined(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """Pairs of paths that are joined, with the new path's ends and size, and which of the two are turned around."""
    one = paths.select("g", F.col("f").alias("f1"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("n").alias("n1"))
    two = paths.select("g", F.col("f").alias("f2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    both = chosen.join(one, ["g", "f1"]).join(two, ["g", "f2"])
    mine = F.when((F.col("u") == F.col("a1")) | (F.col("u") == F.col("b1")), F.col("u")).otherwise(F.col("v"))
    both = both.withColumn("x1", mine).withColumn("x2", F.when(F.col("x1") == F.col("u"), F.col("v")).otherwise(F.col("u")))
    turn1, turn2 = F.col("x1") != F.col("b1"), F.col("x2") != F.col("a2")
    return both.select("g", "f1", "f2", "n1", "n2", turn1.alias("turn1"), turn2.alias("turn2"), F.when(turn1, F.col("b1")).otherwise(F.col("a1")).alias("a"), F.when(turn2, F.col("a2")).otherwise(F.col("b2")).alias("b"))


def _last_joins(part: pa.Table) -> pa.Table:
    """Offsets of a group's few paths, one after another: always on to the path with the most similar end."""
    f, n = part.column("f").to_numpy(), part.column("n").to_numpy()
    order = np.argsort(f)
    f, n = f[order], n[order]
    head, tail = _units(part.column("va"))[order], _units(part.column("vb"))[order]
    best = None
    for start in sorted({int(round(x)) for x in np.linspace(0, len(f) - 1, 3)}):
        left, at, turned, total, walk = np.ones(len(f), bool), start, False, 0.0, []
        for _ in range(len(f)):
            walk.append((at, turned))
            left[at] = False
            if left.any():
                end = head[at] if turned else tail[at]
                to_head, to_tail = np.where(left, head @ end, -3), np.where(left, tail @ end, -3)
                a, b = int(to_head.argmax()), int(to_tail.argmax())
                at, turned = (a, False) if to_head[a] >= to_tail[b] else (b, True)
                total += float(max(to_head[a], to_tail[b]))
        if best is None or total > best[0]:
            best = (total, walk)
    at = np.array([k for k, _ in best[1]])
    offset = np.cumsum(n[at]) - n[at]
    return pa.table({"g": part.column("g").combine_chunks().take(pa.array(np.zeros(len(at), np.int64))), "f": f[at], "offset": offset, "turned": np.array([t for _, t in best[1]])})


def _path_of_fragments(rows: DataFrame, block: int, last: int, neighbours: int) -> DataFrame:
    """``g, id, place``: an order of every group's rows (``g, id, v``, stored), joined from fragments in rounds."""
    group = rows.schema["g"].dataType.simpleString()
    paths = Written(rows.select("g", F.col("id").alias("f"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1).cast("long").alias("n")), "paths")
    edges = Written(nearest_neighbours(rows, neighbours, block), "edges")
    rounds: list[Written] = []
    size, most = paths.df.groupBy("g").count().agg(F.sum("count"), F.max("count")).head()
    while most > last:
        edges.replace(_open_edges(paths.df, edges.df))
        chosen = _best_of_both(edges.df)
        made = Written(_joined(chosen, paths.df), "joined")
        gone = made.df.select("g", F.explode(F.array("f1", "f2")).alias("f"))
        paths.replace(paths.df.join(gone, ["g", "f"], "left_anti").unionByName(made.df.select("g", F.col("f1").alias("f"), "a", "b", (F.col("n1") + F.col("n2")).alias("n"))))
        rounds.append(made)
        before = size
        size, most = paths.df.groupBy("g").count().agg(F.sum("count"), F.max("count")).head()
        if before - size < before // 8:  # few neighbours are still ends: look for new ones among the ends
            ends = paths.df.select("g", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
            edges.replace(nearest_neighbours(rows.join(ends, ["g", "id"]), neighbours, block))
    v = lambda end, name: rows.select("g", F.col("id").alias(end), F.col("v").alias(name))
    placed = paths.df.join(v("a", "va"), ["g", "a"]).join(v("b", "vb"), ["g", "b"]).select("g", "f", "n", "va", "vb")
    placed = placed.groupBy("g").applyInArrow(_last_joins, f"g {group}, f long, offset long, turned boolean")
    for k, made in enumerate(reversed(rounds)):
        m = made.df.select("g", F.col("f1").alias("f"), "f2", "n1", "n2", "turn1", "turn2")
        turned = F.col("turned")
        first = F.struct(F.col("f").alias("f"), F.when(turned, F.col("offset") + F.col("n2")).otherwise(F.col("offset")).alias("offset"), (turned != F.col("turn1")).alias("turned"))
        second = F.struct(F.col("f2").alias("f"), F.when(turned, F.col("offset")).otherwise(F.col("offset") + F.col("n1")).alias("offset"), (turned != F.col("turn2")).alias("turned"))
        alone = F.struct("f", "offset", "turned")
        placed = placed.join(m, ["g", "f"], "left").select("g", F.explode(F.when(F.col("f2").isNull(), F.array(alone)).otherwise(F.array(first, second))).alias("p")).select("g", "p.*")
        if k % 6 == 5:
            placed = Written(placed, "placed").df
    placed = Written(placed.select("g", F.col("f").alias("id"), F.col("offset").alias("place")), "placed").df
    for table in (paths, edges, *rounds):
        table.drop()
    return placed


def _smooth_windows(placed: DataFrame, rows: DataFrame, window: int, shift: int) -> DataFrame:
    """``g, id, place`` after the rows of every window of places have been put in a better order, a window a task."""
    group = rows.schema["g"].dataType.simpleString()
    cut = placed.join(rows, ["g", "id"]).withColumn("_w", F.floor((F.col("place") + shift) / window))

    def smooth(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        order = smoothed(_units(part.column("v")))
        return pa.table({"g": part.column("g"), "id": part.column("id").take(pa.array(order)), "place": part.column("place")})

    return cut.groupBy("g", "_w").applyInArrow(smooth, f"g {group}, id long, place long")


def greedy_order(df: DataFrame, group: str, key: str, vector: str, starts: int = 3, window: int = 512, block: int = BLOCK, last: int = LAST, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``group, key, place``: the rows of every group along a path of similar neighbours.

    Groups of up to ``block`` rows are ordered in a task each: the best of several nearest-neighbour paths, smoothed in
    windows. Larger ones never meet in one task: their nearest neighbours are found block by block, rows are joined to
    paths by edges that are the best of both ends, in rounds that each take a good part of the paths, until ``last`` are
    left, whose ends one task strings together; places are then handed down round by round, and overlapping windows
    smoothed in tasks of their own. Rows with a null group or vector are left out; equal keys are rows of their own.
    """
    types = dict(df.dtypes)
    rows = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    counts = rows.groupBy("g").agg(F.count("*").alias("_n"))
    small = rows.join(counts.where(F.col("_n") <= block), "g")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").reset_index(drop=True)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        first = sorted({int(round(s)) for s in np.linspace(0, len(x) - 1, starts)})
        paths = [_smoothed_path(nearest_path(x, s), unit, window) for s in first]
        best = max(paths, key=lambda p: (unit[p[:-1]] * unit[p[1:]]).sum())
        return pd.DataFrame({group: pdf["g"].iloc[best].to_numpy(), key: pdf["k"].iloc[best].to_numpy(), "place": np.arange(len(best))})

    out = small.select("g", "k", "v").groupBy("g").applyInPandas(order, f"`{group}` {types[group]}, `{key}` {types[key]}, place long")
    if counts.where(F.col("_n") > block).isEmpty():
        return out
    large = rows.join(counts.where(F.col("_n") > block), "g").withColumn("_range", F.pmod(F.xxhash64("k"), F.ceil(F.col("_n") / block)))
    number = F.row_number().over(W.partitionBy("g", "_range").orderBy("k"))
    stored = Written(large.select("g", "k", "v", (F.col("_range") * F.lit(1 << 32) + number).alias("id")), "vectors").df
    vectors = stored.select("g", "id", "v")
    placed = _path_of_fragments(vectors, block, last, neighbours)
    for shift in (0, window // 2):
        placed = _smooth_windows(placed, vectors, window, shift)
    named = placed.join(stored.select("g", "id", "k"), ["g", "id"]).select(F.col("g").alias(group), F.col("k").alias(key), "place")
    return out.unionByName(named)
