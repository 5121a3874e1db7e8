"""Joins, picks, sets and ordered shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.operators.packing import RANGES, _place


def ordered_shards(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``df`` with ``shard``: even runs in order of any columns.

    The first column is cut at approximate quantiles into at most ``RANGES`` ranges; ranks are counted within ranges
    and carried over by the ranges' totals, so no task sorts the table.
    """
    first = order[0]
    parts = min(RANGES, max(1, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    cuts = df.agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 10000).alias("c")).head()["c"] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    rows = df.withColumn("_range", _place(F.col(first), cuts))
    totals = rows.groupBy("_range").agg(F.count("*").alias("_m"))
    every = W.partitionBy()
    totals = totals.select("_range", F.coalesce(F.sum("_m").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_skip"), F.sum("_m").over(every).alias("_n"))
    rows = rows.withColumn("_row", F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1).join(F.broadcast(totals), "_range")  # at most RANGES rows
    row, size, extra = F.col("_row") + F.col("_skip"), F.floor(F.col("_n") / shards), F.col("_n") % shards
    head = extra * (size + 1)
    shard = F.when(row < head, F.floor(row / (size + 1))).otherwise(extra + F.floor((row - head) / F.greatest(size, F.lit(1))))
    return rows.withColumn("shard", shard.cast("int")).drop("_range", "_row", "_skip", "_n")


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group in an order, by a pre-aggregated minimum instead of a sort of the group.

    Orders must be ascending columns of comparable types; the last of them should be unique.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r"))
    return best.select(*keys, "_r.*")


def held_out_pick(samples: DataFrame, speaker: str, seconds: str, order: str, least: float) -> DataFrame:
    """One sample per speaker: the shortest of those of at least ``least`` seconds, else the longest; ties go to the
    first in order."""
    d = F.col(seconds)
    return pick_first(samples, [speaker], [(d < least), F.when(d >= least, d).otherwise(-d), F.col(order)])


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Every value once, with the place of its first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which a null key equals a null key."""
    l, r = left.alias("l"), right.alias("r")
    return l.join(r, reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]), how)


def merge_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows, and new rows whose key no old row has, the first of each key in order; columns are united."""
    first = pick_first(new, keys, [F.col(order)])
    fresh = null_safe(first, existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def kept_by_improvement(saves: DataFrame, order: str, metric: str, k: int) -> DataFrame:
    """The ``k`` best of the saves that improved strictly on all before them (smaller is better).

    One training run is one ordered series; its improvements are found by a running minimum.
    """
    before = F.min(metric).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    better = saves.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(metric) < F.col("_before"))).drop("_before")
    return better.orderBy(metric, order).limit(k)
