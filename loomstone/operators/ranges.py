"""Exact quantiles of groups of any size, and lookups of values between edges of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.operators.durable import Written
from loomstone.operators.ordering import ranks

#: Buckets that an interval is cut into, and intervals that are broadcast at most (four short columns each).
BUCKETS, BROADCAST = 4096, 100_000


def percentiles(rows: DataFrame, value: str, by: list[str], points: list[float]) -> DataFrame:
    """``by, point, value``: exact percentiles (shares from 0 to 1) of every group, interpolated between neighbours.

    A rank is looked for by histograms: an interval that holds it is cut into ``BUCKETS``, counted with the least and most
    value of each, and the bucket of the rank is the next interval, until it holds one value only. An interval becomes
    thousands of times narrower each pass, so a handful of passes end for numbers of usual spread (nine for any doubles);
    no task holds more of a group than its buckets. Missing values and those that are not finite are left out; a group
    without others has no rows.
    """
    clean = rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    sizes = Written(clean.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in points])))
    state = Written(sizes.df.select(*by, F.explode(wanted).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below")), "ranks")
    key = [*by, "_lo", "_hi"]
    same = lambda left, right, columns: [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    while not state.df.where("_lo < _hi").isEmpty():
        open_ = state.df.where("_lo < _hi")
        intervals = open_.select(*key, "_below").distinct()
        side = F.broadcast(intervals) if intervals.limit(BROADCAST + 1).count() <= BROADCAST else intervals.hint("merge")
        inside = clean.alias("a").join(side.alias("b"), [*same("a", "b", by), F.col("a._v") >= F.col("b._lo"), F.col("a._v") <= F.col("b._hi")]).select("b.*", "a._v")
        # The difference of two large doubles may not be finite, that of the halves of small ones may be nothing.
        scale = F.when(F.greatest(F.abs("_lo"), F.abs("_hi")) < 1e300, F.lit(1.0)).otherwise(F.lit(0.5))
        part = (F.col("_v") * scale - F.col("_lo") * scale) / (F.col("_hi") * scale - F.col("_lo") * scale)
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(part * BUCKETS).cast("int"))
        counted = inside.groupBy(*key, "_below", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        before = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # at most BUCKETS rows
        counted = counted.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
        found = open_.alias("a").join(counted.alias("b"), [*same("a", "b", key), F.col("a._k") >= F.col("b._from"), F.col("a._k") < F.col("b._from") + F.col("b._c")])
        found = found.select(*[F.col(f"a.{c}").alias(c) for c in by], "a._k", F.col("b._min").alias("_lo"), F.col("b._max").alias("_hi"), F.col("b._from").alias("_below"))
        state.replace(state.df.where("_lo >= _hi").unionByName(found))
    asked = sizes.df.select(*by, "_n", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")).withColumn("_at", F.col("point") * (F.col("_n") - 1))
    value_at = lambda name: state.df.select(*by, F.col("_k").alias(name), F.col("_lo").alias(f"{name}_v"))
    asked = asked.withColumns({"_f": F.floor("_at"), "_c": F.ceil("_at")})
    for name in ("_f", "_c"):
        side = value_at(name)
        asked = asked.alias("a").join(side.alias("b"), same("a", "b", [*by, name])).select("a.*", f"b.{name}_v")
    weight = F.col("_at") - F.col("_f")
    return asked.select(*by, "point", (F.col("_f_v") * (1 - weight) + F.col("_c_v") * weight).alias("value"))


def place_between(rows: DataFrame, value: str | Column, edges: DataFrame, edge: str, ranges: int = 256, each: int = 1 << 20) -> DataFrame:
    """``rows`` with ``edge`` and ``bin``: the largest edge below the value and its place among all edges from 0 on (null and -1
    for values up to the first edge, and for null values).

    Edges may be any, and too many to broadcast. Both sides are cut into the same ranges at quantiles of the edges; a range
    is sorted once with its edges in between, and every row takes the edge before it, so no row is compared with more than
    that. A range of more than ``each`` rows is dealt to several tasks, each with all its edges; equal values, however many,
    are spread like others. Edges are taken once each, missing ones are none.
    """
    clean = Written(ranks(edges.select(F.col(edge).cast("double").alias("_e")).where("_e IS NOT NULL").distinct(), ["_e"], "_bin"), "edges").df
    cuts = sorted(set(clean.agg(F.percentile_approx("_e", [k / ranges for k in range(ranges)], 10_000).alias("c")).head()["c"] or []))
    array = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    x = F.col(value) if isinstance(value, str) else value
    plain = rows.withColumn("_x", x.cast("double")).withColumn("_range", F.size(F.filter(array, lambda c: c < F.col("_x"))))
    sizes = plain.groupBy("_range").agg(F.ceil(F.count("*") / each).cast("int").alias("_tasks"))  # one row a range
    plain = plain.join(F.broadcast(sizes), "_range").withColumn("_task", F.floor(F.rand(7) * F.col("_tasks")).cast("int"))
    marks = clean.withColumn("_range", F.size(F.filter(array, lambda c: c <= F.col("_e")))).join(F.broadcast(sizes), "_range")
    marks = marks.select("_range", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"), F.col("_e").alias("_x"), "_e", "_bin")
    names = rows.columns
    both = plain.select("_range", "_task", "_x", F.struct(*[F.col("`" + c + "`") for c in names]).alias("_row")).unionByName(marks, allowMissingColumns=True)
    # At equal values rows come before edges, so that an edge is below its row.
    before = W.partitionBy("_range", "_task").orderBy(F.col("_x").asc_nulls_first(), F.col("_row").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = both.select("_row", F.last("_e", True).over(before).alias("edge"), F.last("_bin", True).over(before).alias("bin")).where("_row IS NOT NULL")
    return placed.select("_row.*", "edge", F.coalesce("bin", F.lit(-1)).cast("long").alias("bin"))
