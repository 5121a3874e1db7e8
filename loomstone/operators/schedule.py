"""Noise schedules from measured rates: binned means, gated densities, cumulative tables, inverse lookup.

Tables have one row per bin, a number that is a parameter; windows over them are as small as that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.functions.formulas import gate, log_bin

EPS = 1e-12


def rate_bins(samples: DataFrame, sigma: str, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, lo, hi, mid, n, rate``: mean rate per logarithmic bin, empty bins too.

    Samples that are not finite are left out; levels are clamped to the range; a rate is never negative.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = samples.where(finite(sigma) & finite(metric))
    s = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(sigma)))
    rate = F.greatest(F.col(metric) / (s * s + EPS), F.lit(0.0))
    sums = ok.select(log_bin(s, low, high, bins).alias("bin"), rate.alias("r")).groupBy("bin").agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    width = (math.log(high) - math.log(low)) / bins
    edge = lambda k: F.exp(F.lit(math.log(low)) + k * width)
    spine = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = spine.join(F.broadcast(sums), "bin", "left")  # one row per bin
    n = F.coalesce("n", F.lit(0))
    return rows.select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), edge(F.col("bin") + 0.5).alias("mid"), n.alias("n"), (F.coalesce("total", F.lit(0.0)) / (n + 1e-8)).alias("rate"))


def density(bins: DataFrame, centre: float = 0.1, power: float = 3.0, exponent: float = 1.0) -> DataFrame:
    """``bin, lo, hi, mid, pdf, cdf``: gated rates scaled to one, uniform where they have no positive sum; the
    cumulative table never falls and ends at one."""
    every = W.partitionBy()
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    raw = gate(F.col("mid"), centre, power) * (F.pow("rate", F.lit(exponent)) if exponent else F.lit(1.0))
    rows = bins.withColumn("raw", raw).withColumn("total", F.sum("raw").over(every)).withColumn("k", F.count("*").over(every))
    good = ~F.isnan("total") & (F.col("total") > 0) & (F.col("total") < float("inf"))
    rows = rows.withColumn("pdf", F.when(good, F.col("raw") / F.col("total")).otherwise(1.0 / F.col("k")))
    rows = rows.withColumn("cdf", F.sum("pdf").over(up)).withColumn("cdf", F.max("cdf").over(up))
    return rows.select("bin", "lo", "hi", "mid", "pdf", F.when(F.col("bin") == F.col("k") - 1, 1.0).otherwise(F.col("cdf")).alias("cdf"))


def log_normal_fit(schedule: DataFrame) -> DataFrame:
    """Mean and spread of the logarithm under the density, with a floor on the variance."""
    x, p = F.log(F.greatest("mid", F.lit(EPS))), F.greatest("pdf", F.lit(0.0))
    m = schedule.agg(F.sum(p).alias("t"), F.sum(p * x).alias("a"), F.sum(p * x * x).alias("b"))
    mean = F.col("a") / F.col("t")
    return m.where("t > 0").select(mean.alias("mean"), F.sqrt(F.greatest(F.col("b") / F.col("t") - mean * mean, F.lit(EPS))).alias("spread"))


def _with_previous(schedule: DataFrame) -> DataFrame:
    w = W.orderBy("bin")
    return schedule.select("bin", "lo", "hi", "mid", "cdf", F.lag("cdf").over(w).alias("c0"), F.lag("mid").over(w).alias("m0"))


def quantiles(schedule: DataFrame, probes: DataFrame, u: str, interpolate: bool = True) -> DataFrame:
    """``probes`` with ``sigma``: the level at which the cumulative table reaches ``u``.

    The first bin that reaches it counts; between bins levels are interpolated, or that bin's level is taken. The
    table is broadcast: it has one row per bin.
    """
    t = F.broadcast(_with_previous(schedule))
    u_ = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(u)))
    hit = probes.join(t, (F.col("cdf") >= u_) & (F.col("c0").isNull() | (F.col("c0") < u_)), "left")
    share = (u_ - F.col("c0")) / F.greatest(F.col("cdf") - F.col("c0"), F.lit(1e-20))
    level = F.when(F.col("c0").isNull(), F.col("mid")).otherwise(F.col("m0") + share * (F.col("mid") - F.col("m0"))) if interpolate else F.col("mid")
    return hit.select(*probes.columns, level.alias("sigma"))


def draw(schedule: DataFrame, probes: DataFrame, u: str, v: str, low: float, high: float) -> DataFrame:
    """``probes`` with a level drawn by two given uniform numbers: a bin by the cumulative table, then log-uniform in it."""
    t = F.broadcast(_with_previous(schedule))
    hit = probes.join(t, (F.col("cdf") >= F.col(u)) & (F.col("c0").isNull() | (F.col("c0") < F.col(u))), "left")
    lo, hi = F.log(F.greatest("lo", F.lit(low))), F.log(F.least("hi", F.lit(high)))
    return hit.select(*probes.columns, F.greatest(F.lit(low), F.least(F.lit(high), F.exp(lo + F.col(v) * (hi - lo)))).alias("sigma"))


def _interpolated(knots: DataFrame, x: str, y: str, at: Column, probes: DataFrame, name: str) -> DataFrame:
    """Piecewise linear lookup on a table that is ordered by ``bin``; ends are held."""
    w = W.orderBy("bin")
    t = knots.select("bin", F.col(x).alias("x1"), F.col(y).alias("y1"), F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"))
    ends = knots.agg(F.min(x).alias("xa"), F.max(x).alias("xz"), F.max("bin").alias("bz"))
    t = F.broadcast(t.crossJoin(ends))  # one row per bin
    q = F.greatest(F.col("xa"), F.least(F.col("xz"), at))
    # The first knot that reaches the value; the first interval serves the values at the very start.
    cond = (F.col("x0").isNotNull()) & (((F.col("x1") >= q) & (F.col("x0") < q)) | ((F.col("bin") == 1) & (q <= F.col("x0"))))
    hit = probes.join(t, cond, "left")
    share = (q - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-20))
    return hit.select(*probes.columns, (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias(name))


def truncated_grid(schedule: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """``i, sigma``: ``n`` descending levels, even in cumulative probability between the ends, which are exact.

    The ends are cut to the table; where the table is flat between them, levels are even in the logarithm.
    """
    spark = schedule.sparkSession
    edge = schedule.agg(F.min("mid").alias("a"), F.max("mid").alias("z"), F.min("cdf").alias("c0")).select(F.greatest(F.lit(low), F.col("a")).alias("lo_"), F.least(F.lit(high), F.col("z")).alias("hi_"), "a", "z", "c0")
    ends = _interpolated(schedule, "mid", "cdf", F.col("lo_"), edge, "p0")
    ends = _interpolated(schedule, "mid", "cdf", F.col("hi_"), ends, "p1")
    grid = spark.range(n).select((n - 1 - F.col("id")).cast("int").alias("i"), (F.col("id") / float(max(1, n - 1))).alias("t")).crossJoin(F.broadcast(ends))  # n rows, one row
    u = F.greatest(F.col("c0"), F.least(F.col("p0") + F.col("t") * (F.col("p1") - F.col("p0")), F.lit(1 - 1e-7)))
    out = _interpolated(schedule, "cdf", "mid", u, grid, "inner")
    flat = F.abs(F.col("p1") - F.col("p0")) < EPS
    even = F.exp(F.log("lo_") + F.col("t") * (F.log("hi_") - F.log("lo_")))
    outside = F.greatest(F.least(F.lit(high), F.col("z")), F.col("a"))
    level = (
        F.when(F.col("lo_") > F.col("hi_"), outside).when(F.col("t") == 1.0, F.col("hi_")).when(F.col("t") == 0.0, F.col("lo_"))
        .when(flat, even).otherwise(F.col("inner"))
    )
    return out.select("i", level.alias("sigma"))


def window_bounds(settings: DataFrame, schedule: DataFrame | None, low: float, high: float) -> DataFrame:
    """``settings`` with ``enabled, w_lo, w_hi``: where noise is added.

    ``settings`` has ``mode`` (off, full, fixed, entropy_cdf), ``s_churn, t_lo, t_hi, q_lo, q_hi, fallback``. Without a
    schedule, ``entropy_cdf`` uses its fallback. Inverted bounds are swapped.
    """
    rows = settings.withColumn("_q0", F.least("q_lo", "q_hi")).withColumn("_q1", F.greatest("q_lo", "q_hi"))
    if schedule is not None:
        rows = quantiles(schedule, rows, "_q0").withColumnRenamed("sigma", "_a")
        rows = quantiles(schedule, rows, "_q1").withColumnRenamed("sigma", "_b")
    else:
        rows = rows.withColumn("_a", F.lit(None).cast("double")).withColumn("_b", F.lit(None).cast("double"))
    read = (F.col("mode") == "entropy_cdf") & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    mode = F.when((F.col("mode") != "entropy_cdf") | read, F.col("mode")).otherwise(F.col("fallback"))
    clamp = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    a = F.when(read, F.col("_a")).when(mode == "fixed", F.coalesce("t_lo", F.lit(low))).otherwise(F.lit(low))
    b = F.when(read, F.col("_b")).when(mode == "fixed", F.coalesce("t_hi", F.lit(high))).otherwise(F.lit(high))
    on = mode.isin("full", "fixed", "entropy_cdf") & (F.col("s_churn") > 0)
    return rows.select(*settings.columns, on.alias("enabled"), F.when(on, F.least(clamp(a), clamp(b))).alias("w_lo"), F.when(on, F.greatest(clamp(a), clamp(b))).alias("w_hi"))


def smoothed_minimum(curve: DataFrame, order: str, value: str, taps: int = 5, margin: int = 3) -> DataFrame:
    """The right-most strict local minimum of a moving average with zeros beyond the ends, not within ``margin`` of
    them; else the smallest value (the first of equals). A curve has one row per measured level."""
    w = W.orderBy(order)
    half = taps // 2
    s = curve.select(order, value, (F.sum(value).over(w.rowsBetween(-half, half)) / taps).alias("s"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    s = s.select("*", F.lag("s").over(w).alias("s0"), F.lead("s").over(w).alias("s1"))
    low = (F.col("s") < F.col("s0")) & (F.col("s") < F.col("s1")) & (F.col("i") >= margin) & (F.col("i") < F.col("n") - margin)
    found = s.agg(F.max(F.when(low, F.struct("i", order, "s"))).alias("m"), F.min(F.struct("s", "i", order)).alias("g"))
    pick = lambda f: F.coalesce(F.col(f"m.{f}"), F.col(f"g.{f}"))
    return found.select(pick(order).alias(order), pick("i").alias("i"), pick("s").alias("smoothed"))
