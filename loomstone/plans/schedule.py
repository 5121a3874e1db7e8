"""Schedules from measured rates, grids and closed formulas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomstone.functions import formulas as M
from loomstone.operators import schedule as S
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()
LOW, HIGH, K = 0.002, 80.0, 16
_W = f"((ln({HIGH}) - ln({LOW})) / {K})"


def _samples(spark, sf):
    return table(spark, sf, "events").select((F.lit(1e-3) + F.abs("value")).alias("sigma"), (F.col("event_id") % 97).cast("double").alias("metric"))


def _schedule(spark, sf):
    return S.density(S.rate_bins(_samples(spark, sf), "sigma", "metric", LOW, HIGH, K))


_BINS = f"""smp AS (SELECT greatest({LOW}, least({HIGH}, 1e-3 + abs(value))) AS s, (event_id % 97)::DOUBLE AS m FROM events),
agg AS (SELECT greatest(0, least(ceil((ln(s) - ln({LOW})) / {_W})::INT - 1, {K - 1})) AS bin, sum(greatest(m / (s * s + 1e-12), 0)) AS total, count(*) AS n FROM smp GROUP BY 1),
bins AS (SELECT b.bin::INT AS bin, exp(ln({LOW}) + b.bin * {_W}) AS lo, exp(ln({LOW}) + (b.bin + 1) * {_W}) AS hi, exp(ln({LOW}) + (b.bin + 0.5) * {_W}) AS mid, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0) / (coalesce(n, 0) + 1e-8) AS rate FROM (SELECT unnest(range(0, {K})) AS bin) b LEFT JOIN agg USING (bin))"""
_DENSITY = f"""{_BINS}, raw AS (SELECT *, pow(mid / 0.1, 3) / (1 + pow(mid / 0.1, 3)) * rate AS raw FROM bins),
sch AS (SELECT bin, lo, hi, mid, raw / sum(raw) OVER () AS pdf, CASE WHEN bin = {K - 1} THEN 1.0::DOUBLE ELSE sum(raw) OVER (ORDER BY bin) / sum(raw) OVER () END AS cdf FROM raw),
prev AS (SELECT *, lag(cdf) OVER (ORDER BY bin) AS c0, lag(mid) OVER (ORDER BY bin) AS m0 FROM sch)"""


@plans.add("rate_bins", f"WITH {_BINS} SELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, round(mid, 9) AS mid, n, round(rate, 6) AS rate FROM bins")
def rate_bins(spark, sf):
    b = S.rate_bins(_samples(spark, sf), "sigma", "metric", LOW, HIGH, K)
    return b.select("bin", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "mid")], "n", F.round("rate", 6).alias("rate"))


@plans.add("noise_schedule", f"WITH {_DENSITY} SELECT bin, round(mid, 9) AS mid, round(pdf, 9) AS pdf, round(cdf, 9) AS cdf FROM sch")
def noise_schedule(spark, sf):
    return _schedule(spark, sf).select("bin", *[F.round(c, 9).alias(c) for c in ("mid", "pdf", "cdf")])


@plans.add("log_normal_fit", f"WITH {_DENSITY}, m AS (SELECT sum(pdf * ln(mid)) / sum(pdf) AS mean FROM sch) SELECT round(any_value(mean), 6) AS mean, round(sqrt(greatest(sum(pdf * pow(ln(mid) - mean, 2)) / sum(pdf), 1e-12)), 6) AS spread FROM sch, m")
def log_normal_fit(spark, sf):
    return S.log_normal_fit(_schedule(spark, sf)).select(F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@plans.add("schedule_quantiles", f"WITH {_DENSITY}, q AS (SELECT i, i / 20.0 AS u FROM (SELECT unnest(range(0, 21)) AS i)) SELECT i, round(CASE WHEN c0 IS NULL THEN mid ELSE m0 + (u - c0) / greatest(cdf - c0, 1e-20) * (mid - m0) END, 7) AS smooth, round(mid, 7) AS stepped FROM q JOIN prev ON cdf >= u AND (c0 IS NULL OR c0 < u)")
def schedule_quantiles(spark, sf):
    """Levels at 21 quantiles, interpolated and by bin."""
    sch = _schedule(spark, sf)
    q = spark.range(21).select(F.col("id").alias("i"), (F.col("id") / 20.0).alias("u"))
    a = S.quantiles(sch, q, "u").withColumnRenamed("sigma", "smooth")
    return S.quantiles(sch, a, "u", interpolate=False).select("i", F.round("smooth", 7).alias("smooth"), F.round("sigma", 7).alias("stepped"))


@plans.add("schedule_draws", f"WITH {_DENSITY}, q AS (SELECT event_id, (event_id % 1000 + 0.5) / 1000 AS u, (event_id % 77) / 77.0 AS v FROM events) SELECT event_id, round(exp(ln(greatest(lo, {LOW})) + v * (ln(least(hi, {HIGH})) - ln(greatest(lo, {LOW})))), 7) AS sigma FROM q JOIN prev ON cdf >= u AND (c0 IS NULL OR c0 < u)")
def schedule_draws(spark, sf):
    q = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 1000 + 0.5) / 1000).alias("u"), ((F.col("event_id") % 77) / 77.0).alias("v"))
    return S.draw(_schedule(spark, sf), q, "u", "v", LOW, HIGH).select("event_id", F.round("sigma", 7).alias("sigma"))


_GRID_N, _GRID_LO, _GRID_HI = 33, 0.05, 60.0


@plans.add("truncated_grid", f"""WITH {_DENSITY}, e AS (SELECT greatest({_GRID_LO}, min(mid)) AS lo_, least({_GRID_HI}, max(mid)) AS hi_, min(cdf) AS cmin FROM sch),
f AS (SELECT lo_, hi_, cmin, (SELECT c0 + (lo_ - m0) / (mid - m0) * (cdf - c0) FROM prev WHERE m0 IS NOT NULL AND ((mid >= lo_ AND m0 < lo_) OR (bin = 1 AND lo_ <= m0))) AS p0, (SELECT c0 + (hi_ - m0) / (mid - m0) * (cdf - c0) FROM prev WHERE m0 IS NOT NULL AND ((mid >= hi_ AND m0 < hi_) OR (bin = 1 AND hi_ <= m0))) AS p1 FROM e),
g AS (SELECT {_GRID_N - 1} - k AS i, k / {_GRID_N - 1}.0 AS t, lo_, hi_, greatest(cmin, least(p0 + k / {_GRID_N - 1}.0 * (p1 - p0), 1 - 1e-7)) AS u FROM f, (SELECT unnest(range(0, {_GRID_N})) AS k))
SELECT i::INT AS i, round(CASE WHEN t = 1 THEN hi_ WHEN t = 0 THEN lo_ ELSE m0 + (u - c0) / greatest(cdf - c0, 1e-20) * (mid - m0) END, 6) AS sigma FROM g LEFT JOIN prev ON m0 IS NOT NULL AND ((cdf >= u AND c0 < u) OR (bin = 1 AND u <= c0))""")
def truncated_grid(spark, sf):
    """Descending levels between two ends, even in cumulative probability."""
    return S.truncated_grid(_schedule(spark, sf), _GRID_N, _GRID_LO, _GRID_HI).select("i", F.round("sigma", 6).alias("sigma"))


@plans.add("closed_grids", f"""WITH g AS (SELECT event_id, i, i / 31.0 AS u FROM (SELECT event_id, event_id % 32 AS i FROM events)), k AS (SELECT event_id, i, u, CASE i WHEN 0 THEN {HIGH} WHEN 31 THEN {LOW} ELSE pow(pow({HIGH}, 1 / 7.0) + u * (pow({LOW}, 1 / 7.0) - pow({HIGH}, 1 / 7.0)), 7.0) END AS karras FROM g)
SELECT event_id, i::INT AS i, round(karras, 9) AS karras, round(exp(ln({LOW}) + u * (ln({HIGH}) - ln({LOW}))), 9) AS even_log, round(exp(0.3 + 1.2 * ((ln({LOW}) - 0.3) / 1.2 + u * ((ln({HIGH}) - 0.3) / 1.2 - (ln({LOW}) - 0.3) / 1.2))), 9) AS normal, round(0.25 * karras + 0.75 * exp(ln({LOW}) + u * (ln({HIGH}) - ln({LOW}))), 9) AS blended, round((karras * karras + 0.25) / (karras * karras * 0.25), 6) AS weight FROM k""")
def closed_grids(spark, sf):
    """Levels even in the seventh root, in the logarithm, under a normal logarithm; their blend; loss weights: of one step of 32 for each row."""
    g = table(spark, sf, "events").select("event_id", (F.col("event_id") % 32).cast("int").alias("i"))
    u = M.unit_grid(F.col("i"), 32)
    k, e = M.karras(F.col("i"), 32, LOW, HIGH), M.log_uniform(u, LOW, HIGH)
    return g.select("event_id", "i", F.round(k, 9).alias("karras"), F.round(e, 9).alias("even_log"), F.round(M.log_normal(u, LOW, HIGH, 0.3, 1.2), 9).alias("normal"), F.round(M.blend(k, e, 0.75), 9).alias("blended"), F.round(M.loss_weight(k, 0.5), 6).alias("weight"))


@plans.add("churned_levels", "WITH e AS (SELECT event_id, 1e-3 + abs(value) AS s FROM events), g AS (SELECT event_id, s, CASE WHEN s BETWEEN 0.05 AND 50 THEN least(40 / 256.0, sqrt(2) - 1) ELSE 0 END AS g FROM e) SELECT event_id, round(g, 9) AS gamma, round(s * (1 + g), 6) AS raised, round(sqrt(s * s * (1 + g) * (1 + g) - s * s), 5) AS added FROM g")
def churned_levels(spark, sf):
    e = _samples_with_id(spark, sf).select("event_id", M.churn(F.col("sigma"), 40.0, 256, 0.05, 50.0).alias("c"))
    return e.select("event_id", F.round("c.gamma", 9).alias("gamma"), F.round("c.raised", 6).alias("raised"), F.round("c.added", 5).alias("added"))


def _samples_with_id(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.lit(1e-3) + F.abs("value")).alias("sigma"))


@plans.add("step_ramps", f"""SELECT event_id, CASE WHEN event_id < 1000 THEN 0 ELSE greatest(0, least(least((event_id - 1000) / 4000.0, 1) * 0.9, 1)) END AS gamma,
  round(CASE WHEN event_id < 500 THEN 3e-4 * (event_id + 1) / 500 ELSE 3e-5 + (3e-4 - 3e-5) * 0.5 * (1 + cos(least(greatest((event_id - 500) / 9500.0, 0), 1) * {math.pi!r})) END, 12) AS rate,
  round(CASE WHEN event_id < 500 THEN 3e-4 * (event_id + 1) / 500 ELSE 3e-4 * 0.5 * (1 + cos(least(greatest((event_id + 1 - 500) / 9500.0, 0), 1) * {math.pi!r})) END, 12) AS ahead FROM events""")
def step_ramps(spark, sf):
    """A gate that opens over steps, and two learning-rate curves."""
    s = F.col("event_id")
    return table(spark, sf, "events").select("event_id", M.ramp(s, 1000, 4000, 0.9).alias("gamma"), F.round(M.warm_cosine(s, 500, 10000, 3e-4, 3e-5), 12).alias("rate"), F.round(M.warm_cosine(s, 500, 10000, 3e-4, 0.0, 1), 12).alias("ahead"))


@plans.add("noise_rates", """WITH t AS (SELECT event_id, value / 500 AS t FROM events) SELECT event_id, round(-ln(1 - 0.999 * t), 8) AS linear, round(0.999 / (1 - 0.999 * t), 6) AS linear_rate, round(pow(1e-3, 1 - t) * pow(20, t), 8) AS geometric, round(pow(1e-3, 1 - t) * pow(20, t) * ln(20 / 1e-3), 7) AS geometric_rate,
  round(exp(ln(1 - 0.999 * t)), 8) AS stay, round(1 / (1 + exp(-(t - 0.5) / 0.25)), 8) AS posterior FROM t""")
def noise_rates(spark, sf):
    t = F.col("value") / 500
    n = M.loglinear_noise(t)
    return table(spark, sf, "events").select(
        "event_id", F.round(n, 8).alias("linear"), F.round(M.loglinear_rate(t), 6).alias("linear_rate"), F.round(M.geometric_noise(t, 1e-3, 20.0), 8).alias("geometric"),
        F.round(M.geometric_rate(t, 1e-3, 20.0), 7).alias("geometric_rate"), F.round(M.absorbing_transition(n)["stay"], 8).alias("stay"), F.round(M.matched_filter(t, F.lit(0.5)), 8).alias("posterior"),
    )


_NFE = """c AS (SELECT p_partkey, f, s, c::BOOLEAN AS c, r::BOOLEAN AS r, (p_partkey % 257 + 1)::INT AS t FROM part, (VALUES ('continuous'), ('discrete')) f(f), (VALUES ('heun'), ('ddim'), ('euler'), ('tweedie'), ('other')) s(s), (VALUES (0), (1)) c(c), (VALUES (0), (1)) r(r)),
p AS (SELECT *, CASE WHEN s = 'heun' THEN 2 WHEN s IN ('ddim', 'euler') THEN 1 ELSE 1 END + CASE WHEN s IN ('heun', 'ddim', 'euler') AND c AND r THEN 1 ELSE 0 END AS per, CASE WHEN s IN ('euler', 'tweedie') THEN 1 ELSE 0 END AS fin FROM c),
n AS (SELECT *, CASE WHEN f = 'discrete' THEN greatest(1, t - fin) ELSE greatest(1, greatest(t - 1, 1) // per) END AS steps FROM p)"""


@plans.add("evaluation_counts", f"WITH {_NFE} SELECT p_partkey, f, s, c, r, t, steps::INT AS steps, (CASE WHEN f = 'discrete' THEN steps + fin ELSE per * steps + 1 END)::INT AS actual FROM n")
def evaluation_counts(spark, sf):
    """Steps that each row's budget of evaluations buys by every sampler, and the evaluations they take."""
    from loomstone.operators.results import sweep

    g = sweep(spark, {"f": ["continuous", "discrete"], "s": ["heun", "ddim", "euler", "tweedie", "other"], "c": [False, True], "r": [False, True]})
    g = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 257 + 1).cast("int").alias("t")).crossJoin(F.broadcast(g))  # 40 rows
    g = g.withColumn("steps", M.steps_for(F.col("f"), F.col("s"), F.col("t"), F.col("c"), F.col("r"), F.lit(True)).cast("int"))
    return g.withColumn("actual", M.evaluations(F.col("f"), F.col("s"), F.col("steps"), F.col("c"), F.col("r"), F.lit(True)).cast("int"))


@plans.add("churn_windows", f"""WITH {_DENSITY}, st AS (SELECT * FROM (VALUES ('off', 5.0, NULL, NULL, 0.1, 0.9, 'off'), ('full', 5.0, NULL, NULL, 0.1, 0.9, 'off'), ('fixed', 5.0, 20.0, 1.0, 0.1, 0.9, 'off'), ('fixed', 0.0, 1.0, 2.0, 0.1, 0.9, 'off'), ('entropy_cdf', 5.0, NULL, NULL, 0.9, 0.2, 'full')) t(mode, s_churn, t_lo, t_hi, q_lo, q_hi, fallback)),
lvl AS (SELECT st.*, (SELECT CASE WHEN c0 IS NULL THEN mid ELSE m0 + (least(q_lo, q_hi) - c0) / (cdf - c0) * (mid - m0) END FROM prev WHERE cdf >= least(q_lo, q_hi) AND (c0 IS NULL OR c0 < least(q_lo, q_hi))) AS a, (SELECT CASE WHEN c0 IS NULL THEN mid ELSE m0 + (greatest(q_lo, q_hi) - c0) / (cdf - c0) * (mid - m0) END FROM prev WHERE cdf >= greatest(q_lo, q_hi) AND (c0 IS NULL OR c0 < greatest(q_lo, q_hi))) AS b FROM st),
x AS (SELECT mode, s_churn::DOUBLE AS s_churn, mode <> 'off' AND s_churn > 0 AS enabled, CASE mode WHEN 'entropy_cdf' THEN a WHEN 'fixed' THEN coalesce(t_lo, {LOW}) ELSE {LOW} END AS a, CASE mode WHEN 'entropy_cdf' THEN b WHEN 'fixed' THEN coalesce(t_hi, {HIGH}) ELSE {HIGH} END AS b FROM lvl)
SELECT mode, s_churn, enabled, CASE WHEN enabled THEN round(least(a, b), 6) END AS w_lo, CASE WHEN enabled THEN round(greatest(a, b), 6) END AS w_hi FROM x""")
def churn_windows(spark, sf):
    rows = [("off", 5.0, None, None, 0.1, 0.9, "off"), ("full", 5.0, None, None, 0.1, 0.9, "off"), ("fixed", 5.0, 20.0, 1.0, 0.1, 0.9, "off"), ("fixed", 0.0, 1.0, 2.0, 0.1, 0.9, "off"), ("entropy_cdf", 5.0, None, None, 0.9, 0.2, "full")]
    st = spark.createDataFrame(rows, "mode string, s_churn double, t_lo double, t_hi double, q_lo double, q_hi double, fallback string")
    return S.window_bounds(st, _schedule(spark, sf), LOW, HIGH).select("mode", "s_churn", "enabled", F.round("w_lo", 6).alias("w_lo"), F.round("w_hi", 6).alias("w_hi"))


@plans.add("smoothed_minimum", """WITH c AS (SELECT floor(value / 5)::BIGINT AS t, avg(event_id % 211) AS v FROM events GROUP BY 1), s AS (SELECT t, sum(v) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM c),
x AS (SELECT *, lag(s) OVER (ORDER BY t) AS s0, lead(s) OVER (ORDER BY t) AS s1 FROM s), m AS (SELECT t, i, s FROM x WHERE s < s0 AND s < s1 AND i > 2 AND i < n - 3 ORDER BY i DESC LIMIT 1)
SELECT t, i::INT AS i, round(s, 6) AS smoothed FROM m UNION ALL SELECT t, i::INT, round(s, 6) FROM (SELECT * FROM s ORDER BY s, i LIMIT 1) WHERE NOT EXISTS (SELECT 1 FROM m)""")
def smoothed_minimum(spark, sf):
    c = table(spark, sf, "events").groupBy(F.floor(F.col("value") / 5).alias("t")).agg(F.avg(F.col("event_id") % 211).alias("v"))
    return S.smoothed_minimum(c, "t", "v").select("t", F.col("i").cast("int").alias("i"), F.round("smoothed", 6).alias("smoothed"))


@plans.add("worker_seeds", "SELECT event_id, event_id + (user_id % 8) AS loader, 42 + 999 * (user_id % 8) AS rank_, round(((event_id % 8) * 0.13 * greatest(1, event_id % 512 - 1))::DOUBLE, 6) AS churn FROM events")
def worker_seeds(spark, sf):
    r = F.col("user_id") % 8
    return table(spark, sf, "events").select("event_id", M.worker_seed(F.col("event_id"), r, 1).alias("loader"), M.worker_seed(F.lit(42).cast("long"), r, 999).alias("rank_"), F.round(M.churn_amount((F.col("event_id") % 8) * 0.13, F.col("event_id") % 512), 6).alias("churn"))


_POINTS = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0)


@plans.add("value_percentiles", " UNION ALL ".join(f"SELECT event_type, {p}::DOUBLE AS point, round(quantile_cont(value, {p}), 9) AS value FROM events GROUP BY 1" for p in _POINTS))
def value_percentiles(spark, sf):
    """Exact percentiles of groups of any size, by histograms that are refined."""
    from loomstone.operators.ranges import percentiles

    found = percentiles(table(spark, sf, "events"), "value", ["event_type"], list(_POINTS))
    return found.select("event_type", "point", F.round("value", 9).alias("value"))


@plans.add("uneven_bins", "WITH e AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS bin FROM (SELECT DISTINCT o_totalprice::DOUBLE / 4 AS edge FROM orders)) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e.edge, coalesce(e.bin, -1)::BIGINT AS bin FROM lineitem l ASOF LEFT JOIN e ON l.l_extendedprice::DOUBLE > e.edge")
def uneven_bins(spark, sf):
    """The bin of every price between edges that are as many as there are orders."""
    from loomstone.operators.ranges import place_between

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    edges = table(spark, sf, "orders").select((F.col("o_totalprice").cast("double") / 4).alias("x"))
    return place_between(rows, "l_extendedprice", edges, "x").drop("l_extendedprice")
