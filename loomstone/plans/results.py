"""Sweeps, tags, keys and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import results as R
from loomstone.operators import text_metrics as T
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()


@plans.add("setting_tags", r"""
WITH g AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'heun' ELSE 'ddim' END AS s, event_id % 5 * 32 + 32 AS t, CASE WHEN event_id % 3 = 0 THEN 'carry' END AS r, (event_id % 4) / 4.0 AS eta, CASE WHEN event_id % 7 <> 0 THEN value / 100 END AS sigma FROM events)
SELECT event_id, concat_ws('_', s, 'scr-' || r, 'tnfe-' || t, 'anfe-' || (t + 1), 'steps-' || (t // 2), 'gs' || printf('%.1f', 1.5), CASE WHEN eta > 0 THEN 'ati' || printf('%.2f', eta) END, CASE WHEN sigma > 0 THEN 'term' || printf('%.2f', log10(sigma)) END) AS tag FROM g""")
def setting_tags(spark, sf):
    """Names of settings, with the parts that apply."""
    i = F.col("event_id")
    t = i % 5 * 32 + 32
    sigma = F.when(i % 7 != 0, F.col("value") / 100)
    tag = R.tag(F.when(i % 2 == 0, "heun").otherwise("ddim"), t, t + 1, F.floor(t / 2), F.lit(1.5), F.when(i % 3 == 0, "carry"), (i % 4) / 4.0, sigma, F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", tag.alias("tag"))


@plans.add("stochastic_tags")
def stochastic_tags(spark, sf):
    """Settings that add noise, whose numbers are written in the shortest form."""
    i, v = F.col("event_id"), F.col("value")
    mode = F.when(i % 3 == 0, "entropy_cdf").when(i % 3 == 1, "fixed").otherwise("full")
    s = R.stochastic_suffix(i % 2 == 0, v, F.lit(1.003), mode, F.lit(0.1), F.lit(0.9), v / 1000, F.lit(None).cast("double"))
    return table(spark, sf, "events").select("event_id", s.alias("suffix"))


@plans.add("parsed_tags", r"""
WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'heun_scr-carry_term-1.10_gs' || (event_id % 7) || '.5' WHEN 1 THEN 'ddim_term' || (event_id % 5) || '.25_gs0.0' ELSE 'plain' END AS tag FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'heun' WHEN event_id % 3 = 1 THEN 'ddim' ELSE tag END AS sampler, CASE WHEN event_id % 3 = 0 THEN 'carry' END AS refresh, CASE event_id % 3 WHEN 0 THEN -1.1 WHEN 1 THEN event_id % 5 + 0.25 END::DOUBLE AS log_sigma, CASE event_id % 3 WHEN 0 THEN event_id % 7 + 0.5 WHEN 1 THEN 0.0 END::DOUBLE AS scale FROM t""")
def parsed_tags(spark, sf):
    i = F.col("event_id")
    tag = F.when(i % 3 == 0, F.concat(F.lit("heun_scr-carry_term-1.10_gs"), i % 7, F.lit(".5"))).when(i % 3 == 1, F.concat(F.lit("ddim_term"), i % 5, F.lit(".25_gs0.0"))).otherwise("plain")
    return table(spark, sf, "events").select("event_id", R.parse_tag(tag).alias("p")).select("event_id", "p.*")


@plans.add("cache_keys")
def cache_keys(spark, sf):
    """Fully named keys of generations, and where their files stand."""
    v, i = F.col("value"), F.col("event_id")
    key = R.cache_key({"ckpt": F.col("event_type"), "split": F.lit("test"), "N": i, "steps": i % 256, "mb": F.lit(8), "sigma_max": v, "ema": F.lit(True).cast("int"), "seed": F.lit(42), "sampler": F.lit("heun"), "gs": v / 3})
    return table(spark, sf, "events").select("event_id", key.alias("key"), R.cache_path(F.col("event_type"), F.lit("test"), F.sha2(key, 256), F.lit("tag")).alias("path"))


@plans.add("path_columns", r"""
WITH p AS (SELECT event_id, '/runs/shared/' || event_type || '/' || CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'train' END || '/k' || (user_id % 9) || '/heun_gs' || (event_id % 3) || '.0.jsonl' AS path FROM events), s AS (SELECT event_id, string_split(path, '/') AS s FROM p)
SELECT event_id, regexp_replace(s[-1], '\.[^.]*$', '') AS tag, s[-2] AS cache_key, s[-3] AS split, s[-4] AS checkpoint FROM s""")
def path_columns(spark, sf):
    i = F.col("event_id")
    path = F.concat(F.lit("/runs/shared/"), "event_type", F.lit("/"), F.when(i % 2 == 0, "test").otherwise("train"), F.lit("/k"), F.col("user_id") % 9, F.lit("/heun_gs"), i % 3, F.lit(".0.jsonl"))
    return R.path_columns(table(spark, sf, "events").select("event_id", path.alias("path")), "path").drop("path")


_ROWS = "r AS (SELECT event_id AS o, event_type AS checkpoint, CASE WHEN user_id % 2 = 0 THEN 'test' END AS split, 't' || user_id % 20 AS tag, 'ppl' AS metric, CASE WHEN user_id % 3 = 0 THEN 'full' END AS view_, 'k' AS cache_key, value FROM events)"


@plans.add("upserted_results", f"""WITH {_ROWS}, old AS (SELECT * FROM r WHERE o < 400), fresh AS (SELECT * FROM r WHERE o >= 400 QUALIFY row_number() OVER (PARTITION BY checkpoint, split, tag, metric, view_, cache_key ORDER BY o) = 1)
SELECT checkpoint, split, tag, metric, view_ AS view, cache_key, o, value, NULL::VARCHAR AS note FROM old UNION ALL SELECT checkpoint, split, tag, metric, view_, cache_key, o, value, 'new' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old x WHERE x.checkpoint IS NOT DISTINCT FROM f.checkpoint AND x.split IS NOT DISTINCT FROM f.split AND x.tag = f.tag AND x.view_ IS NOT DISTINCT FROM f.view_)""")
def upserted_results(spark, sf):
    """Rows merged into a result table: first of a key wins, null keys are equal, columns are united."""
    r = table(spark, sf, "events").select(
        F.col("event_id").alias("o"), F.col("event_type").alias("checkpoint"), F.when(F.col("user_id") % 2 == 0, "test").alias("split"), F.concat(F.lit("t"), F.col("user_id") % 20).alias("tag"),
        F.lit("ppl").alias("metric"), F.when(F.col("user_id") % 3 == 0, "full").alias("view"), F.lit("k").alias("cache_key"), "value",
    )
    return R.upsert(r.where("o < 400"), r.where("o >= 400").withColumn("note", F.lit("new")), "o")


@plans.add("work_list", "WITH s AS (SELECT s, n FROM (VALUES ('heun'), ('ddim')) a(s), (VALUES (32), (64)) b(n)), c AS (SELECT DISTINCT source AS checkpoint FROM documents), e AS (SELECT s, n, checkpoint, checkpoint || '|' || s || '|' || n AS cache_key FROM s, c) SELECT * FROM e WHERE cache_key NOT IN (SELECT source || '|heun|32' FROM documents WHERE lang = 'en')")
def work_list(spark, sf):
    """Settings for checkpoints that no cache covers yet."""
    d = table(spark, sf, "documents")
    specs = R.sweep(spark, {"s": ["heun", "ddim"], "n": [32, 64]}).withColumn("n", F.col("n").cast("int"))
    cached = d.where("lang = 'en'").select(F.concat(F.col("source"), F.lit("|heun|32")).alias("cache_key"))
    return R.work_list(specs, d.select(F.col("source").alias("checkpoint")).distinct(), cached, F.concat_ws("|", "checkpoint", "s", "n"))


@plans.add("checked_sweep", "SELECT c, s, n, c || '-' || s || '-' || n AS tag, s = 'heun' AS stochastic, CASE WHEN s = 'heun' THEN 8.0 END::DOUBLE AS s_churn FROM (SELECT s_name AS c FROM supplier), (VALUES ('heun'), ('ddim')) a(s), (VALUES (32), (64), (128)) b(n)")
def checked_sweep(spark, sf):
    """A sweep over a table's rows whose tags are unique and whose stochastic runs have churn; anything else raises."""
    g = R.sweep(spark, {"s": ["heun", "ddim"], "n": [32, 64, 128]}).withColumn("n", F.col("n").cast("int"))
    g = table(spark, sf, "supplier").select(F.col("s_name").alias("c")).crossJoin(F.broadcast(g))  # six rows
    g = g.select("c", "s", "n", F.concat_ws("-", "c", "s", "n").alias("tag"), (F.col("s") == "heun").alias("stochastic"), F.when(F.col("s") == "heun", 8.0).alias("s_churn"))
    return R.check_unique(R.validate(g), "tag")


@plans.add("entropy_report", r"""
WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
l AS (SELECT role AS checkpoint, 'gen' AS view, conv_id, turn, text AS x FROM t UNION ALL SELECT role, 'real', conv_id, turn, ref FROM t WHERE ref IS NOT NULL),
w AS (SELECT checkpoint, view, conv_id, turn, unnest(regexp_extract_all(lower(coalesce(x, '')), '\S+')) AS w FROM l), c AS (SELECT checkpoint, view, conv_id, turn, w, count(*) AS c FROM w GROUP BY ALL), h AS (SELECT checkpoint, view, conv_id, turn, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c GROUP BY ALL)
SELECT l.checkpoint, l.view, count(*) AS n, round(avg(coalesce(h, 0)), 6) AS value FROM l LEFT JOIN h ON l.checkpoint = h.checkpoint AND l.view = h.view AND l.conv_id = h.conv_id AND l.turn = h.turn GROUP BY ALL""")
def entropy_report(spark, sf):
    """Mean entropy of generated and real rows per group, in long form."""
    from pyspark.sql import Window as W

    from loomstone.functions.text import words

    t = table(spark, sf, "conversations").select(F.col("role").alias("checkpoint"), "text", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("ref"))
    views = F.explode(F.array(F.struct(F.lit("gen").alias("view"), F.col("text").alias("x"), F.lit(True).alias("ok")), F.struct(F.lit("real").alias("view"), F.col("ref").alias("x"), F.col("ref").isNotNull().alias("ok"))))
    rows = t.select("checkpoint", views.alias("v")).where("v.ok").select("checkpoint", "v.view", T.unigram_entropy(words(F.col("v.x"))).alias("h"))
    return rows.groupBy("checkpoint", "view").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("value"))


@plans.add("checkpoint_order", "WITH n AS (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN 'last.pt' ELSE 'step_' || (user_id % 12) * 1000 || '.pt' END AS name FROM events) SELECT name, CASE WHEN name <> 'last.pt' THEN regexp_extract(name, '_(\\d+)', 1)::BIGINT END AS step FROM n ORDER BY step NULLS LAST, name".replace("\\\\", "\\"))
def checkpoint_order(spark, sf):
    n = table(spark, sf, "events").select(F.when(F.col("user_id") % 5 == 0, "last.pt").otherwise(F.concat(F.lit("step_"), F.col("user_id") % 12 * 1000, F.lit(".pt"))).alias("name"))
    return R.checkpoint_order(n, "name")


@plans.add("release_manifest", "SELECT b.k || '/' || f.f AS local, 'release/' || f.f AS remote, n.n_nationkey IS NULL AS missing FROM (VALUES ('a'), ('b')) b(k), (VALUES ('ALGERIA'), ('BRAZIL'), ('ATLANTIS')) f(f) LEFT JOIN nation n ON n.n_name = f.f")
def release_manifest(spark, sf):
    """Files to publish, and those that a listing lacks."""
    m = R.sweep(spark, {"k": ["a", "b"], "f": ["ALGERIA", "BRAZIL", "ATLANTIS"]})
    listed = table(spark, sf, "nation").select(F.col("n_name").alias("f"), F.lit(True).alias("there"))
    return m.join(listed, "f", "left").select(F.concat_ws("/", "k", "f").alias("local"), F.concat(F.lit("release/"), "f").alias("remote"), F.col("there").isNull().alias("missing"))
