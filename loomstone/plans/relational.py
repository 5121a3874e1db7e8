"""Joins, windows, orders, sets and picks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.operators import packing as P
from loomstone.operators import relational as R
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()

_PICK = "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value < {0}, CASE WHEN value >= {0} THEN value ELSE -value END, event_id) = 1"


def _picked(spark, sf, least):
    return R.held_out_pick(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", least)


@plans.add("held_out_samples", _PICK.format(3.0))
def held_out_samples(spark, sf):
    """The shortest sample of at least three seconds per speaker."""
    return _picked(spark, sf, 3.0)


@plans.add("held_out_samples_fallback", _PICK.format(480.0))
def held_out_samples_fallback(spark, sf):
    """The same with a bound that most speakers miss: their longest sample."""
    return _picked(spark, sf, 480.0)


_SMALL = 200_000


def _side(df):
    """Broadcast a side only if it was counted and is small; else leave the choice of join to the optimiser."""
    return F.broadcast(df) if df.limit(_SMALL + 1).count() <= _SMALL else df


@plans.add("speaker_conditioned_rows", f"WITH h AS ({_PICK.format(3.0)}) SELECT e.user_id, e.event_id, h.event_id AS held_id, h.value AS held_value FROM events e JOIN h USING (user_id) WHERE e.event_id NOT IN (SELECT event_id FROM h) AND e.event_type <> 'error'")
def speaker_conditioned_rows(spark, sf):
    """Every usable row with its speaker's held-out sample; that sample itself is left out."""
    h = _picked(spark, sf, 3.0).select("user_id", F.col("event_id").alias("held_id"), F.col("value").alias("held_value"))
    e = table(spark, sf, "events").where("event_type <> 'error'").select("user_id", "event_id")
    return e.join(_side(h), "user_id").where(F.col("event_id") != F.col("held_id"))


@plans.add("missing_speakers", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400)")
def missing_speakers(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id").distinct().join(e.where("event_type = 'purchase' and value > 400").select("user_id"), "user_id", "left_anti")


@plans.add("valid_rows", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 320 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def valid_rows(spark, sf):
    """Rows in an inclusive range whose id is on a list."""
    e = table(spark, sf, "events")
    return e.where(F.col("value").between(10, 320)).join(e.where("event_type = 'signup'").select("user_id"), "user_id", "left_semi").select("event_id", "value")


@plans.add("total_lookup", "SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def total_lookup(spark, sf):
    """A lookup that must succeed for every row: a missing key raises when the row is read."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal", F.lit(True).alias("found"))
    j = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")
    return j.where(F.coalesce(F.col("found"), F.raise_error(F.lit("a key has no entry")).cast("boolean"))).select("o_orderkey", "c_name", "c_acctbal")


@plans.add("rank_lookup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents), v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM (SELECT unnest(w) AS word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 500)),
t AS (SELECT doc_id, unnest(w) AS word FROM w) SELECT doc_id, sum(coalesce(rank, -1))::BIGINT AS total, sum((rank IS NULL)::BIGINT)::BIGINT AS n_unknown FROM t LEFT JOIN v USING (word) GROUP BY 1""")
def rank_lookup(spark, sf):
    """Words to ranks, an unknown one to the default."""
    from loomstone.functions.text import words

    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w"))
    v = P.vocabulary(d, F.col("w"), 500).select("word", "id")
    t = d.select("doc_id", F.explode("w").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(F.broadcast(v), "word", "left")  # 500 rows
    return t.groupBy("doc_id").agg(F.sum(F.coalesce("id", F.lit(-1)) * F.col("n")).alias("total"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"))


@plans.add("paired_profiles", """
WITH p AS (SELECT l_quantity AS size, l_linestatus AS kind, l_extendedprice AS t, row_number() OVER (PARTITION BY l_quantity, l_linestatus ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem)
SELECT a.size, a.t AS token_t, b.t AS bit_t FROM p a JOIN p b ON a.size = b.size WHERE a.kind = 'O' AND b.kind = 'F' AND a.r = 1 AND b.r = 1""")
def paired_profiles(spark, sf):
    """Two kinds of profile rows side by side by size; of repeated keys the last row counts."""
    p = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("size"), F.col("l_linestatus").alias("kind"), F.col("l_extendedprice").alias("t"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    last = R.last_wins(p, ["size", "kind"], "o").select("size", "kind", "t")
    return last.where("kind = 'O'").select("size", F.col("t").alias("token_t")).join(last.where("kind = 'F'").select("size", F.col("t").alias("bit_t")), "size")


@plans.add("expected_members", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 30) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def expected_members(spark, sf):
    """Rows that three lists expect."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    l = l.join(table(spark, sf, "part").where("p_size < 30").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    l = l.join(table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    return l.join(table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@plans.add("positional_pairs", "SELECT a.i, a.doc_id AS generated, b.item_id AS reference FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) a JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) b USING (i)")
def positional_pairs(spark, sf):
    """Rows of two tables side by side by their places."""
    a = P.row_numbers(table(spark, sf, "documents").select("doc_id"), "doc_id", "i")
    b = P.row_numbers(table(spark, sf, "benchmark").select("item_id"), "item_id", "i")
    return a.join(b, "i").select("i", F.col("doc_id").alias("generated"), F.col("item_id").alias("reference"))


@plans.add("sweep_product", """
SELECT c, s, g, n, CASE WHEN s = 'heun' THEN ch ELSE 0 END AS churn FROM (SELECT s_name AS c FROM supplier) c, (VALUES ('heun'), ('ddim')) s(s), (VALUES (1.0::DOUBLE), (2.5::DOUBLE)) g(g), (VALUES (32), (64), (128)) n(n), (VALUES (0.0::DOUBLE), (8.0::DOUBLE)) x(ch) WHERE s = 'heun' OR ch = 0""")
def sweep_product(spark, sf):
    """Product of a table's rows and short parameter lists; parameters that a sampler lacks do not multiply its rows."""
    from loomstone.operators.results import sweep

    lists = sweep(spark, {"s": ["heun", "ddim"], "g": [1.0, 2.5], "n": [32, 64, 128], "churn": [0.0, 8.0]})
    lists = lists.where((F.col("s") == "heun") | (F.col("churn") == 0)).withColumn("n", F.col("n").cast("int"))
    return table(spark, sf, "supplier").select(F.col("s_name").alias("c")).crossJoin(F.broadcast(lists))  # 18 rows


@plans.add("missing_keys", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def missing_keys(spark, sf):
    have = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).exceptAll(have).distinct().join(have, "k", "left_anti")


@plans.add("shared_keys", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def shared_keys(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(l.where("l_returnflag = 'A'").select("l_suppkey"))


@plans.add("united_splits", "SELECT conv_id AS id, 'talk' AS part, length(text)::BIGINT AS n FROM conversations UNION ALL SELECT doc_id, 'doc', length(text) FROM documents")
def united_splits(spark, sf):
    a = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit("talk").alias("part"), F.length("text").cast("long").alias("n"))
    return a.unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("part"), F.length("text").cast("long").alias("n")))


@plans.add("distinct_in_order", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def distinct_in_order(spark, sf):
    return R.distinct_in_order(table(spark, sf, "documents"), "source", "doc_id")


@plans.add("expanded_splits", "SELECT event_id, unnest(CASE WHEN event_type = 'view' THEN ['train', 'test'] WHEN event_type = 'click' THEN ['test'] ELSE ['train'] END) AS split FROM events")
def expanded_splits(spark, sf):
    split = F.when(F.col("event_type") == "view", F.array(F.lit("train"), F.lit("test"))).when(F.col("event_type") == "click", F.array(F.lit("test"))).otherwise(F.array(F.lit("train")))
    return table(spark, sf, "events").select("event_id", F.explode(split).alias("split"))


@plans.add("repeated_tags", "SELECT source || '-' || lang AS tag, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_tags(spark, sf):
    """Tags that occur more than once: there must be none before a sweep starts."""
    return table(spark, sf, "documents").groupBy(F.concat_ws("-", "source", "lang").alias("tag")).agg(F.count("*").alias("n")).where("n > 1")


@plans.add("ordered_settings", "SELECT user_id, event_type, CASE WHEN value > 250 THEN value END AS nfe, event_id FROM events ORDER BY event_type, nfe NULLS LAST, event_id")
def ordered_settings(spark, sf):
    """Several keys, missing numbers last."""
    return table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("value") > 250, F.col("value")).alias("nfe"), "event_id").orderBy("event_type", F.asc_nulls_last("nfe"), "event_id")


@plans.add("adjacent_rows", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS step FROM events")
def adjacent_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id")), 6).alias("step"))


@plans.add("assigned_ranks", "SELECT p_partkey, (row_number() OVER (ORDER BY (p_size = 1) DESC, p_retailprice, p_partkey) - 1)::BIGINT AS new_id FROM part")
def assigned_ranks(spark, sf):
    """New ids in a final order, reserved ids first."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") != 1).alias("free"), "p_retailprice")
    from loomstone.operators.ordering import ranks

    return ranks(p, ["free", "p_retailprice", "p_partkey"], "new_id").select("p_partkey", "new_id")


@plans.add("neighbourhoods", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS r FROM part) SELECT c.r::BIGINT AS probe, string_agg(r.p_partkey::VARCHAR, ',' ORDER BY r.r) AS around FROM r c JOIN r ON r.r BETWEEN c.r - 3 AND c.r + 3 GROUP BY 1")
def neighbourhoods(spark, sf):
    """What stands within three places of every row: each is sent to the seven places it can be near to."""
    from loomstone.operators.ordering import ranks

    r = ranks(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], "r")
    near = r.select("p_partkey", "r", F.explode(F.sequence(F.col("r") - 3, F.col("r") + 3)).alias("probe"))
    around = near.groupBy("probe").agg(F.array_sort(F.collect_list(F.struct("r", "p_partkey"))).alias("x")).where(F.exists("x", lambda x: x["r"] == F.col("probe")))
    return around.select("probe", F.array_join(F.transform("x", lambda x: x["p_partkey"].cast("string")), ",").alias("around"))


@plans.add("last_entries", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 256")
def last_entries(spark, sf):
    """What a buffer of 256 entries holds after all events."""
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("event_id")).limit(256)


@plans.add("moving_averages", "SELECT user_id, sum(value) AS total, round(sum(ema), 6) AS ema FROM (SELECT user_id, value, 0.1 * pow(0.9, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY event_id)) * value AS ema FROM (SELECT user_id, event_id, value FROM events)) GROUP BY 1".replace("sum(value) AS total", "count(*) AS n"))
def moving_averages(spark, sf):
    """Exponential moving average from zero, as a closed sum over places from the end."""
    w = W.partitionBy("user_id")
    e = table(spark, sf, "events").select("user_id", "value", (F.count("*").over(w) - F.row_number().over(w.orderBy("event_id"))).alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(0.1 * F.pow(F.lit(0.9), "k") * F.col("value")), 6).alias("ema"))


@plans.add("kept_improvements", """
WITH s AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
SELECT user_id, event_id, value FROM s WHERE best IS NULL OR value < best QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) <= 3""")
def kept_improvements(spark, sf):
    """Of each run's saves that improved strictly, the three best."""
    w = W.partitionBy("user_id")
    s = table(spark, sf, "events").select("user_id", "event_id", "value", F.min("value").over(w.orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)).alias("best"))
    better = s.where(F.col("best").isNull() | (F.col("value") < F.col("best"))).withColumn("r", F.row_number().over(w.orderBy("value", "event_id")))
    return better.where("r <= 3").select("user_id", "event_id", "value")


@plans.add("latest_saves", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2")
def latest_saves(spark, sf):
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 2").drop("r")


@plans.add("threshold_top_k", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 AS x, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(x / 0.8) / sum(exp(x / 0.8)) OVER (PARTITION BY l_orderkey), 6) AS p FROM r WHERE r <= 2""")
def threshold_top_k(spark, sf):
    """Probabilities of the scores that reach the second largest; ties stay."""
    w = W.partitionBy("l_orderkey")
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.exp(F.col("l_quantity") / 10 / 0.8).alias("e"), F.rank().over(w.orderBy(F.desc("l_quantity"))).alias("r")).where("r <= 2")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


@plans.add("best_starts", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1")
def best_starts(spark, sf):
    """The first of the largest values."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@plans.add("capped_token_rows", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 500)
SELECT doc_id, len(list_filter(w, lambda x: length(x) NOT IN (2, 3)))::BIGINT AS n FROM d WHERE len(list_filter(w, lambda x: length(x) NOT IN (2, 3))) > 0""")
def capped_token_rows(spark, sf):
    """At most 500 rows in order; reserved items and rows left empty are dropped after the cap."""
    d = P.row_numbers(table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("w")), "doc_id", "r").where("r < 500")
    return d.select("doc_id", F.size(F.filter("w", lambda x: ~F.length(x).isin(2, 3))).cast("long").alias("n")).where("n > 0")


@plans.add("prefix_rows", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents) SELECT doc_id, array_to_string(w[1:50], ' ') AS prefix FROM d WHERE len(w) >= 50 QUALIFY row_number() OVER (ORDER BY doc_id) <= 64""")
def prefix_rows(spark, sf):
    """Prefixes of the first 64 rows that are long enough."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("w")).where(F.size("w") >= 50)
    return d.orderBy("doc_id").limit(64).select("doc_id", F.array_join(F.slice("w", 1, 50), " ").alias("prefix"))


@plans.add("status_rows", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id = 7")
def status_rows(spark, sf):
    """Rows by equality, pushed down to the scan."""
    return table(spark, sf, "events").where("event_type = 'purchase' and user_id = 7").select("event_id", "user_id", "value")


@plans.add("excluded_holdouts", f"SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM ({_PICK.format(3.0)}))")
def excluded_holdouts(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return e.join(_picked(spark, sf, 3.0).select("event_id"), "event_id", "left_anti")
