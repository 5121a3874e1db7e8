"""Sweeps of settings, names and keys of results, result tables and caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import general_format, safe_name
from loomstone.operators.relational import merge_rows

# The key of a result row, and its base columns.
RESULT_KEY = ["checkpoint", "split", "tag", "metric", "view", "cache_key"]
RESULT_COLUMNS = ["timestamp_utc", "experiment", "framework", "dataset", "checkpoint", "metric", "split", "value", "details"]


def sweep(spark: SparkSession, settings: dict[str, list]) -> DataFrame:
    """The product of short lists of settings, one column each, in the order of the lists."""
    arrays = [F.explode(F.array(*[F.lit(v) for v in values])).alias(name) for name, values in settings.items()]
    return reduce(lambda df, a: df.select("*", a), arrays, spark.range(1)).drop("id")


def check_unique(specs: DataFrame, tag: str) -> DataFrame:
    """``specs`` unchanged, or an error that names a repeated tag when the rows are read."""
    twice = specs.groupBy(tag).agg(F.count("*").alias("_n"))
    return specs.join(twice, tag).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("a tag occurs twice: "), F.col(tag))).cast("boolean"))).select(*specs.columns)


def validate(specs: DataFrame) -> DataFrame:
    """``specs`` unchanged, or an error: stochastic runs need a positive amount of churn."""
    bad = F.col("stochastic") & ~(F.coalesce(F.col("s_churn"), F.lit(0.0)) > 0)
    return specs.where(F.when(~bad, True).otherwise(F.raise_error(F.lit("a stochastic run needs s_churn > 0")).cast("boolean")))


def tag(sampler: Column, target: Column, actual: Column, steps: Column, scale: Column, refresh: Column, eta: Column, sigma: Column, suffix: Column) -> Column:
    """Name of a setting: parts that are null or not positive are left out."""
    two = lambda x: F.format_string("%.2f", x)
    return F.concat_ws(
        "_", sampler, F.when(refresh.isNotNull(), F.concat(F.lit("scr-"), refresh)), F.concat(F.lit("tnfe-"), target), F.concat(F.lit("anfe-"), actual), F.concat(F.lit("steps-"), steps),
        F.concat(F.lit("gs"), F.format_string("%.1f", scale)), F.when(eta > 0, F.concat(F.lit("ati"), two(eta))), F.when(sigma > 0, F.concat(F.lit("term"), two(F.log10(sigma)))), suffix,
    )


def stochastic_suffix(enabled: Column, churn: Column, noise: Column, mode: Column, q_lo: Column, q_hi: Column, t_lo: Column, t_hi: Column) -> Column:
    """How noise was added, for the tag; null where none was."""
    g = general_format
    head = F.concat(F.lit("stoch-ch"), g(churn), F.lit("-n"), g(noise))
    window = F.when(mode == "entropy_cdf", F.concat(F.lit("-q"), g(q_lo), F.lit("_"), g(q_hi))).when(mode == "fixed", F.concat(F.lit("-t"), g(t_lo), F.lit("_"), g(t_hi))).otherwise(F.concat(F.lit("-wm-"), mode))
    return F.when(enabled, F.concat(head, window))


def parse_tag(name: Column) -> Column:
    """``struct<sampler, refresh, log_sigma, scale>`` of the two old forms of tags; what a form lacks is null."""
    new = F.regexp_extract(name, r"^(.*?)_scr-(.*?)_term(-?[0-9.]+)_gs(-?[0-9.]+)$", 0) != ""
    old = F.regexp_extract(name, r"^(.*?)_term(-?[0-9.]+)_gs(-?[0-9.]+)$", 0) != ""
    pick = lambda g_new, g_old: F.when(new, F.regexp_extract(name, r"^(.*?)_scr-(.*?)_term(-?[0-9.]+)_gs(-?[0-9.]+)$", g_new)).when(old, F.regexp_extract(name, r"^(.*?)_term(-?[0-9.]+)_gs(-?[0-9.]+)$", g_old))
    refresh = F.when(new, F.regexp_extract(name, r"^(.*?)_scr-(.*?)_term", 2))
    return F.struct(F.coalesce(pick(1, 1), F.split_part(name, F.lit("_scr-"), F.lit(1))).alias("sampler"), refresh.alias("refresh"), pick(3, 2).try_cast("double").alias("log_sigma"), pick(4, 3).try_cast("double").alias("scale"))


# Names of the parts of a fully named cache key, in order, and how each is written.
CACHE_KEY_PARTS = (
    ("ckpt", "text"), ("split", "text"), ("N", "whole"), ("steps", "whole"), ("mb", "whole"), ("sigma_max", "number"), ("ema", "whole"), ("seed", "whole"),
    ("sampler", "text"), ("term", "number"), ("gs", "number"), ("scr", "text"), ("ati", "number"), ("stoch", "whole"), ("s_churn", "number"), ("s_noise", "number"),
    ("window", "text"), ("qlo", "number"), ("qhi", "number"), ("s_tmin", "number"), ("s_tmax", "number"), ("fallback", "text"),
)


def cache_key(values: dict[str, Column]) -> Column:
    """``name=value`` of all parts, joined by bars; a part that is null or not given is ``none``."""
    none = F.lit("none")
    write = {"text": lambda c: F.coalesce(c.cast("string"), none), "whole": lambda c: F.coalesce(c.cast("long").cast("string"), none), "number": lambda c: general_format(c.cast("double"))}
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), write[kind](values[name]) if name in values else none) for name, kind in CACHE_KEY_PARTS])


def cache_path(checkpoint: Column, split: Column, key: Column, name: Column) -> Column:
    return F.concat_ws("/", safe_name(checkpoint), split, key, F.concat(name, F.lit(".jsonl")))


def path_columns(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``tag, cache_key, split, checkpoint`` read from a file's name and its three folders."""
    parts = F.split(F.col(path), "/")
    return df.select("*", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("tag"), F.element_at(parts, -2).alias("cache_key"), F.element_at(parts, -3).alias("split"), F.element_at(parts, -4).alias("checkpoint"))


def upsert(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Result rows after an append in which the first row of a key wins; columns are united, missing ones are null."""
    return merge_rows(existing, new, RESULT_KEY, order)


def work_list(specs: DataFrame, checkpoints: DataFrame, cached: DataFrame, key: Column) -> DataFrame:
    """What is left to be generated: every setting for every checkpoint whose key no cache has. Both lists are short."""
    every = specs.crossJoin(F.broadcast(checkpoints)).withColumn("cache_key", key)  # short lists of names
    return every.join(cached.select("cache_key"), "cache_key", "left_anti")


def checkpoint_order(names: DataFrame, name: str) -> DataFrame:
    """Checkpoint files once each, by step number, those without one last, then by name."""
    step = F.regexp_extract(name, r"(?:step|_)(\d+)", 1).try_cast("long")
    return names.dropDuplicates([name]).withColumn("step", step).orderBy(F.asc_nulls_last("step"), name)
