"""Work that may stop at any time and go on later: shards as a stream, an idempotent sink, done-marks, a last check.

A build has one folder: ``pending`` (a file of rows for each shard), ``results`` and ``done`` (a partition for each shard)
and ``state`` (the stream's checkpoint). A shard's results replace what a broken-off attempt had written of it, and its
done-mark is written after them; so whatever is marked is whole, and what is marked is never done again, even where the
checkpoint has been lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.sinks import exists

#: Rows of a shard, about, beyond which there are more shards.
SHARD = 50_000

Work = Callable[[DataFrame], DataFrame]


class Incomplete(RuntimeError):
    """Shards without a done-mark, or marks that the results do not bear out."""


def lay_out(rows: DataFrame, path: str, key: str, shards: int, most: int = SHARD) -> None:
    """Deal rows to ``shards`` files by a hash of their key, or to as many more as keep a file to about ``most`` rows, each
    written by a task of its own. A layout that is there already is kept, so that a build goes on with the shards it
    began with; a null key is dealt like any other."""
    if exists(rows, f"{path}/pending/_SUCCESS"):
        return
    shards = max(shards, -(-rows.count() // most))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int"))
    dealt.repartitionById(shards, F.col("shard")).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/pending")


def done_marks(spark: SparkSession, path: str) -> DataFrame:
    """``shard, n_in, n_out`` of the shards that are done."""
    if not exists(spark, f"{path}/done"):
        return spark.createDataFrame([], "shard int, n_in long, n_out long")
    return spark.read.schema("n_in long, n_out long, shard int").parquet(f"{path}/done").select("shard", "n_in", "n_out")


def run(spark: SparkSession, path: str, work: Work, each: int = 4, most: int | None = None) -> int:
    """Do pending shards, ``each`` files a batch, and mark them; how many batches were run.

    ``work`` turns rows with ``shard`` into result rows with ``shard``, each shard by itself. ``most`` batches at most are run;
    the rest is left for the next run. An error of ``work`` ends the run and leaves what was done before.
    """
    schema = spark.read.parquet(f"{path}/pending").schema
    pending = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(f"{path}/pending")
    batches = 0
    stopped = False

    def put(batch: DataFrame, number: int) -> None:
        nonlocal batches, stopped
        if most is not None and batches >= most:
            stopped = True
            raise InterruptedError("enough for this run")
        left = batch.join(F.broadcast(done_marks(spark, path).select("shard")), "shard", "left_anti")  # one row a shard
        counts = left.groupBy("shard").agg(F.count("*").alias("n_in"))
        results = work(left)
        if not left.isEmpty():
            results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/results")
            written = spark.read.schema(results.schema).parquet(f"{path}/results").groupBy("shard").agg(F.count("*").alias("n_out"))
            marks = counts.join(written, "shard", "left").select("n_in", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), "shard")
            marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/done")
        batches += 1

    query = pending.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            raise
    return batches


def finish(spark: SparkSession, path: str) -> DataFrame:
    """The results, after a check that every shard laid out is marked, that it had as many rows as were laid out, and that as
    many results are there as were written; else ``Incomplete``, with how many shards are wrong."""
    laid = spark.read.parquet(f"{path}/pending").groupBy("shard").agg(F.count("*").alias("laid"))
    marks = done_marks(spark, path)
    if not exists(spark, f"{path}/results"):
        raise Incomplete(f"{laid.count()} shards of {path} are not done")
    results = spark.read.parquet(f"{path}/results")
    there = results.groupBy("shard").agg(F.count("*").alias("there"))
    wrong = laid.join(marks, "shard", "full").join(there, "shard", "left").where("laid IS NULL OR n_in IS NULL OR laid <> n_in OR coalesce(there, 0) <> n_out").count()
    if wrong:
        raise Incomplete(f"{wrong} shards of {path} are not done")
    return results.drop("shard")
