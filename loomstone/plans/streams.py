"""Online statistics: batch forms with SQL counterparts, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.plans.base import Plans
from loomstone.operators.relational import last_wins
from loomstone.session import scratch, table
from loomstone.sources.sinks import exists
from loomstone.streaming import state as S

plans = Plans()


def _run(stream, mode: str, key: str | None = None):
    """Run a stream over what is there and return its result table.

    Batches are written under the shared folder by their numbers, so a batch that is done again replaces itself and
    nothing passes the driver. Of updates the last of each ``key`` counts, of complete results the last batch.
    """
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def put(batch, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not exists(spark, path):
        return spark.createDataFrame([], stream.schema)
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    out = spark.read.schema(schema).parquet(f"{path}/batch-*")
    if mode == "update":
        return last_wins(out, [key], "_batch").select(*stream.columns)
    if mode == "complete":
        out = out.where(F.col("_batch") == out.agg(F.max("_batch")).head()[0])
    return out.drop("_batch")


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@plans.add("ring_buffers", "SELECT user_id, count(*) AS size, round(sum(value), 6) AS total, round(arg_max(value, event_id), 6) AS last FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 32) GROUP BY 1")
def ring_buffers(spark, sf):
    """Buffers of 32 entries per key after all of a stream's batches."""
    out = _run(S.ring_buffer(_events(spark, sf), "user_id", "event_id", "value", 32), "update", "user_id")
    return out.select("user_id", "size", F.round("total", 6).alias("total"), F.round("last", 6).alias("last"))


@plans.add("stream_averages", "SELECT user_id, count(*) AS n, round(sum(0.1 * pow(0.9, c - r) * value), 6) AS average FROM (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY 1")
def stream_averages(spark, sf):
    out = _run(S.moving_average(_events(spark, sf), "user_id", "event_id", "value", 0.9), "update", "user_id")
    return out.select("user_id", "n", F.round("average", 6).alias("average"))


@plans.add("running_bests", "SELECT event_type, min(value) AS best, count(*) AS n FROM events GROUP BY 1")
def running_bests(spark, sf):
    return _run(S.running_best(_events(spark, sf), "event_type", "value"), "complete")


@plans.add("first_of_keys", "SELECT DISTINCT user_id, event_type FROM events")
def first_of_keys(spark, sf):
    """Keys of a stream once each."""
    return _run(S.once_per_key(_events(spark, sf), ["user_id", "event_type"], "ts", "3650 days"), "append").select("user_id", "event_type")


@plans.add("next_thresholds", "SELECT event_id, (event_id // 250 + 1) * 250 AS next FROM events")
def next_thresholds(spark, sf):
    return table(spark, sf, "events").select("event_id", S.next_threshold(F.col("event_id"), 250).alias("next"))


@plans.add("tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    """Beyond the evaluated pipelines: hourly event-time windows."""
    t = S.tumbling_counts(table(spark, sf, "events"), "ts", "1 hour", "event_type")
    return t.select("start", "event_type", "n", F.round("total", 6).alias("total"))


@plans.add("session_windows", "WITH s AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes')::INT AS new FROM events), g AS (SELECT user_id, ts, coalesce(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS k FROM s) SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark, sf):
    """Beyond the evaluated pipelines: sessions that end after thirty quiet minutes."""
    return S.session_counts(table(spark, sf, "events"), "ts", "30 minutes", "user_id")


@plans.add("stream_progress", "SELECT 'counted' AS name, count(*)::BIGINT AS n_rows, true AS has_batches FROM events")
def stream_progress(spark, sf):
    """Rows a batch of a stream, as a listener wrote them to a table while it ran: they add up to the input."""
    from loomstone.streaming.progress import ProgressTable, progress_rows

    path = scratch(spark, "progress")
    listener = ProgressTable(spark, f"{path}/rows")
    spark.streams.addListener(listener)
    try:
        counted = S.running_best(_events(spark, sf), "event_type", "value")
        writer = counted.writeStream.queryName("counted").outputMode("complete").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out-{number}"))
        query = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    rows = progress_rows(spark, f"{path}/rows")
    return rows.groupBy("name").agg(F.sum("rows").alias("n_rows"), (F.count_distinct("batch") > 0).alias("has_batches"))
