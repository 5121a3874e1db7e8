"""State of online statistics: ring buffers, moving averages, running bests, refreshed schedules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.operators.schedule import density, rate_bins


def ring_buffer(stream: DataFrame, key: str, order: str, value: str, capacity: int) -> DataFrame:
    """``key, size, total, last``: after each batch, how much each key's buffer holds, its sum and its newest entry.

    A buffer keeps the last ``capacity`` entries in order of arrival, within a batch by ``order``.
    """
    kind = dict(stream.dtypes)

    def push(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        fresh = pd.concat([b[[order, value]] for b in batches]).sort_values(order)
        held = (held + fresh[value].tolist())[-capacity:]
        state.update((held,))
        yield pd.DataFrame({key: [group[0]], "size": [len(held)], "total": [float(sum(held))], "last": [float(held[-1])]})

    return stream.groupBy(key).applyInPandasWithState(push, f"`{key}` {kind[key]}, size long, total double, last double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def moving_average(stream: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """``key, n, average``: an exponential moving average that starts at zero, after each batch."""
    kind = dict(stream.dtypes)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        for x in pd.concat([b[[order, value]] for b in batches]).sort_values(order)[value]:
            n, average = n + 1, decay * average + (1 - decay) * float(x)
        state.update((n, average))
        yield pd.DataFrame({key: [group[0]], "n": [n], "average": [average]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind[key]}, n long, average double", "n long, average double", "update", GroupStateTimeout.NoTimeout)


def running_best(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Best value so far per key."""
    return stream.groupBy(key).agg(F.min(value).alias("best"), F.count("*").alias("n"))


def once_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def schedule_refresher(path: str, sigma: str, metric: str, low: float, high: float, bins: int, capacity: int, least: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last ``capacity`` samples and, once ``least`` are there, publishes the
    schedule they make under ``path``.

    Each batch writes its own numbered folder, so a repeated batch replaces what it had written; ``seq`` orders the
    samples.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("seq", sigma, metric)
        if number > 0:
            new = new.unionByName(spark.read.parquet(f"{path}/samples-{number - 1}"))
        new.orderBy(F.desc("seq")).limit(capacity).write.mode("overwrite").parquet(f"{path}/samples-{number}")
        kept = spark.read.parquet(f"{path}/samples-{number}")
        if kept.count() >= least:
            density(rate_bins(kept, sigma, metric, low, high, bins)).write.mode("overwrite").parquet(f"{path}/schedule-{number}")

    return refresh


def next_threshold(step, every: int):
    """The next multiple of ``every`` after a step."""
    return (F.floor(step / every) + 1) * every


# Beyond what the evaluated pipelines need: event-time windows, as Spark has them.


def tumbling_counts(events: DataFrame, time: str, width: str, key: str) -> DataFrame:
    """Counts and sums per event-time window, in batch or stream."""
    source = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, width) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    source = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, gap) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
