"""Progress of streams as rows of a table."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from loomstone.sources.sinks import write_bytes

SCHEMA = "run string, name string, batch long, at string, rows long, duration_ms long, rows_per_second double"


class ProgressTable(StreamingQueryListener):
    """Writes a small file for each batch of every stream of the session, under ``path``; a batch told twice replaces
    itself. ``wait`` gives the bus time to tell of the end of a query."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"run": str(p.runId), "name": p.name, "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "duration_ms": p.batchDuration, "rows_per_second": p.processedRowsPerSecond}
        write_bytes(self.spark, f"{self.path}/{row['run']}-{row['batch']:012d}.json", json.dumps(row).encode())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait(self, run: str, seconds: float = 30.0) -> bool:
        until = time.monotonic() + seconds
        while run not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return run in self.ended


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
