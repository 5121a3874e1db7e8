"""Session construction and the table reader shared by every query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer on."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(master).appName("loomstone")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where a local session names none (tests), a local one is set; a cluster
    must name one, since its executors would write to folders that the others do not see."""
    path = spark.conf.get(_CHECKPOINT, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_CHECKPOINT} must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set(_CHECKPOINT, path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
