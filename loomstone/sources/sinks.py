"""Writers: packed caches with statistics, results, records, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import html_escape


def exists(df_or_spark, path: str) -> bool:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm))


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write Parquet unless a finished table is there already; whether it wrote. Spark publishes a job's files at its
    end only, so readers see the old table or the new one."""
    if not force and exists(df, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_packed(blocks: DataFrame, statistics: DataFrame, path: str, **settings: str) -> None:
    """Packed blocks beside a one-row table of their statistics and settings."""
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    statistics.select("*", *[F.lit(v).alias(k) for k, v in settings.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def checked_lengths(rows: DataFrame, ids: str, most: int) -> DataFrame:
    """Rows with their length; a longer one is an error instead of being cut."""
    fits = F.when(F.size(ids) <= most, True).otherwise(F.raise_error(F.lit("a row is longer than its place")).cast("boolean"))
    return rows.where(fits).withColumn("length", F.size(ids))


def append_results(rows: DataFrame, path: str) -> None:
    """Long-format result rows, kept apart by metric so that later reads prune."""
    rows.write.mode("append").partitionBy("metric").parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def recover(spark: SparkSession, path: str) -> None:
    """Put back the old table where a replacement broke off between taking it away and putting the new one in place."""
    files, at = _file_system(spark, path)
    if not files.exists(at(path)) and files.exists(at(f"{path}.old")):
        files.rename(at(f"{path}.old"), at(path))


def rewrite_results(rows: DataFrame, path: str, staging: str | None = None) -> None:
    """Replace a result table that ``rows`` may be computed from: the new one is written aside and renamed into place.

    The old table is renamed away first and removed last, so a run that breaks off leaves one of the two whole;
    ``recover`` puts the old one back where the new one did not arrive.
    """
    spark = rows.sparkSession
    recover(spark, path)
    files, at = _file_system(spark, path)
    staging = staging or f"{path}.new"
    rows.write.mode("overwrite").parquet(staging)
    files.delete(at(f"{path}.old"), True)
    if files.exists(at(path)) and not files.rename(at(path), at(f"{path}.old")):
        raise OSError(f"cannot rename {path}")
    if not files.rename(at(staging), at(path)):
        recover(spark, path)
        raise OSError(f"cannot rename {staging}")
    files.delete(at(f"{path}.old"), True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file as it is, such as a sidecar or an id matrix, in any store Spark writes to."""
    files, at = _file_system(spark, path)
    out = files.create(at(path), True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_files(rows: DataFrame, path: str, name: str, content: str) -> int:
    """Write one file for each row, named by ``name`` (slashes make folders) with the bytes or text of ``content``, from
    the executors; the number of files. A null content is an empty file, a null name an error. Of rows with one name the
    last to be written stays; a task that runs again writes the same files."""
    from loomstone.sources.wave import open_place

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = open_place(path)
        made = set()
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{inner}/{label}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{inner}/{label}") as f:
                    f.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    named = F.when(F.col(name).isNull(), F.raise_error(F.lit("a file has no name")).cast("string")).otherwise(F.col(name).cast("string"))
    written = rows.select(named.alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(put, "n long")
    return int(written.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0])


def write_manifests(rows: DataFrame, path: str, key: str, settings: list[str]) -> int:
    """A manifest for each row, ``<key>.json``: the columns that its cache key stands for (names in order)."""
    text = F.to_json(F.struct(F.col(key).alias("key"), F.struct(*sorted(settings)).alias("settings")), {"ignoreNullFields": "false"})
    return write_files(rows.select(F.concat(F.col(key), F.lit(".json")).alias("name"), text.alias("content")), path, "name", "content")


def write_manifest(spark: SparkSession, path: str, key: str, settings: dict) -> None:
    """The settings that a cache key stands for, as JSON beside the data (names in order)."""
    write_bytes(spark, path, json.dumps({"key": key, "settings": settings}, sort_keys=True, ensure_ascii=False).encode())


def write_summary(rows: DataFrame, path: str) -> None:
    """A small table as CSV and as JSON, one file each, in order of columns."""
    ordered = rows.select(*sorted(rows.columns)).coalesce(1)
    ordered.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    ordered.write.mode("overwrite").json(f"{path}/json")


def write_records(rows: DataFrame, path: str) -> None:
    """Generation records, by checkpoint and split."""
    rows.write.mode("overwrite").partitionBy("checkpoint", "split").option("compression", "none").json(path)


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``html``: one escaped table row per input row."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def html_report(rows: DataFrame, columns: list[str], title: str, most: int = 10_000) -> str:
    """A page with a table; a report of more than ``most`` rows is refused."""
    body = [r["html"] for r in html_rows(rows, columns).limit(most + 1).collect()]
    if len(body) > most:
        raise ValueError(f"a report has {most} rows at the most")
    head = "".join(f"<th>{c}</th>" for c in columns)
    return f"<!doctype html><title>{title}</title><table><tr>{head}</tr>{''.join(body)}</table>"
