"""Readers of line files, tables with malformed rows, record caches, token blocks and maps."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import strip
from loomstone.operators.packing import row_numbers

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}


def register(*names: str) -> Callable[[Reader], Reader]:
    """Give a reader its names."""

    def add(f: Reader) -> Reader:
        _READERS.update(dict.fromkeys(names, f))
        return f

    return add


def read(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """Read by the name of a format."""
    if name not in _READERS:
        raise KeyError(f"no reader is called {name!r}; there are {sorted(_READERS)}")
    return _READERS[name](spark, *args, **options)


def first_readable(spark: SparkSession, places: list[str], form: str = "parquet") -> DataFrame:
    """The first of several places that can be read."""
    missed = []
    for place in places:
        try:
            return spark.read.format(form).load(place)
        except AnalysisException as error:
            missed.append(f"{place}: {error.getCondition()}")
    raise FileNotFoundError("; ".join(missed))


@register("lines", "text")
def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text``: stripped lines that are not blank; bytes that are no UTF-8 are replaced by Spark's reader."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")


@register("bytes")
def decode_bytes(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A binary column as UTF-8 text."""
    return spark.read.parquet(path).withColumn(column, F.decode(column, "UTF-8"))


@register("durations")
def read_durations(spark: SparkSession, path: str, least: float = 0.0, most: float = 32.0, first: int | None = None) -> DataFrame:
    """``sample_id, seconds``: rows of two columns whose second is a number within the inclusive range. A header and
    malformed rows are passed over. With ``first``, the rows up to the place in the files where so many distinct ids
    have been seen, the row of the last of them included."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.text(path).select(F.split("value", ",").alias("c"), place.alias("at")).where(F.size("c") >= 2)
    rows = rows.select(strip(F.col("c")[0]).alias("sample_id"), strip(F.col("c")[1]).try_cast("double").alias("seconds"), "at")
    rows = rows.where(F.col("seconds").between(least, most))
    return (rows if first is None else until_distinct(rows, "sample_id", "at", first)).select("sample_id", "seconds")


def until_distinct(rows: DataFrame, key: str, order: str, first: int) -> DataFrame:
    """Rows in order up to that in which the ``first``-th distinct key occurs for the first time."""
    starts = rows.groupBy(key).agg(F.min(order).alias("_start")).orderBy("_start").limit(first)
    last = F.broadcast(starts.agg(F.max("_start").alias("_last"), F.count("*").alias("_n")))  # one row
    return rows.crossJoin(last).where((F.col("_n") < first) | (F.col(order) <= F.col("_last"))).drop("_last", "_n")


#: ``train``, ``train[:100]``, ``train[-100:]``, ``train[10%:20%]``
_SLICE = re.compile(r"(\w+)(?:\[(-?\d+%?)?:(-?\d+%?)?\])?")


def read_split(splits: dict[str, DataFrame], spec: str, order: str) -> DataFrame:
    """The rows of a split in slice syntax: places in order of a unique whole-number key, negative ones from the end,
    per cent of all rows rounded to the nearest."""
    found = _SLICE.fullmatch(spec.strip())
    if not found or found[1] not in splits:
        raise ValueError(f"{spec!r} names no slice of {sorted(splits)}")
    df = splits[found[1]]
    if found[2] is None and found[3] is None:
        return df
    n = df.count()

    def place(text: str | None, default: int) -> int:
        if text is None:
            return default
        k = round(int(text[:-1]) * n / 100) if text.endswith("%") else int(text)
        return min(n, max(0, k + n if k < 0 else k))

    begin, end = place(found[2], 0), place(found[3], n)
    return row_numbers(df, order, "_row").where((F.col("_row") >= begin) & (F.col("_row") < end)).drop("_row")


@register("held_out")
def read_held_out(spark: SparkSession, path: str) -> DataFrame:
    """``speaker_id, sample_id``; of several rows of a speaker the last in the file counts."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("c"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")).where(F.size("c") >= 2)
    rows = rows.select(strip(F.col("c")[0]).alias("speaker_id"), strip(F.col("c")[1]).alias("sample_id"), "at")
    return rows.groupBy("speaker_id").agg(F.max_by("sample_id", "at").alias("sample_id"))


# The columns of a generation record.
RECORD = "prompt string, suffix string, full string, ref_prompt string, ref_suffix string, ref_full string, gen_bits array<int>, ref_bits array<int>, gen_tokens array<int>, ref_tokens array<int>, _meta map<string,string>"


@register("records", "jsonl")
def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of all ``.jsonl`` files below a folder with their ``path``, and the files' headers (``path, meta``)."""
    rows = spark.read.schema(RECORD).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.where("_meta is null").drop("_meta"), rows.where("_meta is not null").select("path", F.col("_meta").alias("meta"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, length`` of the files below a folder, contents not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length").orderBy("path")


@register("blocks")
def read_blocks(spark: SparkSession, path: str, width: int, bytes_each: int = 2, rows_each: int = 4096) -> DataFrame:
    """``file, seq_id, ids``: raw little-endian id matrices of ``width`` ids a row; a broken last row is an error.

    Only names and lengths are listed. Every task reads runs of ``rows_each`` rows at their places, so a file may have
    any length. Executors open the files through Arrow, which knows local, HDFS, S3 and GCS paths.
    """
    dtype, row = {2: "<u2", 4: "<u4"}[bytes_each], width * bytes_each
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    whole = F.when(F.col("length") % row == 0, F.floor(F.col("length") / row)).otherwise(F.raise_error(F.lit("the last row is broken")).cast("long"))
    listed = listed.withColumn("n", whole).where("n > 0")
    places = listed.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_each).cast("long"))).alias("begin"))

    def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, file = None, None
        for batch in batches:
            names, seqs, parts, rows = [], [], [], 0
            for at, n, begin in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if at != name:  # runs of a file follow one another
                    if file is not None:
                        file.close()
                    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", at))
                    name, file = at, system.open_input_file(inner)
                ids = np.frombuffer(file.read_at(min(rows_each, n - begin) * row, begin * row), dtype).astype(np.int64)
                names.append(np.repeat(np.array([at], object), len(ids) // width))
                seqs.append(begin + np.arange(len(ids) // width))
                parts.append(ids)
                rows += len(seqs[-1])
                if rows >= 4096:
                    yield _block_rows(names, seqs, parts, width)
                    names, seqs, parts, rows = [], [], [], 0
            if rows:
                yield _block_rows(names, seqs, parts, width)
        if file is not None:
            file.close()

    dealt = places.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "path", F.floor(F.col("begin") / (1 << 16))).sortWithinPartitions("path", "begin")
    return dealt.mapInArrow(read_rows, "file string, seq_id long, ids array<long>")


def _block_rows(names: list[np.ndarray], seqs: list[np.ndarray], parts: list[np.ndarray], width: int) -> pa.RecordBatch:
    seq, ids = np.concatenate(seqs), np.concatenate(parts)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, width), pa.int32()), pa.array(ids))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names), pa.string()), pa.array(seq), lists], names=["file", "seq_id", "ids"])


@register("shaped_blocks")
def read_shaped(spark: SparkSession, path: str, sidecar: str) -> DataFrame:
    """A raw id file whose JSON sidecar tells its shape (``shape``: rows and width, or the length alone) and ``dtype``."""
    meta = json.loads(spark.read.text(sidecar, wholetext=True).head()[0])
    shape = meta["shape"]
    return read_blocks(spark, path, shape[1] if len(shape) > 1 else 1, {"uint16": 2, "uint32": 4}[meta.get("dtype", "uint16")])


@register("id_map")
def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``old_id, new_id`` from JSON objects with text keys, one a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("k", "new_id")).select(F.col("k").cast("int").alias("old_id"), "new_id")


@register("merges")
def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``path, rank, merge`` of tokenizer files; a model of another type than BPE is an error."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "model struct<type:string,merges:array<string>>").alias("j"))
    text = text.where(F.when(F.col("j.model.type") == "BPE", True).otherwise(F.raise_error(F.lit("the model is not BPE")).cast("boolean")))
    return text.select("path", F.posexplode("j.model.merges").alias("rank", "merge"))


@register("schedule")
def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """A stored schedule table; a missing one is an error, never a silent other schedule."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"there is no schedule at {path}") from error


def project_audio(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The same columns of several subsets, with the subset's name."""
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("subset"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def probe_seconds(frames, rate):
    """Duration from a header's numbers."""
    return frames / rate
