"""WAV files: a sink that executors write, and a data source that reads headers only.

A header names the format and how long the data is; the samples themselves are skipped, so a file costs some tens of bytes
whatever its length. Files are opened through Arrow, which knows local, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that one task looks at, and bytes read of a file at most before its data begins (chunks before it are skipped).
FILES_EACH, MOST_HEADERS = 256, 4096


def open_place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if re.match(r"^[a-z0-9+.-]+:/", uri) else f"file://{uri}"))


def parse_header(read) -> tuple[dict, int]:
    """Format of a RIFF file and how many bytes of it were looked at. ``read(place, size)`` gives bytes of the file.

    Chunks are passed over by their sizes until the data begins. A file that is none, breaks off, or has more than
    ``MOST_HEADERS`` bytes of chunk headers gives an ``error`` instead.
    """
    used = 0

    def take(place: int, size: int) -> bytes:
        nonlocal used
        part = read(place, size)
        used += len(part)
        if len(part) < size:
            raise ValueError("the header breaks off")
        return part

    try:
        head = take(0, 12)
        if head[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise ValueError("no RIFF WAVE file")
        place, form = 12, None
        while used < MOST_HEADERS:
            name, size = struct.unpack("<4sI", take(place, 8))
            if name == b"fmt ":
                form = struct.unpack("<HHIIHH", take(place + 8, 16))
            elif name == b"data":
                if form is None or not form[2] or not form[4]:
                    raise ValueError("no format before the data")
                frames = size // form[4]
                return {"channels": form[1], "rate": form[2], "bits": form[5], "frames": frames, "seconds": frames / form[2]}, used
            place += 8 + size + size % 2
        raise ValueError("no data")
    except ValueError as error:
        return {"error": str(error)}, used


@dataclass
class _Ranges(InputPartition):
    """Byte ranges, one a file, that one task may read: from the file's start to ``stop``."""

    paths: list[str]
    stops: list[int]


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str, each: int):
        self.path, self.each = path, each

    def partitions(self) -> list[_Ranges]:
        from pyarrow import fs

        system, inner = open_place(self.path)
        scheme = re.match(r"^[a-z0-9+.-]+:/+", self.path)
        found = system.get_file_info([inner]) if system.get_file_info(inner).type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        lead = (scheme.group(0) if not self.path.startswith("file:") else "file://") if scheme else ""
        return [_Ranges([lead + p for p, _ in part], [s for _, s in part]) for k in range(0, len(files), self.each) for part in [files[k : k + self.each]]] or [_Ranges([], [])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        names = ["channels", "rate", "bits", "frames", "seconds", "error"]
        rows = []
        for path, size in zip(partition.paths, partition.stops, strict=True):
            system, inner = open_place(path)
            with system.open_input_file(inner) as f:
                found, used = parse_header(lambda place, n, f=f, size=size: f.read_at(max(0, min(n, size - place)), place))
            rows.append((path, size, used, *[found.get(n) for n in names]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "bytes_read", *names])


class WaveHeaders(DataSource):
    """``spark.read.format("wave_headers").load(folder)``: a row for each WAV file under a folder."""

    @classmethod
    def name(cls) -> str:
        return "wave_headers"

    def schema(self) -> str:
        return "path string, length long, bytes_read long, channels int, rate int, bits int, frames long, seconds double, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options["path"], int(self.options.get("filesEach", FILES_EACH)))


def read_headers(spark: SparkSession, path: str, files_each: int = FILES_EACH) -> DataFrame:
    """Headers of all WAV files under ``path``; names and lengths are listed, ``files_each`` files make a task."""
    spark.dataSource.register(WaveHeaders)
    return spark.read.format("wave_headers").option("filesEach", files_each).load(path)


def write_waves(rows: DataFrame, path: str, name: str, samples: str, rate: str) -> DataFrame:
    """Write one 16-bit mono file for each row, ``<name>.wav`` under ``path``; ``name, frames`` of what was written.

    Samples between -1 and 1 are multiplied by 32767 and cut to whole numbers; others are held to that range, missing
    ones are silent. The result must be read for the files to be written, and a task that runs again writes the same.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = open_place(path)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            frames = []
            for k, (label, hertz) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                values = batch.column(1)[k].values
                x = np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype(float)
                data = np.trunc(np.clip(np.nan_to_num(x, nan=0.0), -1, 1) * 32767).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, hertz, hertz * 2, 2, 16, b"data", len(data))
                with system.open_output_stream(f"{inner}/{label}.wav") as f:
                    f.write(head + data)
                frames.append(len(data) // 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.int64())], names=["name", "frames"])

    return rows.selectExpr(f"CAST(`{name}` AS STRING) AS name", f"CAST(`{samples}` AS ARRAY<DOUBLE>) AS samples", f"CAST(`{rate}` AS INT) AS rate").mapInArrow(put, "name string, frames long")
