"""Token counts by separator scan over flat token files.

A flat file is a run of ids, documents one after another with an end-of-document id after each, cut into blocks that
know nothing of documents. Each block is searched for the separator in numpy; what reaches over block edges is
stitched by a prefix scan over one summary row per block.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import partitions, stored
from loomstone.session import table

TOKENIZERS = "/opt/tokenizers"
#: Ids in a block.
BLOCK = 1 << 18


def read_ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def write_flat(docs: DataFrame, ranks: dict[bytes, int], pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode whole texts into flat files, one a partition: ``file, block, payload, ids``.

    ``payload`` holds little-endian 16-bit ids (32-bit where the separator needs it) and is cut every ``block`` ids,
    wherever that falls. ``ids`` lists the documents that begin in the block; the scan does not read it. A null or
    empty text is a separator alone. The vocabulary travels with the tasks: its size is that of one tokenizer.
    """
    dtype = np.uint16 if separator < 1 << 16 else np.uint32
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark.sql.pandas.types import to_arrow_schema

        vocabulary, rule = shared.value
        tokenizer = tiktoken.Encoding("flat", pat_str=rule, mergeable_ranks=vocabulary, special_tokens={})
        out_schema = to_arrow_schema(schema)
        id_arrow = out_schema.field("ids").type.value_type
        file, number, held, n_held, ids = TaskContext.get().partitionId(), 0, [], 0, []

        def cut(run: np.ndarray, owners: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([run.astype(dtype).tobytes()], pa.binary()), pa.array([owners], pa.list_(id_arrow))], schema=out_schema)

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run = tokenizer.encode_ordinary(text.as_py() or "")
                run.append(separator)
                ids.append(owner)
                held.append(np.array(run, np.uint32))
                n_held += len(run)
                if n_held >= block:
                    flat = np.concatenate(held)
                    while len(flat) >= block:
                        yield cut(flat[:block], ids)
                        number, flat, ids = number + 1, flat[block:], []
                    held, n_held = [flat], len(flat)
        if n_held or ids:
            yield cut(np.concatenate(held), ids)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, schema)


def read_flat(spark: SparkSession, paths: list[str], id_bytes: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of raw flat files: ``file, block, payload``, files numbered in the order given.

    Only names and lengths are listed; every block is read by a task of its own at its place in the file, so a file may
    have any length and no value is larger than a block. Executors open the files through Arrow, which knows local,
    HDFS, S3 and GCS paths. A last odd byte that makes no id is left out; an empty file has no blocks.
    """
    step = block * id_bytes
    listed = None
    for number, path in enumerate(paths):
        one = spark.read.format("binaryFile").load(path).select(F.lit(number).alias("file"), "path", (F.col("length") - F.col("length") % id_bytes).alias("length"))
        listed = one if listed is None else listed.unionByName(one)
    cut = listed.where("length > 0").select("file", "path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step).cast("int"))).alias("block"))
    places = cut.select("file", "block", "path", (F.col("block").cast("long") * step).alias("begin"), F.least(F.lit(step).cast("long"), F.col("length") - F.col("block").cast("long") * step).alias("size"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, number, path, begin, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with system.open_input_file(inner) as f:
                    payload = f.read_at(size, begin)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])

    return places.repartition(partitions(spark) * 4, "file", "block").mapInArrow(read, "file int, block int, payload binary")


#: Blocks of a file whose running sums are made in one place.
RANGE = 4096


def _running(rows: DataFrame, sums: dict[str, str], most: dict[str, str]) -> DataFrame:
    """``rows`` (with ``file, block``) with the sums and maxima over the blocks before: within ranges of ``RANGE``
    blocks, and over one row for each range."""
    rows = rows.withColumn("_range", F.floor(F.col("block") / RANGE))
    inside = W.partitionBy("file", "_range").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("file", "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in most.items()])
    totals = totals.select("file", "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in most])
    for n, c in sums.items():
        rows = rows.withColumn(n, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    for n, c in most.items():
        rows = rows.withColumn(n, F.max(c).over(inside))
    out = rows.join(totals, ["file", "_range"])
    for n in sums:
        out = out.withColumn(n, (F.col(n) + F.col(f"_b_{n}")).cast("long"))
    for n in most:
        out = out.withColumn(n, F.greatest(n, f"_b_{n}"))
    return out.drop("_range", *[f"_b_{n}" for n in (*sums, *most)])


def scan_separators(blocks: DataFrame, separator: int, id_bytes: int = 2) -> DataFrame:
    """``file, ordinal, n_tokens, closed`` for every document of the flat files.

    ``blocks`` has ``file, block, payload``. A document is what stands before a separator; ids after a file's last
    separator are one more document that is not ``closed``; it may be of any length. Two separators in a row enclose an empty document. An
    empty payload, a null payload and an empty table hold no documents.
    """
    dtype = {2: "<u2", 4: "<u4"}[id_bytes]
    schema = "file int, block int, size long, seps long, first long, last long, gaps array<long>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_py() or b"", dtype)
                at = np.flatnonzero(ids == separator).astype(np.int64)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, np.diff(at) - 1))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["file", "block", "size", "seps", "first", "last", "gaps"])

    found = blocks.select(F.col("file").cast("int"), F.col("block").cast("int"), "payload").mapInArrow(search, schema)
    found = stored(found, "separators")
    summary = _running(found.select("file", "block", "size", "seps", "first", "last"), {"begin": "size", "ordinal": "seps"}, {})
    summary = _running(summary.withColumn("_end", F.col("begin") + F.col("last")), {}, {"previous": "_end"}).withColumn("previous", F.coalesce("previous", F.lit(-1).cast("long")))
    summary = summary.select("file", "block", "ordinal", (F.col("begin") + F.col("first") - F.col("previous") - 1).alias("head"), "begin", "size", "seps", "last")
    inner = found.select("file", "block", "gaps").join(summary.where("head is not null").select("file", "block", "ordinal", "head"), ["file", "block"])
    closed = inner.select("file", "ordinal", F.posexplode(F.concat(F.array("head"), "gaps")).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    tail = summary.groupBy("file").agg(F.sum("size").alias("size"), F.sum("seps").alias("ordinal"), F.coalesce(F.max(F.col("begin") + F.col("last")), F.lit(-1).cast("long")).alias("last"))
    tail = tail.where("size - last > 1").select("file", "ordinal", (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, separator: int = 50256, block: int = BLOCK) -> DataFrame:
    """``id, n_tokens`` per input row: texts are written as flat files, which are then scanned for separators.

    Defined cases: null and empty texts have 0 tokens, repeated rows and null ids are counted each for itself, an
    empty table gives an empty result, other columns are not looked at.
    """
    flat = stored(write_flat(docs, read_ranks(folder), _piece_pattern(), separator, id_col, text_col, block), "flat")
    counts = scan_separators(flat.select("file", "block", "payload"), separator)
    begins = _running(flat.select("file", "block", F.size("ids").alias("n")), {"ordinal": "n"}, {}).drop("n")
    owners = flat.select("file", "block", "ids").join(begins, ["file", "block"]).select("file", "ordinal", F.posexplode("ids").alias("k", "id")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "id")
    return owners.join(counts, ["file", "ordinal"]).select("id", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
