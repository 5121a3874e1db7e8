"""Fill-in-middle: texts cut in three at token borders and put in another order, found by a sparse checkpoint index.

A token is a word with the white space before it, or the white space that ends a text. While the tokens of a run of
texts are counted, the byte and code-point offsets of every ``every``-th token's end are recorded. A cut is then found by
binary search among these checkpoints and a short scan from there, so no list of all tokens is ever made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import pieces
from loomstone.session import table

#: Tokens between two checkpoints.
EVERY = 64
#: Bytes that are counted at once, and bytes of texts that make up one batch of results.
SCAN, BATCH = 1 << 20, 1 << 23
MARKS = ("<P>", "<S>", "<M>")

_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Checkpoints(NamedTuple):
    """Places in a run of texts: how many tokens end there or before, and the offsets in bytes and in code points."""

    units: np.ndarray
    bytes: np.ndarray
    points: np.ndarray


def count_units(data: np.ndarray, bounds: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, Checkpoints]:
    """Tokens and code points before each of ``bounds``, and the checkpoints of all texts.

    ``data`` holds the bytes of texts one after another, text ``k`` from ``bounds[k]`` to ``bounds[k + 1]``. It is read in
    blocks of ``SCAN`` bytes. The beginning of every text is a checkpoint, too.
    """
    size = len(data)
    units_at, points_at = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_units = n_points = 0
    for begin in range(0, size, SCAN):
        stop = min(begin + SCAN, size)
        space = _IS_SPACE[data[begin : stop + 1]]
        points = np.cumsum((data[begin:stop] & 0xC0) != 0x80)
        first, last = np.searchsorted(bounds, (begin, stop), side="right")
        inside = bounds[first:last]
        ends = np.union1d(np.flatnonzero(~space[:-1] & space[1:]) + begin + 1, inside)
        upto = n_units + np.arange(1, len(ends) + 1)
        units_at[first:last] = n_units + np.searchsorted(ends, inside, side="right")
        points_at[first:last] = n_points + points[inside - begin - 1]
        picked = upto % every == 0
        found.append((upto[picked], ends[picked], n_points + points[ends[picked] - begin - 1]))
        n_units, n_points = n_units + len(ends), n_points + int(points[-1])
    found.append((units_at, bounds, points_at))
    units, places, points = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.argsort(places, kind="stable")
    return units_at, points_at, Checkpoints(units[order], places[order], points[order])


def locate(data: np.ndarray, index: Checkpoints, target: int, stop: int) -> tuple[int, int]:
    """Byte and code-point offset of the end of token ``target`` of the run, whose text ends at ``stop``."""
    k = int(np.searchsorted(index.units, target, side="right")) - 1
    begin, points, left = int(index.bytes[k]), int(index.points[k]), target - int(index.units[k])
    if not left:
        return begin, points
    end = next(islice(_UNIT.finditer(data, begin, stop), left - 1, None)).end()
    return end, points + int(((data[begin:end] & 0xC0) != 0x80).sum())


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four whole numbers below 2^32 that depend on the seed and the id alone (null id: as if it had no digits)."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(text[:8], 16), int(text[8:16], 16), int(text[16:24], 16), int(text[24:32], 16)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, every: int = EVERY) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` for every row.

    Of the texts, ``rate`` in a hundred are cut after two token ends drawn from seed and id, and of those ``spm_rate`` in a
    hundred have the suffix first (form ``spm``, else ``psm``); the others stay as they are (``plain``). Every row is made by
    itself, so a task that is run again gives the same rows.

    Defined cases: a null text is an empty one; an empty text and a text that contains one of the ``marks`` stay plain,
    whatever was drawn; the two counts of code points are null in plain rows; cuts may fall together or at an end, which
    makes empty parts; texts of any length are cut whole; repeated rows are given the same cuts; a null id is drawn for as
    one without digits; an empty table stays empty; other columns stay, but for those named as the five new ones (in
    either case), which are replaced.
    """
    added = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    passed = [f for f in docs.schema.fields if f.name.lower() not in added]
    schema = T.StructType([*passed, *[T.StructField(n, t) for n, t in added.items()]])
    before, between, after = (m.encode() for m in marks)

    def cut(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        units_at, points_at, index = count_units(data, bounds, every)
        counts = np.diff(units_at)
        forms, heads, middles, outputs = [], [], [], []
        for k, doc_id in enumerate(ids.to_pylist()):
            begin, stop = int(bounds[k]), int(bounds[k + 1])
            text, n = data[begin:stop].tobytes(), int(counts[k])
            h1, h2, h3, h4 = draws(seed, doc_id)
            if not text or h3 % 100 >= rate or before in text or between in text or after in text:
                forms.append("plain")
                heads.append(None)
                middles.append(None)
                outputs.append(text)
                continue
            one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
            (p, p_points), (m, m_points) = (locate(data, index, int(units_at[k]) + c, stop) for c in (one, two))
            prefix, middle, suffix = text[: p - begin], text[p - begin : m - begin], text[m - begin :]
            spm = h4 % 100 < spm_rate
            forms.append("spm" if spm else "psm")
            heads.append(p_points - int(points_at[k]))
            middles.append(m_points - p_points)
            outputs.append(b"".join((between, suffix, before, prefix, after, middle) if spm else (before, prefix, between, suffix, after, middle)))
        return [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).view(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for begin, stop in pieces(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH):
                part = batch.slice(begin, stop - begin)
                made = cut(part.column(part.num_columns - 2), part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names=names)

    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    rows = docs.select(*[quoted(f.name) for f in passed], F.col(id_col).cast("string").alias("__ls_id"), F.col(text_col).alias("__ls_text"))
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a row of ``fill_in_middle`` was made from. A cut text holds each mark once, so its parts are what
    stands between them: prefix, suffix and middle, or suffix, prefix and middle."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    swapped = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(swapped)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": _SQL}
