"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping segments. A text region within ``e`` edits of a segment of ``L`` characters
shares at least ``L - q + 1 - q * e`` of its q-grams, on diagonals that differ by at most ``e``. Windows with too few
benchmark q-grams of any kind are passed over; in the rest, shared q-grams are counted in overlapping bands of
diagonals, and bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomstone.llm.common import mix, narrowed, pieces, stored
from loomstone.session import table

Q, SEGMENT, STRIDE = 8, 80, 40
#: Edits allowed per character of a segment; items of fewer than ``LEAST_CHARS`` characters are found where they stand
#: unedited as whole words, those of fewer than ``LEAST_EXACT`` not at all: they are single common words.
EDITS, LEAST_CHARS, LEAST_EXACT = 0.08, 24, 5
#: Characters of benchmark text that go with the tasks at once; a larger benchmark is handled block by block.
BLOCK_CHARS = 4_000_000
TABLE_BITS = 24
_GAP = 16


def _fold() -> np.ndarray:
    """Code point to lower-cased letter or digit, or 32; code points above the table stand for themselves."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def normalise(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with runs of others as one space, and where each stands in ``points``. Code point 0 is a gap
    between texts and is kept as it is."""
    if not _FOLD:
        _FOLD.append(_fold())
    folded = np.where(points < 1 << 16, _FOLD[0][np.minimum(points, (1 << 16) - 1)], points)
    folded[points == 0] = 0
    space = folded == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] = True
    at = np.flatnonzero(keep)
    return folded[at], at


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the q-gram at every place."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        b = np.uint32(0x01000193)
        h = x * np.uint32(0x85EBCA6B) ^ (x >> np.uint32(3))
        width = 1
        while width < Q:
            h = h[:-width] * b + h[width:]
            b = b * b
            width *= 2
        h = h[:n]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return h ^ (h >> np.uint32(13))


@dataclass
class Segments:
    """Segments of a block of items, and the places of their q-grams in order of hash."""

    item: np.ndarray
    text: np.ndarray  # [segment, SEGMENT], filled up with 1
    length: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    known: np.ndarray
    classes: list[tuple[int, int]]  # (window, least hits) by length class
    short: dict[int, dict[int, list[tuple[int, bytes]]]]  # by length and hash: (item, characters) of short items


def run_hashes(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` characters that begin at ``starts``."""
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + x[starts + k].astype(np.uint64) + np.uint64(1))
    return h


def find_short(x: np.ndarray, seg: Segments) -> list[tuple[int, int, int]]:
    """``(item, start, end)`` of short items that stand in ``x`` (normalised) as whole words."""
    if not seg.short or not len(x):
        return []
    edge = (x == 32) | (x == 0)
    begins = np.flatnonzero(~edge & np.concatenate(([True], edge[:-1])))
    ended = np.append(edge, True)
    out = []
    for length, known in seg.short.items():
        at = begins[begins + length <= len(x)]
        at = at[ended[at + length]]
        hashes = run_hashes(x, at, length)
        for k in np.flatnonzero(np.isin(hashes, np.fromiter(known, np.uint64, len(known)))):
            begin = int(at[k])
            out += [(item, begin, begin + length) for item, chars in known[int(hashes[k])] if x[begin : begin + length].tobytes() == chars]
    return out


def cut_segments(items: list[tuple[int, str | None]]) -> Segments:
    item, runs = [], []
    short: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
    for number, text in items:
        x = normalise(_points((text or "").strip()))[0] if text else np.zeros(0, np.uint32)
        x = x[1:] if len(x) and x[0] == 32 else x
        x = x[:-1] if len(x) and x[-1] == 32 else x
        if len(x) < LEAST_CHARS:
            if len(x) >= LEAST_EXACT:
                short.setdefault(len(x), {}).setdefault(int(run_hashes(x, np.zeros(1, np.int64), len(x))[0]), []).append((number, x.tobytes()))
            continue
        starts = list(range(0, max(1, len(x) - SEGMENT + 1), STRIDE))
        if len(x) > SEGMENT and starts[-1] + SEGMENT < len(x):
            starts.append(len(x) - SEGMENT)
        for s in starts:
            item.append(number)
            runs.append(x[s : s + SEGMENT])
    n = len(runs)
    length = np.array([len(r) for r in runs], np.int64).reshape(n)
    edits = np.floor(length * EDITS).astype(np.int64)
    bound = np.maximum(1, length - Q + 1 - Q * edits)
    text = np.ones((n, SEGMENT), np.uint32)
    hashes, owner, place = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, r in enumerate(runs):
        text[k, : len(r)] = r
        h = gram_hashes(r)
        hashes.append(h)
        owner.append(np.full(len(h), k))
        place.append(np.arange(len(h)))
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    h, o, p = h[order], o[order], p[order]
    grams, first = np.unique(h, return_index=True)
    known = np.zeros(1 << TABLE_BITS, bool)
    known[grams >> np.uint32(32 - TABLE_BITS)] = True
    classes = []
    for low, high in ((LEAST_CHARS, 40), (40, 60), (60, SEGMENT), (SEGMENT, SEGMENT + 1)):
        which = (length >= low) & (length < high)
        if which.any():
            classes.append((int((length + edits)[which].max()), int(bound[which].min())))
    return Segments(np.array(item, np.int64), text, length, edits, bound, grams, np.append(first, len(h)), o, p, known, classes, short)


def _aligned(seg: Segments, which: np.ndarray, x: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Least edits between each segment and a run of ``x`` that begins on diagonals ``low .. low + width``."""
    reach = int(seg.edits[which].max())
    band = width + 2 * reach + 1
    offset = np.arange(band)
    start = low - reach
    row = np.zeros((len(which), band), np.int32)
    best = np.full(len(which), 1 << 20)
    slope = np.arange(band, dtype=np.int32)
    for i in range(int(seg.length[which].max())):
        at = start[:, None] + i + offset
        char = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], 2)
        diagonal = row + (char != seg.text[which, i][:, None])
        above = np.concatenate((row[:, 1:] + 1, np.full((len(which), 1), 1 << 20, np.int32)), axis=1)
        new = np.minimum(diagonal, above)
        row = (np.minimum.accumulate(new - slope, axis=1) + slope).astype(np.int32)
        ended = seg.length[which] == i + 1
        best[ended] = row[ended].min(axis=1)
    return best


def find_regions(x: np.ndarray, seg: Segments) -> list[tuple[int, int, int, int]]:
    """``(segment, start, end, edits)`` of regions of ``x`` (normalised) that are within a segment's edit budget."""
    h = gram_hashes(x)
    if not len(h) or not len(seg.item):
        return []
    hit = seg.known[h >> np.uint32(32 - TABLE_BITS)]
    total = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
    spread = np.zeros(len(h) + 1, np.int32)
    for window, least in seg.classes:
        w = min(window, len(h))
        full = np.flatnonzero(total[w:] - total[:-w] >= least)
        np.add.at(spread, full, 1)
        np.add.at(spread, full + w, -1)
    places = np.flatnonzero(hit & (np.cumsum(spread)[:-1] > 0))
    if not len(places):
        return []
    g = np.searchsorted(seg.grams, h[places])
    found = (g < len(seg.grams)) & (seg.grams[np.minimum(g, len(seg.grams) - 1)] == h[places])
    places, g = places[found], g[found]
    out: list[tuple[int, int, int, int]] = []
    # Postings are handled in runs of places, so a text of nothing but benchmark text does not fill the memory; runs
    # overlap by more than a segment.
    weight = seg.first[g + 1] - seg.first[g]
    run_of = np.cumsum(weight) // 2_000_000 if len(g) else np.zeros(0, int)
    for run in np.unique(run_of):
        mine = np.flatnonzero(run_of == run)
        begin = np.searchsorted(places, places[mine[0]] - 3 * SEGMENT)
        mine = np.arange(begin, mine[-1] + 1)
        counts = weight[mine]
        source = np.repeat(mine, counts)
        posting = np.repeat(seg.first[g[mine]], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = seg.owner[posting]
        diagonal = places[source] - seg.place[posting] + SEGMENT
        step = int(seg.edits.max()) + 1
        # Bands of two steps, each step in two bands, so any run of diagonals within the budget lies in one of them.
        pair_key = np.concatenate((diagonal // step, diagonal // step + 1))
        pair_owner = np.concatenate((owner, owner))
        code = pair_owner.astype(np.int64) * (1 << 33) + pair_key
        code, n = np.unique(code, return_counts=True)
        which, band = code >> 33, code & ((1 << 33) - 1)
        enough = n >= seg.bound[which]
        which, low = which[enough], (band[enough] - 1) * step - SEGMENT
        for begin in range(0, len(which), 512):
            part, at = which[begin : begin + 512], low[begin : begin + 512]
            edits = _aligned(seg, part, x, at, 2 * step)
            for s, a, e in zip(part, at, edits, strict=True):
                if e <= seg.edits[s]:
                    out.append((int(s), max(0, int(a)), min(len(x), int(a + 2 * step + seg.length[s])), int(e)))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_batch(texts: list[str | None], seg: Segments) -> list[tuple[int, int, int, int]]:
    """``(text number, item, start, end)``: regions of whole texts, in code points, merged per item."""
    out = []
    for begin, end in pieces([len(t or "") for t in texts], 1 << 20):
        runs, starts, at = [], [], 0
        gap = np.zeros(_GAP, np.uint32)
        for t in texts[begin:end]:
            p = _points(t or "")
            starts.append(at)
            runs += [np.where(p == 0, 32, p), gap]
            at += len(p) + _GAP
        if not at:
            continue
        x, where = normalise(np.concatenate(runs))
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, a, b in [(int(seg.item[s]), a, b) for s, a, b, _ in find_regions(x, seg)] + find_short(x, seg):
            middle = int(where[(a + b - 1) // 2])
            row = int(np.searchsorted(starts, middle, side="right")) - 1
            lo, hi = starts[row], starts[row] + len(texts[begin + row] or "")
            span = max(lo, int(where[a])) - lo, min(hi, int(where[b - 1]) + 1) - lo
            hits.setdefault((begin + row, item), []).append(span)
        out += [(row, item, a, b) for (row, item), spans in sorted(hits.items()) for a, b in _merged(spans)]
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    yield held


#: Segments of the blocks that this worker process has cut, so that its tasks share them.
_CUT: dict[str, Segments] = {}


def benchmark_regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``k, item, start, end``: regions of the texts that match benchmark items; ``k`` is a hash of id and text.

    Benchmark text is read on the driver in blocks of ``BLOCK_CHARS`` characters (an item may be longer, and is then a
    block), each of which goes over all texts. Items may have ids of any type.
    """
    rows = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text")).where("text is not null")
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("item", item_type), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = to_arrow_schema(schema)
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        name, ids = uuid.uuid4().hex, [i for i, _ in block]
        shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name, ids=ids) -> Iterator[pa.RecordBatch]:
            if name not in _CUT:
                _CUT.clear()
                _CUT[name] = cut_segments(list(enumerate(shared.value)))
            seg = _CUT[name]
            for batch in batches:
                found = scan_batch(batch.column(1).to_pylist(), seg)
                keys = batch.column(0).to_pylist()
                columns = [[keys[f[0]] for f in found], [ids[f[1]] for f in found], *[[f[c] for f in found] for c in (2, 3)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        part = stored(rows.mapInArrow(scan, schema), "leaks")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: ``id, contaminated, items`` (sorted item ids) and ``spans`` (``item:start:end`` text).

    Case, punctuation and white space do not count. Items of fewer than ``LEAST_CHARS`` letters, digits and spaces
    match where they stand as whole words without edits, those of fewer than ``LEAST_EXACT`` nothing. A very long text
    is read piece by piece. Defined cases: null and empty texts and items match nothing, a null item id is no item, repeated
    rows share their result, items that repeat an id are matched each for itself, empty tables give empty results
    or clean documents, other columns are not looked at.
    """
    found = benchmark_regions(docs, benchmark, id_col, text_col, item_col, item_text)
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start", "item", "end"))), lambda s: F.concat_ws(":", s["item"], s["start"], s["end"]))
    hits = found.groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_join(spans, ",").alias("spans"))
    names = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"))
    return names.join(hits, "k", "left").select("id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(hits.schema["items"].dataType)).alias("items"), F.coalesce("spans", F.lit("")).alias("spans"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found. Only rows that may go are moved."""
    hit = stored(benchmark_regions(docs, benchmark, id_col, text_col).select(F.col("k").alias("__ls_k")).distinct(), "leaking")
    keyed = docs.withColumn("__ls_k", F.xxhash64(id_col, text_col))
    return narrowed(keyed, "__ls_k", hit, inside=False).unionByName(narrowed(keyed, "__ls_k", hit).join(hit, "__ls_k", "left_anti").select(*keyed.columns)).drop("__ls_k")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
