"""Alignment of two tokenizers over the same bytes, by elementary intervals.

The ends of both token sequences cut a text into elementary intervals. Each lies in one token of either side, which the
ends find by binary search; where both sides end, a group closes. What is linked is counted over the whole corpus, and
every document is then given how often its own links hold elsewhere.

Texts are encoded once. They are handled in chunks of a few megabytes; a chunk lists each of its id pairs once, with its
count, and its documents refer to that list by place. So what is shuffled by id pair has one row for each pair and chunk,
not one for each link, and the counts return to a chunk's documents with the chunk.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import pieces, stored
from loomstone.session import table

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text in a chunk, and bytes that are encoded at once.
CHUNK, ENCODE = 1 << 22, 1 << 18
#: Pairs of a chunk up to which a place in its list takes two bytes.
NARROW = 1 << 16


def decoded_bytes(token: str) -> bytes:
    """The bytes of a token of a byte-level vocabulary, in which every byte is written as one printable character: those
    that are printable in Latin-1 as themselves, the others, in order, from U+0100 on."""
    return bytes(_byte_of()[c] for c in token)


def _byte_of() -> dict[str, int]:
    if not _BYTES:
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        _BYTES.update({chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)})
    return _BYTES


_BYTES: dict[str, int] = {}


class Side:
    """One tokenizer: how it encodes texts, and the bytes of its tokens."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)


def _settled() -> np.ndarray:
    """Which characters below U+10000 have been letters, numbers, spaces or none of these ever since Unicode 3.2: libraries
    with different versions of its tables agree on them."""
    kind = lambda tables: np.array([{"L": 1, "N": 2, "Z": 3}.get(tables.category(chr(c))[0], 0) + 4 * (tables.category(chr(c)) in ("Cn", "Cs", "Co")) for c in range(1 << 16)], np.int8)
    now, before = kind(unicodedata), kind(unicodedata.ucd_3_2_0)
    return (now == before) & (now < 4)


def byte_level(path: str) -> Side:
    """A byte-level BPE in the format of the library tokenizers. Special tokens in a text are ordinary text.

    Where a pair's rank follows from its token's id, texts of settled characters are encoded by the same vocabulary in
    tiktoken, which gives the same ids in a third of the time; all other texts by tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        tokens[k] = decoded_bytes(token) if all(c in _byte_of() for c in token) else token.encode()
    slow = lambda texts: [e.ids for e in tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
    quick = _by_ranks(path)
    if quick is None:
        return Side(slow, tokens)
    settled = _settled()

    def encode(texts: list[str]) -> list[list[int]]:
        out = [quick(f" {t}") if _within(settled, t) else None for t in texts]
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, slow([texts[k] for k in left]), strict=True):
            out[k] = ids
        return out

    return Side(encode, tokens)


def _within(settled: np.ndarray, text: str) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return not len(codes) or (int(codes.max()) < len(settled) and bool(settled[codes].all()))


def _by_ranks(path: str):
    """The function that encodes by ranks, for a plain byte-level BPE whose merges are in order of the ids they make."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    plain = before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True} and spec["normalizer"] is None and not model.get("ignore_merges")
    single = [k for t, k in model["vocab"].items() if len(t) == 1]
    if not plain or made != sorted(set(made)) or len(made) + len(single) != len(model["vocab"]) or (made and max(single) > made[0]):
        return None
    ranks = {decoded_bytes(t): k for t, k in model["vocab"].items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pieces_of(path: str) -> Side:
    """A sentencepiece model, which puts the space before a text by itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k in range(model.get_piece_size()) for p in [model.id_to_piece(k)]]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two ascending arrays of token ends over the same bytes: the interval's end, and which token
    of either side it lies in. Each is one overlap of two tokens."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ends`` of the groups, in order, and the places ``a`` and ``b`` of the tokens that end together there.

    A group closes at an elementary interval whose owners both end with it. Where tokens without bytes repeat an end, the
    tokens of one side that share it are linked with all of the other's: the products are expanded in place.
    """
    ends, owner_a, owner_b = overlaps(ends_a, ends_b)
    if not len(ends):
        return ends, owner_a, owner_b
    shut = (ends_a[np.minimum(owner_a, len(ends_a) - 1)] == ends) & (ends_b[np.minimum(owner_b, len(ends_b) - 1)] == ends) if len(ends_a) and len(ends_b) else np.zeros(len(ends), bool)
    ends, first_a, first_b = ends[shut], owner_a[shut], owner_b[shut]
    n_a, n_b = (np.searchsorted(e, ends, side="right") - first for e, first in ((ends_a, first_a), (ends_b, first_b)))
    product = n_a * n_b
    owner = np.repeat(np.arange(len(ends)), product)
    k = np.arange(int(product.sum())) - np.repeat(np.cumsum(product) - product, product)
    return ends, first_a[owner] + k // n_b[owner], first_b[owner] + k % n_b[owner]


_PART = "id_type, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", chunk: int = CHUNK) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups, chunk, links, pair_a, pair_b, pair_n``, one row for each row of ``docs``.

    ``groups`` lists the ids of both sides between shared ends, as in ``a1,a2|b1;a3|b2,b3``. ``links`` has, as unsigned
    little-endian numbers of 2 bytes (4 where the chunk has more than ``NARROW`` pairs), the place of each of the document's
    links in the list of its chunk's id pairs; that list, with how many links of the chunk each pair has, is in the chunk's
    first row (the three ``pair_`` columns, null elsewhere). Write the result before using it twice: chunks are numbered
    by task.

    Defined cases: a null or empty text, and one whose tokens of either side do not give back its bytes, has no tokens,
    groups or links, and the empty string as ``groups``; repeated rows and null ids are handled each for itself; texts of
    any length are encoded whole; an empty table gives an empty result; other columns are not looked at.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(_PART.removeprefix("id_type, ")).fields])
    paths = [os.path.join(folder, name) for name in (first, second)]

    def encode(side: Side, texts: list[str], wanted: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each text; none where they do not give back its bytes."""
        out: list[np.ndarray | None] = []
        for begin, stop in pieces([len(w) for w in wanted], ENCODE):
            for ids, want in zip(side.encode(texts[begin:stop]), wanted[begin:stop], strict=True):
                same = b"".join(map(side.tokens.__getitem__, ids)) == want
                out.append(np.array(ids, np.int32) if same else None)
        return out

    def flat(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the runs, and where each run begins and ends."""
        return np.concatenate([np.zeros(0, np.int32), *runs]), np.cumsum([0, *map(len, runs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        a, b = byte_level(paths[0]), pieces_of(paths[1])
        n_ids = max(len(a.tokens), len(b.tokens))
        written = [f"{k}{mark}" for mark in (",", "|", ";", "") for k in range(n_ids)]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for begin, stop in pieces(sizes, chunk):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin).cast(arrow.field("id").type), *aligned(batch.column(1).slice(begin, stop - begin).to_pylist(), number, a, b, n_ids, written, arrow)], schema=arrow)
                number += 1

    def aligned(texts: list[str | None], number: int, a: Side, b: Side, n_ids: int, written: list[str], arrow: pa.Schema) -> list[pa.Array]:
        wanted = [f" {t}".encode() for t in texts if t]
        some = [t for t in texts if t]
        runs_a, runs_b = encode(a, some, wanted), encode(b, some, wanted)
        good = [x is not None and y is not None for x, y in zip(runs_a, runs_b, strict=True)]
        ids_a, cut_a = flat([x for x, ok in zip(runs_a, good, strict=True) if ok])
        ids_b, cut_b = flat([y for y, ok in zip(runs_b, good, strict=True) if ok])
        size = np.array([len(w) for w, ok in zip(wanted, good, strict=True) if ok], np.int64)
        stop = np.cumsum(size)  # both sides end with every text, so no group reaches into the next
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        ends, link_a, link_b = links(ends_a, ends_b)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        # Tokens in the order they are written: group by group, first those of A, then those of B.
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        code = np.zeros(len(ids_a) + len(ids_b), np.int64)
        code[place_a], code[place_b] = ids_a, ids_b
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(ids_a)], np.append(group_b[1:] != group_b[:-1], True)[: len(ids_b)]
        code[place_a[last_a]] += n_ids
        code[place_b[last_b]] += 2 * n_ids
        cut = cut_a + cut_b
        code[cut[1:] - 1] += n_ids  # the last token of a text
        key, where, times = np.unique(ids_a[link_a].astype(np.int64) * n_ids + ids_b[link_b], return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        where, key, times = rank[where].astype("<u2" if len(key) <= NARROW else "<u4"), key[order], times[order]
        upto_groups = np.concatenate(([0], np.searchsorted(ends, stop, side="right")))
        upto_links = np.concatenate(([0], np.searchsorted(ends_a[link_a], stop, side="right")))
        it, out = iter(range(len(size))), []
        state = iter(good)
        for text in texts:
            k = next(it) if text and next(state) else None
            if k is None:
                out.append((0, 0, 0, 0, "", b""))
                continue
            mine = slice(int(upto_links[k]), int(upto_links[k + 1]))
            groups = "".join(map(written.__getitem__, code[cut[k] : cut[k + 1]].tolist()))
            out.append((int(cut_a[k + 1] - cut_a[k]), int(cut_b[k + 1] - cut_b[k]), int(upto_groups[k + 1] - upto_groups[k]), mine.stop - mine.start, groups, where[mine].tobytes()))
        columns = [pa.array(c, arrow.field(k + 1).type) for k, c in enumerate(zip(*out, strict=True)) if k < 5]
        empty = [None] * (len(texts) - 1)
        pairs = [pa.array([p, *empty], arrow.field(name).type) for name, p in (("pair_a", key // n_ids), ("pair_b", key % n_ids), ("pair_n", times))]
        return [*columns, pa.array([number] * len(texts), pa.int64()), pa.array([o[5] for o in out], pa.binary()), *pairs]

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def chunk_pairs(aligned: DataFrame) -> DataFrame:
    """``chunk, place, a, b, n``: the id pairs of each chunk of a stored alignment."""
    pairs = aligned.where("pair_a is not null").select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "p"))
    return pairs.select("chunk", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def count_pairs(pairs: DataFrame) -> DataFrame:
    """``a, b, n, best``: links of each id pair in the corpus, and whether no other pair of the same B id has more."""
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (stored) with ``n_best`` and ``count_sum`` in place of its links: how many of a document's links are of a best
    pair, and the sum of all its links' counts.

    Counts meet the chunks' pairs by id pair, then the documents by chunk; a task holds one chunk at a time.
    """
    known = pairs.select("chunk", "place", "a", "b").join(counts, ["a", "b"]).select(F.col("chunk").alias("in_chunk"), "place", "n", "best")
    rows = aligned.drop("pair_a", "pair_b", "pair_n")
    kept = [f for f in rows.schema.fields if f.name not in ("chunk", "links")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(documents: pa.Table, found: pa.Table) -> pa.Table:
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        place = found.column("place").to_numpy()
        n[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        dtype = "<u2" if len(n) <= NARROW else "<u4"
        where = [np.frombuffer(x.as_py() or b"", dtype) for x in documents.column("links")]
        made = [pa.array([int(v[w].sum()) for w in where], pa.int64()) for v in (best, n)]
        names = [f.name for f in kept]
        return pa.Table.from_arrays([*[documents.column(c) for c in names], *made], names=[*names, "n_best", "count_sum"])

    return rows.groupBy("chunk").cogroup(known.groupBy("in_chunk")).applyInArrow(score, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(table(spark, sf_dir, "documents"))
    aligned = stored(aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups"), "alignment")
    pairs = chunk_pairs(aligned)
    return score_links(aligned, pairs, count_pairs(pairs)).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
