"""Learning of byte-pair merges by counted pairs, and checks of warm starts.

Merges are learned in rounds of many. What a round can merge is decided by the pairs that come first by count; words are
cut at neighbours too rare to take part, and the fragments that remain, each with its count, show every such pair with
its exact count. So merging them one at a time gives what merging all words one at a time would, as far down as those
pairs go. The words themselves, and the counts of their pairs, stay in the cluster and are brought up to date once a round.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.durable import Written

#: Pairs that a round looks at, and symbols of all its fragments: what the driver holds at most.
PAIRS, SYMBOLS = 1 << 15, 1 << 21


def word_symbols(docs: DataFrame, words: Column) -> DataFrame:
    """``symbols, n``: distinct words as arrays of characters with their counts. Merging runs over these, which grow
    with the vocabulary and not with the corpus."""
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.select(F.filter(F.split("word", ""), lambda c: c != "").alias("symbols"), "n")


def pair_frequencies(symbols: DataFrame) -> DataFrame:
    """``left, right, n`` of neighbouring symbols."""
    long = symbols.where(F.size("symbols") > 1)
    pairs = long.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("left"), F.element_at("symbols", i + 1).alias("right")))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def _places(merges: list[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(merges):
        places.setdefault(pair, []).append(k)
    return places


def _merged(symbols: list[str], places: dict[tuple[str, str], list[int]]) -> list[str]:
    """Symbols of one word after a list of merges, one after another: each joins all its occurrences, from the left.

    Only merges whose pair is there are looked at: of these, always the first that comes after the last one made."""
    at = -1
    while True:
        first = None
        for pair in set(zip(symbols, symbols[1:], strict=False)):
            mine = places.get(pair)
            if mine is not None:
                k = bisect_right(mine, at)
                if k < len(mine) and (first is None or mine[k] < first[0]):
                    first = (mine[k], pair)
        if first is None:
            return symbols
        at, (left, right) = first
        out: list[str] = []
        k = 0
        while k < len(symbols):
            if k + 1 < len(symbols) and symbols[k] == left and symbols[k + 1] == right:
                out.append(left + right)
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out


def encode_words(symbols: Column, merges: list[tuple[str, str]]) -> Column:
    """Symbols of a word after a list of merges, in order. All are applied in one pass, found by a table of pairs that
    travels with the tasks; its size is that of the vocabulary."""
    places = _places([tuple(m) for m in merges])

    @F.pandas_udf("array<string>")
    def encode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: None if s is None else _merged(list(s), places))

    return encode(symbols)


def _apply(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``symbols, n, before``: words after the merges, with their symbols before where these changed (else null). Words of
    one symbol already, which no merge changes and which have no pairs, are left out, so each round has fewer words."""
    shared = words.sparkSession.sparkContext.broadcast(_places(merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            old = batch.column(0).to_pylist()
            new = [_merged(s, places) for s in old]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(new, kind), batch.column(1), pa.array([a if len(a) != len(b) else None for a, b in zip(old, new, strict=True)], kind)], names=["symbols", "n", "before"])

    return words.where(F.size("symbols") > 1).select("symbols", "n").mapInArrow(run, "symbols array<string>, n long, before array<string>")


def _fragments(words: DataFrame, chosen: set[tuple[str, str]], live: set[tuple[str, str]] | None) -> DataFrame:
    """``symbols, n``: the parts of words that hold one of the ``chosen`` pairs, cut where neighbours are not ``live``
    (none: not cut), each with its count over all words."""
    shared = words.sparkSession.sparkContext.broadcast((chosen, live))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, live = shared.value
        for batch in batches:
            found: dict[tuple[str, ...], int] = {}
            for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin, wanted = 0, False
                for k in range(1, len(symbols) + 1):
                    pair = (symbols[k - 1], symbols[k]) if k < len(symbols) else None
                    if pair is not None and (live is None or pair in live):
                        wanted = wanted or pair in chosen
                        continue
                    if wanted:
                        part = tuple(symbols[begin:k])
                        found[part] = found.get(part, 0) + n
                    begin, wanted = k, False
            yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in found], pa.list_(pa.string())), pa.array(list(found.values()), pa.int64())], names=["symbols", "n"])

    parts = words.where(F.size("symbols") > 1).select("symbols", "n").mapInArrow(run, "symbols array<string>, n long")
    return parts.groupBy("symbols").agg(F.sum("n").alias("n"))


class _Fragments:
    """Fragments as one linked list of symbols, in arrays, with the places of each pair."""

    def __init__(self, table: pa.Table):
        lists = table.column("symbols").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.names: list[str] = coded.dictionary.to_pylist()
        self.ids = {s: k for k, s in enumerate(self.names)}
        sizes = np.diff(lists.offsets.to_numpy())
        total = int(sizes.sum()) + len(sizes)
        stop = np.cumsum(sizes + 1) - 1  # each fragment is followed by a mark that no pair holds
        self.symbol = np.full(total + 1, -1, np.int64)
        inside = np.ones(total, bool)
        inside[stop] = False
        self.symbol[:total][inside] = coded.indices.to_numpy()
        self.weight = np.zeros(total + 1, np.int64)
        self.weight[:total] = np.repeat(table.column("n").to_numpy(), sizes + 1)
        self.next = np.arange(1, total + 2)
        self.next[-1] = total
        self.prev = np.arange(-1, total)
        self.prev[0] = total
        self.places: dict[int, list[np.ndarray]] = {}
        self._index(np.flatnonzero((self.symbol[:-1] >= 0) & (self.symbol[1:] >= 0)))

    def key(self, left: str, right: str) -> int | None:
        a, b = self.ids.get(left), self.ids.get(right)
        return None if a is None or b is None else a << 32 | b

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at] << 32 | self.symbol[self.next[at]]

    def _index(self, at: np.ndarray) -> np.ndarray:
        keys = self._keys(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        for begin, part in zip(cuts, np.split(at, cuts[1:]), strict=True) if len(cuts) else ():
            self.places.setdefault(int(keys[begin]), []).append(part)
        return keys[cuts]

    def merge(self, key: int) -> tuple[dict[int, int], int]:
        """Join all occurrences of a pair; changes of the counts of pairs, and the number of the new symbol."""
        a, b = key >> 32, key & 0xFFFFFFFF
        at = np.unique(np.concatenate(self.places.pop(key, [np.zeros(0, np.int64)])))
        at = at[(self.symbol[at] == a) & (self.symbol[self.next[at]] == b)]
        if a == b:  # of a run, every second place from the left
            taken, last = [], -1
            for p in at.tolist():
                if p != last:
                    taken.append(p)
                    last = int(self.next[p])
            at = np.array(taken, np.int64)
        name = self.names[a] + self.names[b]
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
        new = self.ids[name]
        gone = self.next[at]
        changed: dict[int, int] = {}
        self._count(np.concatenate((self.prev[at], at, gone)), -1, changed)
        after = self.next[gone]
        self.symbol[at], self.symbol[gone] = new, -2
        self.next[at] = after
        self.prev[after] = at
        around = np.concatenate((self.prev[at], at))
        around = np.unique(around[(self.symbol[around] >= 0) & (self.symbol[self.next[around]] >= 0)])
        self._count(around, 1, changed)
        self._index(around)
        return changed, new

    def _count(self, at: np.ndarray, sign: int, changed: dict[int, int]) -> None:
        at = np.unique(at)
        at = at[(self.symbol[at] >= 0) & (self.symbol[self.next[at]] >= 0)]
        keys, which = np.unique(self._keys(at), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, which, self.weight[at])
        for key, n in zip(keys.tolist(), sums.tolist(), strict=True):
            changed[key] = changed.get(key, 0) + sign * n


def _order(left: str, right: str, n: int) -> tuple[int, str, str]:
    return -n, left, right


def _merge_round(table: pa.Table, known: dict[tuple[str, str], int], bound: tuple[int, str, str], symbols: set[str], most: int, rest: int) -> list[tuple[str, str, int]]:
    """Merges of one round, one at a time, while the next one comes before ``bound`` in the order of counts and symbols.

    ``known`` has the counts of all pairs up to the bound; others have at most ``rest``. A merge may make a symbol that is
    in use already (``symbols``): its new pairs may then stand in words outside the fragments, too, and the round ends
    before one of them could be next.
    """
    parts = _Fragments(table)
    counts: dict[int, int] = {}
    heap: list[tuple[int, str, str, int]] = []
    for (left, right), n in known.items():
        key = parts.key(left, right)
        if key is not None:
            counts[key] = n
            heap.append((-n, left, right, key))
    heapq.heapify(heap)
    unsure: dict[int, int] = {}  # pairs of a symbol made before, with the most they can have outside
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < most:
        minus, left, right, key = heapq.heappop(heap)
        upto = counts[key] + unsure.get(key, 0)
        if (minus, left, right) > bound or (key in unsure and -minus == upto):
            break
        if -minus != upto:
            continue  # counted anew since
        out.append((left, right, -minus))
        changed, new = parts.merge(key)
        counts[key] = 0
        for k, by in changed.items():
            a, b = k >> 32, k & 0xFFFFFFFF
            if k == key or not by or (k not in counts and new not in (a, b)):
                continue  # pairs beyond the bound only become rarer
            if k not in counts and left + right in symbols:
                unsure[k] = rest
            counts[k] = counts.get(k, 0) + by
            if counts[k] > 0:
                heapq.heappush(heap, (-(counts[k] + unsure.get(k, 0)), parts.names[a], parts.names[b], k))
    return out


def learn_merges(docs: DataFrame, words: Column | None, n: int, least: int = 2, warm: list[tuple[str, str]] | None = None, pairs: int = PAIRS, most_symbols: int = SYMBOLS) -> DataFrame:
    """``rank, left, right, n`` of ``n`` merges: the most frequent pair each time, ties by left and right symbol.

    ``warm`` lists merges of an earlier run, which are applied first, in one pass, and not counted again. Without ``words``,
    ``docs`` has ``symbols, n`` already.

    Rounds of many merges give the merges of one at a time (see the module). A round takes to the driver the first
    ``2 * pairs`` pairs at most and fragments of ``most_symbols`` symbols at most, fewer pairs where those hold more; so what
    it needs does not grow with the words, of which only those that change send new counts of pairs.
    """
    spark = docs.sparkSession
    table = Written(docs.select("symbols", "n") if words is None else word_symbols(docs, words), "words")
    if warm:
        table.replace(_apply(table.df, [tuple(m) for m in warm]))
    counts = Written(pair_frequencies(table.df), "pairs")
    symbols = {r["s"] for r in table.df.select(F.explode("symbols").alias("s")).distinct().toLocalIterator()}  # characters, and what warm merges made
    found: list[tuple[int, str, str, int]] = []
    width = pairs
    while len(found) < n:
        top = counts.df.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(2 * pairs + 1).collect()
        if not top:
            break
        while True:
            chosen = top[:width]
            complete = len(top) <= width
            floor = chosen[-1]["n"]
            bound = (-least, "\U0010ffff" * 4, "") if complete else _order(chosen[-1]["left"], chosen[-1]["right"], floor)
            level = least if complete else floor
            reach = [r for r in top if r["n"] >= level]
            live = {(r["left"], r["right"]) for r in reach} if len(reach) < 2 * pairs + 1 else None
            rows = Written(_fragments(table.df, {(r["left"], r["right"]) for r in chosen}, live), "fragments")
            size = rows.df.agg(F.sum(F.size("symbols"))).head()[0] or 0
            if size <= most_symbols or width == 1:
                break
            rows.drop()
            width = max(1, width // 4)
        made = _merge_round(rows.df.toArrow(), {(r["left"], r["right"]): r["n"] for r in chosen}, bound, symbols, n - len(found), least - 1 if complete else level)
        rows.drop()
        found += [(len(found) + k, *m) for k, m in enumerate(made)]
        symbols |= {a + b for a, b, _ in made}
        if size <= most_symbols // 4:
            width = min(pairs, width * 2)
        if len(found) < n:
            table.replace(_apply(table.df, [(a, b) for a, b, _ in made]))
            changed = table.df.where("before is not null")
            lost = pair_frequencies(changed.select(F.col("before").alias("symbols"), (-F.col("n")).alias("n")))
            counts.replace(counts.df.unionByName(lost).unionByName(pair_frequencies(changed)).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"))
    table.drop()
    counts.drop()
    return spark.createDataFrame(found, "rank int, left string, right string, n long")


def prefix_check(old: DataFrame, new: DataFrame, place: str, entry: str) -> DataFrame:
    """``n_changed, n_missing``: entries of the old list that the new one has not at the same place, or not at all."""
    o, n = old.select(place, F.col(entry).alias("o")), new.select(place, F.col(entry).alias("n"))
    changed = o.join(n, place, "left").agg(F.count_if(F.col("n").isNull() | (F.col("o") != F.col("n"))).alias("n_changed"))
    missing = o.join(n, F.col("o") == F.col("n"), "left_anti").agg(F.count("*").alias("n_missing"))
    return changed.crossJoin(missing)  # one row each


# The marks that come first in every trained vocabulary.
SPECIALS = ("[PAD]", "[UNK]", "[EOSEQ]")


def train_vocabulary(docs: DataFrame, words: Column, size: int, alphabet: list[str] | None = None, least: int = 2, specials: tuple[str, ...] = SPECIALS, warm: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (``id, token``) and merges (``rank, left, right, n``) of at most ``size`` entries.

    First come the marks, then single characters in order: the forced ``alphabet`` and those of the corpus, then what
    the merges make: those of ``warm``, an earlier run's, at their old places, and the new ones. A merge that makes a
    token which is there already adds none. Alphabet, marks and merges are bounded by ``size``.
    """
    spark = docs.sparkSession
    table = Written(word_symbols(docs, words), "distinct-words")
    seen = table.df.select(F.explode("symbols").alias("c")).distinct()
    forced = set(alphabet or [])
    room = max(0, size - len(specials) - len(forced))
    singles = [r["c"] for r in seen.where(~F.col("c").isin(*forced) if forced else F.lit(True)).orderBy("c").limit(room).collect()]
    tokens = dict.fromkeys([*specials, *sorted(forced | set(singles))])
    warm = list(warm or [])[: max(0, size - len(tokens))]
    tokens |= dict.fromkeys(a + b for a, b in warm)
    learned = learn_merges(table.df, None, max(0, size - len(tokens)), least, warm=warm)
    table.drop()
    new = [(r["left"], r["right"], r["n"]) for r in learned.orderBy("rank").collect()]
    tokens |= dict.fromkeys(a + b for a, b, _ in new)
    merges = [(k, a, b, n) for k, (a, b, n) in enumerate([*((a, b, None) for a, b in warm), *new])]
    return spark.createDataFrame(list(enumerate(list(tokens)[:size])), "id int, token string"), spark.createDataFrame(merges, "rank int, left string, right string, n long")
