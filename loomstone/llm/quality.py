"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows, then flattened into arrays, so that a whole
batch walks all trees at once in numpy. Scores need a document's text and nothing else.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import table

#: Labelled rows that a fit uses at most; beyond it, those with the smallest hashes of their ids.
MAX_LABELLED = 20_000

FEATURES = (
    "log_chars", "log_words", "word_mean", "word_spread", "word_max", "upper", "digit", "mark", "space", "non_ascii", "distinct_words", "top_word",
    "top_three", "word_entropy", "echo", "distinct_pairs", "shouted", "capitalised", "marked_words", "marks_per_word", "short_words", "line_mean", "repeated_lines", "mark_kinds",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    tally = np.bincount(raw, minlength=256)
    n = len(raw)
    upper, lower, digit = tally[65:91].sum(), tally[97:123].sum(), tally[48:58].sum()
    space, wide = tally[[32, 9, 10, 11, 12, 13]].sum(), tally[128:].sum()
    marks = n - upper - lower - digit - space - wide
    words = text.split()
    w = len(words)
    if not w:
        return [math.log1p(n), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, space / n, wide / n] + [0.0] * 14
    size = np.fromiter(map(len, words), np.int64, w)
    counts = Counter(words)
    most = [c for _, c in counts.most_common(3)]
    share = np.fromiter(counts.values(), np.float64, len(counts)) / w
    pairs = list(zip(words, words[1:], strict=False))
    echo = sum(a == b for a, b in pairs)
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(c * (not k[-1].isalnum()) for k, c in counts.items())
    return [
        math.log1p(n), math.log1p(w), float(size.mean()), float(size.std()), math.log1p(int(size.max())), upper / n, digit / n, marks / n, space / n, wide / n,
        len(counts) / w, most[0] / w, sum(most) / w, float(-(share * np.log(share)).sum()) / max(math.log(w), 1.0), echo / w, len(set(pairs)) / max(1, len(pairs)),
        sum(c for k, c in counts.items() if k.isupper() and len(k) > 1) / w, sum(c for k, c in counts.items() if k[0].isupper()) / w, ended / w, marks / w,
        float((size <= 3).mean()), math.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), float((tally[33:48] > 0).sum() + (tally[58:65] > 0).sum()),
    ]


@dataclass
class Forest:
    """Trees as flat arrays ``[tree, node]``; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.value))
        for begin in range(0, len(x), 4096):
            part = x[begin : begin + 4096]
            node = np.zeros((len(part), len(trees)), np.int32)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = (trees, node)
                node = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[begin : begin + 4096] += self.value[trees, node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, least: float = 8.0, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss, level by level, from histograms of binned features."""
    n, f = x.shape
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = math.log(p / (1 - p))
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    forest = Forest(np.zeros(shape, np.int32), np.zeros(shape), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros(shape), base, depth)
    if not n or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1).astype(np.int64)
    raw = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            live = (local >= 0) & (local < width)
            cell = ((local[live, None] * f + np.arange(f)) * bins + binned[live]).ravel()
            hist = [np.bincount(cell, np.repeat(v[live], f), width * f * bins).reshape(width, f, bins) for v in (grad, hess)]
            gl, hl = (h.cumsum(axis=2)[:, :, :-1] for h in hist)
            g, h = (v.sum(axis=2)[:, :1, None] for v in hist)
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(hl < least / 4) | (h - hl < least / 4)] = -1
            for k in range(width):
                j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if gain[k, j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                me = first + k
                forest.feature[t, me], forest.threshold[t, me] = j, cuts[j][b]
                forest.left[t, me], forest.right[t, me] = 2 * me + 1, 2 * me + 2
                mine = node == me
                node[mine] = np.where(binned[mine, j] <= b, 2 * me + 1, 2 * me + 2)
        g, h = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
        forest.value[t] = -rate * g / (h + ridge)
        raw += forest.value[t, node]
    return forest


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Forest:
    """Fit on the labelled rows that are not held out, ``most`` at the most (smallest hashes of the id first).

    Defined cases: null labels and null ids are no labels; an id with several labels takes their mean, rounded up
    from a half; a repeated document counts as often as it occurs, within ``most``; without labels, or with one
    label only, every text gets the share of label 1 (0.5 without labels) as its score.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most ``most`` rows

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(texts)), dtype=object)

    sample = rows.select("y", "id", measure("text").alias("x")).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    x = np.array([r["x"] for r in sample], np.float64).reshape(-1, len(FEATURES))
    return grow(x, np.array([r["y"] for r in sample], np.float64))


def quality_score(forest: Forest):
    """A column function from text to score; empty and null texts have scores too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.score(_matrix(texts)), dtype="float64")

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", name: str = "score") -> DataFrame:
    """``docs`` with one more column, the score between 0 and 1; rows and columns stay, but for a column of the score's
    name, which is replaced; an empty table stays empty, a very long text is measured whole."""
    return docs.withColumn(name, quality_score(fit_quality(docs, labels, id_col, text_col, label_col))(F.col(text_col)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
