"""Metrics of generated text: repetition, diversity, entropy, perplexity, error rates, length statistics.

What is counted within a document is computed within its row, so the words of a corpus are not shuffled; only what is
counted across documents (distinct n-grams) is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of a word array, joined by spaces; none where it has fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def ngram_count(words: Column, n: int) -> Column:
    """How many n-grams a word array has."""
    return F.greatest(F.size(words) - n + 1, F.lit(0))


def repetition(docs: DataFrame, words: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """``rep_n``: hundredths of n-grams that repeat one of their own document, over all documents of the group."""
    grams = docs.select(*(by or []), ngrams(words, n).alias("g")).select(*(by or []), F.size("g").alias("n"), F.size(F.array_distinct("g")).alias("d"))
    return grams.groupBy(*(by or [])).agg((100.0 * F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias(f"rep_{n}"))


def distinctness(docs: DataFrame, words: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """``distinct_n``: hundredths of n-grams that are distinct in the whole group. An n-gram is named by two 64-bit hashes of
    its words, together 128 bits, so that no two of any corpus are taken for one another; only these are shuffled.
    """
    keys = by or []
    spread = docs.withColumn("_w", words).select(*keys, "_w", F.posexplode("_w").alias("_p", "_first")).where(F.col("_p") + n <= F.size("_w"))
    gram = [F.col("_first"), *[F.get("_w", F.col("_p") + k) for k in range(1, n)]]
    grams = spread.select(*keys, F.xxhash64(*gram).alias("_h"), F.xxhash64(F.lit(1), *gram).alias("_h2")).groupBy(*keys, "_h", "_h2").agg(F.count("*").alias("c"))
    return grams.groupBy(*keys).agg((100.0 * F.count("*") / F.greatest(F.coalesce(F.sum("c"), F.lit(0)), F.lit(1))).alias(f"distinct_{n}"))


def unigram_entropy(items: Column) -> Column:
    """Entropy in nats of the items of an array; 0 where it is empty. Runs of the sorted array are counted in place."""
    ordered = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    part = lambda c: F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"].eqNullSafe(x)
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, acc["total"]).otherwise(acc["total"] + part(acc["run"])).alias("total"))

    done = F.aggregate(ordered, zero, step, lambda acc: acc["total"] + part(acc["run"]))
    return F.when(F.size(items) > 0, F.log(F.size(items).cast("double")) - done / F.size(items)).otherwise(F.lit(0.0))


def perplexity(scored: DataFrame, nll: str, by: list[str]) -> DataFrame:
    """``n, bits_per_token, perplexity`` from scored tokens: ratios of sums, infinite where nothing is scored."""
    total, n = F.sum(nll), F.count(nll)
    infinite = F.lit(float("inf"))
    return scored.groupBy(*by).agg(n.alias("n"), F.when(n > 0, total / (n * math.log(2))).otherwise(infinite).alias("bits_per_token"), F.when(n > 0, F.exp(total / n)).otherwise(infinite).alias("perplexity"))


def scoring_windows(lengths: DataFrame, length: str, window: int, stride: int) -> DataFrame:
    """Windows that score every token of a sequence once: ``begin`` to ``end`` is read, from ``first`` on it is scored.

    The first token of a sequence has nothing before it and is never scored; sequences of fewer than two tokens have
    no windows.
    """
    ends = F.when(F.col(length) >= 2, F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.col(length) - window, F.lit(0)) / stride).cast("int")), lambda k: F.least(F.col(length), window + k * stride)))
    rows = lengths.select("*", F.posexplode(ends).alias("step", "end"))
    return rows.select("*", F.greatest(F.lit(0), F.col("end") - window).alias("begin"), F.when(F.col("step") == 0, F.lit(1)).otherwise(F.least(F.col(length), F.lit(window) + (F.col("step") - 1) * stride)).alias("first"))


def word_error_rate(pairs: DataFrame, reference: str, hypothesis: str, by: list[str]) -> DataFrame:
    """Corpus-level error rate per group: word edits over reference words, lower-cased; null without references.

    Edits are counted by Spark's ``levenshtein`` over one character per distinct word of the pair.
    """
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "")
    rows = pairs.select(*by, split(reference).alias("r"), split(hypothesis).alias("h")).withColumn("v", F.array_distinct(F.concat("r", "h")))
    # Code points from U+4E00 on: one block of twenty thousand, then the supplementary ideographs.
    char = lambda i: F.decode(F.unhex(F.when(i <= 20000, _utf8_3(i + 0x4DFF)).otherwise(_utf8_4(i - 20000 + 0x1FFFF))), "UTF-8")
    coded = lambda c: F.array_join(F.transform(c, lambda w: char(F.array_position("v", w))), "")
    rows = rows.select(*by, F.levenshtein(coded("r"), coded("h")).cast("long").alias("edits"), F.size("r").cast("long").alias("words"))
    return rows.groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum("words").alias("words")).withColumn("wer", F.when(F.col("words") > 0, F.col("edits") / F.col("words")))


def _utf8_3(p: Column) -> Column:
    byte = lambda x, lead: F.lpad(F.hex((x + lead).cast("long")), 2, "0")
    p = p.cast("long")
    return F.concat(byte(F.shiftright(p, 12), 0xE0), byte(F.shiftright(p, 6).bitwiseAND(63), 0x80), byte(p.bitwiseAND(63), 0x80))


def _utf8_4(p: Column) -> Column:
    byte = lambda x, lead: F.lpad(F.hex((x + lead).cast("long")), 2, "0")
    p = p.cast("long")
    return F.concat(byte(F.shiftright(p, 18), 0xF0), byte(F.shiftright(p, 12).bitwiseAND(63), 0x80), byte(F.shiftright(p, 6).bitwiseAND(63), 0x80), byte(p.bitwiseAND(63), 0x80))


def length_statistics(rows: DataFrame, length: str, by: list[str], whole: bool = False) -> DataFrame:
    """Count, extremes, mean, population spread and percentiles; percentiles are cut to whole numbers if ``whole``."""
    cut = (lambda c: F.floor(F.round(c, 6)).cast("long")) if whole else (lambda c: c)
    points = [cut(F.percentile(length, F.lit(p / 100))).alias(f"p{str(p).replace('.', '_')}") for p in (50, 90, 95, 99, 99.9)]
    return rows.groupBy(*by).agg(F.count(length).alias("n"), F.min(length).alias("least"), F.max(length).alias("most"), F.avg(length).alias("mean"), F.stddev_pop(length).alias("spread"), *points)
