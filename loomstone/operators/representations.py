"""Token representations: injected tokenizers and scorers, semantic ranks, and decoding by representation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import codecs as C


class Tokenizer(Protocol):
    """What an injected tokenizer has to offer."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def tokenize(load: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A column function from text to ids; the tokenizer is loaded once per task. Null text has no ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield texts.map(lambda t: tokenizer.encode(t) if t else [])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))


def detokenize(load: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A column function from ids to text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for rows in batches:
            yield rows.map(lambda ids: "" if ids is None else tokenizer.decode([int(i) for i in ids]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())


def score_texts(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function from text to the negative log-likelihoods of its tokens, by a model loaded once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def to_ranks(rows: DataFrame, key: str, ids: str, ranks: DataFrame) -> DataFrame:
    """``rows`` with ``ids`` as semantic ranks (``old_id, new_id``); an id without a rank stays as it is.

    A rank table has one row per vocabulary entry, at most 65,536 of them, and is broadcast; a larger one is an error.
    """
    if ranks.limit(1 << 16).count() >= 1 << 16 and ranks.count() > 1 << 16:
        raise ValueError("a rank table has 65,536 rows at the most")
    spread = rows.select(key, F.posexplode(ids).alias("_p", "_t")).join(F.broadcast(ranks), F.col("_t") == F.col("old_id"), "left")
    back = spread.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("new_id", "_t").alias("t")))), lambda x: x["t"]).alias("_ids"))
    empty = F.array().cast(rows.schema[ids].dataType)
    return rows.join(back, key, "left").withColumn(ids, F.coalesce(F.col("_ids").cast(rows.schema[ids].dataType), empty)).drop("_ids")


def from_ranks(rows: DataFrame, key: str, ids: str, ranks: DataFrame, most: int, unknown: int) -> DataFrame:
    """The way back: ranks are clamped to ``0 .. most + 1``, and one that no id has becomes the unknown id."""
    clamped = rows.withColumn(ids, F.transform(ids, lambda t: F.greatest(F.lit(0), F.least(t, F.lit(most + 1)))))
    inverse = ranks.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))
    spine = clamped.select(F.explode(ids).alias("old_id")).distinct().join(F.broadcast(inverse.select("old_id")), "old_id", "left_anti")
    return to_ranks(clamped, key, ids, inverse.unionByName(spine.select("old_id", F.lit(unknown).alias("new_id"))))


def keep_examples(rows: DataFrame, order: str, text: Column, most: int) -> DataFrame:
    """``order, text`` of the first ``most`` texts that are not empty after cleaning; what is dropped does not count."""
    return rows.select(order, text.alias("text")).where("text <> ''").orderBy(order).limit(most)


def tiled(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``rows`` repeated in order until there are ``n``, with their ``place``."""
    from loomstone.operators.packing import row_numbers

    placed = row_numbers(rows, order, "_row")
    m = F.broadcast(rows.agg(F.count("*").alias("_m")))  # one row
    times = F.sequence(F.lit(0), F.greatest(F.floor((F.lit(n - 1) - F.col("_row")) / F.col("_m")), F.lit(0)).cast("int"))
    return placed.crossJoin(m).where(F.col("_row") < n).select(*rows.columns, "_row", "_m", F.explode(times).alias("_k")).withColumn("place", F.col("_row") + F.col("_k") * F.col("_m")).where(F.col("place") < n).drop("_row", "_m", "_k")


Decoder = Callable[[Column], Column]
_DECODERS: dict[tuple[str, str, str], Callable[..., Decoder]] = {}


def decoder(representation: str, binarisation: str, codec: str, **settings) -> Decoder:
    """The decoder from a column of model outputs to ids, by the names of a representation."""
    key = (representation, binarisation, codec)
    if key not in _DECODERS:
        raise KeyError(f"no decoder for {key}; there are {sorted(_DECODERS)}")
    return _DECODERS[key](**settings)


def _register(*key: str):
    def add(f):
        _DECODERS[key] = f
        return f

    return add


@_register("bits", "binary", "token")
def _plain_bits(width: int, vocabulary: int) -> Decoder:
    return lambda bits: C.bits_tokens(bits, width, vocabulary)


@_register("bits", "binary", "raw")
def _raw_bits(width: int) -> Decoder:
    return lambda bits: C.bits_tokens(bits, width)


@_register("bits", "gray", "token")
def _gray_bits(width: int, vocabulary: int) -> Decoder:
    return lambda bits: F.transform(C.bits_tokens(bits, width), lambda t: C.from_gray(t, width) % vocabulary)


@_register("bits", "secded", "token")
def _corrected_bits(width: int, vocabulary: int, unknown: int = 1) -> Decoder:
    """Words of ``width`` data bits; an uncorrectable one is the unknown id."""

    def run(bits: Column) -> Column:
        words = C.bits_tokens(bits, width + C.parity_size(width) + 1)
        return C.secded_ids(words, width, unknown, vocabulary)

    return run


@_register("codes", "none", "bpe")
def _codes(pad: int, end: int, vocabulary: int, unknown: int | None = None, mark: int | None = None) -> Decoder:
    """Code rows cut at their stop; one mark is taken off each end."""

    def run(ids: Column) -> Column:
        kept = C.stop_codes(ids, pad, end, vocabulary, unknown)["kept"]
        return kept if mark is None else C.strip_edges(kept, mark)

    return run


@_register("scores", "none", "token")
def _scores() -> Decoder:
    return lambda rows: F.transform(rows, lambda s: C.best_index(s))


def threshold_bits(probabilities: Column, prefix: Column | None = None) -> Column:
    """Bits of probabilities above one half, after a prefix copied from a reference."""
    bits = F.transform(probabilities, lambda p: (p > 0.5).cast("tinyint"))
    if prefix is None:
        return bits
    return F.concat(prefix, F.slice(bits, F.size(prefix) + 1, F.greatest(F.size(bits) - F.size(prefix), F.lit(0))))


def mixed_draw(base: Column, learned: Column, u: Column, gamma: Column) -> Column:
    """The learned level with probability ``gamma`` (by a given uniform number), else the base level."""
    return F.when(u < gamma, learned).otherwise(base)


def prompt_length(u: Column, least: int, most: int, size: int) -> Column:
    """A length drawn evenly between two bounds, both included, from a uniform number; never above ``size``."""
    return F.greatest(F.lit(0), F.least(F.lit(size), F.lit(least) + F.floor(u * (most - least + 1)).cast("int")))
