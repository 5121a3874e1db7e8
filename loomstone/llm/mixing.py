"""Mixing of sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates that bring every source's words to its target, the wanted ones have the least relative
entropy to taking each document once, with no rate above ``most``. Their form is ``min(most, exp(lambda * size))``
with one multiplier per source; Newton iterations solve the convex dual for the multipliers over the counted sizes
of the whole corpus. The rates are then rounded into whole copies by systematic rounding in order of size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm.common import WORD, discard, narrowed, stored
from loomstone.session import table

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of one source and size that one sort of the rounding holds at most, about.
RUN = 50_000
ROUNDS = 60
CLOSE = 1e-10


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights go by code point of the source, null last, and repeat. The share of all words is cut at ``most`` times a
    source's size, and what is cut is shared again by weight: the level at which the rest stands is found from
    running sums over the sources in order of ``size / weight``.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("reach", F.col("cap") / F.col("weight"))
    w = W.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(w), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(w), F.lit(0.0))))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(whole))
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / mean, F.lit(700.0))))


def solve_multipliers(counted: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``source, lam, mean``: Newton's method on the dual of every source at once, kept inside a shrinking bracket.

    ``counted`` holds ``source, size, n``. A source whose target is its upper limit has no finite multiplier; its
    ``lam`` is null and its rate is ``most``. A source without words needs none; its ``lam`` is 0.
    """
    totals = counted.groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("size") * F.col("n")), F.sum(F.col("size") * F.col("n"))).alias("mean"))
    state = targets.join(totals, targets["source"].eqNullSafe(totals["source"])).select(
        targets["source"], "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.when(F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-12), F.when(F.col("source_size") == 0, 0.0)).when(F.col("source_size") == 0, 0.0).otherwise(F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9)))).alias("lam"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"),
    )
    state = stored(state, "mix-state")
    for _ in range(ROUNDS):
        open_ = state.where("lam is not null and source_size > 0 and not done")
        joined = counted.alias("c").join(open_.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        sums = joined.groupBy(F.col("s.source").alias("source")).agg(
            F.sum(F.col("size") * F.col("n") * rate).alias("g"), F.sum(F.when(rate < most, F.col("size") * F.col("n") * rate * x).otherwise(0.0)).alias("slope"),
        )
        s, g = state.alias("s"), sums.alias("g")
        gap = F.col("g.g") - F.col("s.target")
        low = F.when(gap < 0, F.col("s.lam")).otherwise(F.col("s.low"))
        high = F.when(gap > 0, F.col("s.lam")).otherwise(F.col("s.high"))
        moved = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "left").select(
            "s.source", "s.source_size", "s.target", "s.mean", "s.lam", low.alias("low"), high.alias("high"),
            F.when(F.col("g.g").isNull(), F.lit(None)).otherwise(F.col("s.lam") - gap / F.greatest(F.col("g.slope"), F.lit(1e-300))).alias("step"),
            (F.col("g.g").isNull() | (F.abs(gap) <= F.lit(CLOSE) * F.col("s.target")) | (F.abs(high - low) < 1e-13)).alias("done"),
        )
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        # Outside the bracket: halve it, or double the multiplier while it has no finite end yet.
        wide = F.col("high") - F.col("low") > 1e5
        other = F.when(wide & (F.col("low") > -1e6), F.greatest(F.col("low"), F.lit(0.0)) * 2 + 1).when(wide & (F.col("high") < 1e6), F.least(F.col("high"), F.lit(0.0)) * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.select("source", "source_size", "target", "mean", F.when(F.col("done"), F.col("lam")).when(inside, F.col("step")).otherwise(other).alias("lam"), "low", "high", "done")
        after = stored(moved, "mix-state")
        discard(state)
        state = after
        if state.where("not done").isEmpty():
            break
    # Sums of doubles may differ in the last digits between runs; the copies must not.
    return state.select("source", "source_size", "target", "mean", F.round("lam", 9).alias("lam"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per input row: ``id, k, source, size, source_size, target, rate, copies``.

    ``k`` is a hash of id and text. ``size`` is the number of words (null text: 0). Defined cases: a null source is one source, ordered last; texts
    without words have size 0 and are kept once; ties of size are ordered by ``k`` and then the id, so that
    repeated rows are interchangeable; a very long text is a large size and no more; an empty table gives an empty result; other columns are not looked at.
    A source's words come to its target but for less than about its largest document.

    The rows of one source and size are numbered in runs of about ``RUN`` rows, by hash, so that a source or a group
    of copies with most of the rows is sorted in many tasks.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).select("id", F.xxhash64("id", "text").alias("k"), "source", size.alias("size"))
    rows = stored(rows, "mix-rows")
    counted = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = stored(source_targets(sizes, weights, most), "mix-targets")
    solved = solve_multipliers(counted, targets, most)

    # Where each group of one source and size begins on the line along which copies are dealt out.
    c, s = counted.alias("c"), solved.alias("s")
    groups = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select(
        "c.source", "size", "n", "source_size", "target",
        F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), most)).alias("rate"),
    )
    before = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    groups = groups.withColumn("begin", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(before)).withColumn("runs", F.ceil(F.col("n") / RUN).cast("long"))
    r, g = rows.alias("r"), groups.alias("g")
    dealt = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.size") == F.col("g.size"))).select(
        "r.id", "r.k", "r.source", "r.size", "source_size", "target", "rate", "begin", F.pmod(F.xxhash64("r.k", F.lit(7)), F.col("runs")).alias("run"), "runs",
    )
    counts = dealt.where("runs > 1").groupBy("source", "size", "run").agg(F.count("*").alias("m"))
    offsets = counts.select("source", "size", "run", (F.sum("m").over(W.partitionBy("source", "size").orderBy("run")) - F.col("m")).alias("skip"))
    d, o = dealt.alias("d"), offsets.alias("o")
    placed = d.join(o, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.size") == F.col("o.size")) & (F.col("d.run") == F.col("o.run")), "left")
    k = F.coalesce(F.col("o.skip"), F.lit(0)) + F.row_number().over(W.partitionBy("d.source", "d.size", "d.run").orderBy("d.k", "d.id"))
    # A millionth keeps whole sums of rates off the edge at which they would be rounded down.
    edge = lambda i: F.floor(F.col("d.begin") + i * F.col("d.rate") + 1e-6)
    copies = F.least((edge(k) - edge(k - 1)).cast("int"), F.lit(int(most)))
    return placed.select("d.id", "d.k", "d.source", "d.size", "d.source_size", "d.target", "d.rate", copies.alias("copies"))


def deal_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, numbered by ``copy_no``; texts without words are not taken.

    Rows that repeat id and text stand for each other: together they get the sum of their copies.
    """
    taken = mixed.where("size > 0").groupBy("k").agg(F.sum("copies").cast("int").alias("__ls_copies"), F.count("*").alias("__ls_rows")).where("__ls_copies > 0").withColumnRenamed("k", "__ls_k")
    # One row per document taken: never broadcast, however small it may be here.
    taken = stored(taken, "mix-taken")
    repeated = taken.where("__ls_rows > 1").select("__ls_k")
    keyed = docs.withColumn("__ls_k", F.xxhash64(id_col, text_col))
    if repeated.isEmpty():
        dealt = keyed.join(taken.hint("merge"), "__ls_k")
    else:
        held = narrowed(keyed, "__ls_k", repeated).join(taken.hint("merge"), "__ls_k")
        once = narrowed(keyed, "__ls_k", repeated, inside=False).join(taken.hint("merge"), "__ls_k").unionByName(held.where("__ls_rows = 1"))
        dealt = once.unionByName(held.where("__ls_rows > 1").dropDuplicates(["__ls_k"]))
    return dealt.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__ls_copies"))).alias("copy_no"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "rate", "copies")


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES: dict[str, str] = {}
