"""Quality rules judged by host: failures of whole texts, rates of hosts drawn to what is usual, verdicts joined back.

A host's share of documents that fail a rule says little where it has few. Each rule's rates are therefore shrunk by a
beta prior that is itself estimated from all hosts; a host whose shrunk rate is high is rejected, or held suspect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import stored
from loomstone.session import table

#: A host is rejected where the shrunk rate of a base rule reaches the first, and suspect of a rule from the second on.
REJECT, SUSPECT = 0.5, 0.2
#: Bounds of a prior's weight, in documents: between rates of hosts that have nothing in common and rates that all agree.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: Hosts with a verdict that are broadcast at most (two short columns each); more are joined by shuffling.
BROADCAST = 500_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Rules over the measures, as SQL. The base rules decide a document by themselves, the others only on suspect hosts.
BASE_RULES = {"few_words": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
HOST_RULES = {"symbols": "10 * n_symbols > n_words", "lines": "100 * n_dup_lines > 30 * n_lines"}


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in some window of three words which occurs twice or more, the first time included."""
    if len(words) < 4:  # two windows at least
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The measures of one whole text, in the order of ``MEASURES``."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()  # of bytes: at spaces and the five control characters, nothing else
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = int(((raw & 0xC0) != 0x80).sum() - _SPACES[raw].sum())
    return len(words), chars, int(_SYMBOLS[raw].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the measures of their whole texts; null texts have none of
    anything. Columns named as a measure are replaced."""
    chosen = docs.columns if keep is None else keep
    fields = {f.name: f for f in docs.schema.fields}
    passed = [fields[c] for c in chosen if c.lower() not in MEASURES]
    schema = T.StructType([*passed, *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            found = np.array([measures(t.as_py() or b"") for t in texts], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[:, k]) for k in range(len(MEASURES))]], names=[f.name for f in schema.fields])

    return docs.select(*[_quoted(f.name) for f in passed], _quoted(text_col).alias("__ls_text")).mapInArrow(run, schema)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """``host, rule, n, failed, rate``: shrunk failure rates of all hosts by all rules.

    Documents of a host are counted before they are shuffled, so a host may have any number of them. The prior of a rule
    is fitted to all hosts' counts by moments (analysis of variance for shares of unequal sizes): the mean is the share of
    all documents that fail, the weight follows from how far hosts differ beyond chance. Where they do not, or there are
    too few to tell, the weight is ``MOST_WEIGHT`` or ``LEAST_WEIGHT``. Rows without a host are not counted.
    """
    rules = BASE_RULES | HOST_RULES
    counts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.count_if(F.expr(r)).alias(f"r_{name}") for name, r in rules.items()])
    long = counts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r_{name}").alias("failed")) for name in rules])).alias("x")).select("host", "x.rule", "n", "x.failed")
    sums = long.groupBy("rule").agg(
        F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.sum("failed").cast("double").alias("bad"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("between"),
    )
    p = F.col("bad") / F.col("all")
    among = (F.col("between") - F.col("all") * p * p) / (F.col("k") - 1)
    within = (F.col("bad") - F.col("between")) / (F.col("all") - F.col("k"))
    each = (F.col("all") - F.col("squares") / F.col("all")) / (F.col("k") - 1)
    alike = among - within  # how far hosts differ beyond chance, in units of ``each`` documents
    weight = F.when((F.col("k") < 2) | (F.col("all") <= F.col("k")), F.lit(LEAST_WEIGHT)).when(alike <= 0, F.lit(MOST_WEIGHT)).otherwise(F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), each * within / alike)))
    priors = sums.select("rule", p.alias("p"), weight.alias("w"))
    rate = F.round((F.col("failed") + F.col("p") * F.col("w")) / (F.col("n") + F.col("w")), 9)
    return long.join(F.broadcast(priors), "rule").select("host", "rule", "n", "failed", rate.alias("rate"))  # one prior a rule


def host_verdicts(rates: DataFrame, reject: float = REJECT, suspect: float = SUSPECT) -> DataFrame:
    """``host, rejected, suspect_of`` of the hosts that are rejected, or suspect of some rule; the others have no row."""
    bad = F.col("rule").isin(*BASE_RULES) & (F.col("rate") >= reject)
    out = rates.groupBy("host").agg(F.max(bad).alias("rejected"), F.array_sort(F.collect_set(F.when(F.col("rate") >= suspect, F.col("rule")))).alias("suspect_of"))  # one row a rule
    return out.where(F.col("rejected") | (F.size("suspect_of") > 0))


def judge(measured: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """``measured`` with ``base_failed``, ``host_rejected`` and ``kept``.

    A document goes if it fails a base rule, if its host is rejected, or if it fails a further rule of which its host is
    suspect. The verdicts are broadcast up to ``BROADCAST`` hosts; beyond, documents are shuffled by host, and adaptive
    execution splits the hosts that have many.
    """
    few = verdicts.limit(BROADCAST + 1).count() <= BROADCAST
    side = verdicts.select(F.col("host").alias("__ls_host"), F.col("rejected").alias("__ls_rejected"), F.col("suspect_of").alias("__ls_suspect"))
    rows = measured.join(F.broadcast(side) if few else side.hint("merge"), F.col(host) == F.col("__ls_host"), "left")
    failed = F.expr(" OR ".join(f"({r})" for r in BASE_RULES.values()))
    rejected = F.coalesce("__ls_rejected", F.lit(False))
    soft = F.lit(False)
    for name, rule in HOST_RULES.items():
        soft = soft | (F.expr(rule) & F.coalesce(F.array_contains("__ls_suspect", name), F.lit(False)))
    rows = rows.withColumns({"base_failed": failed, "host_rejected": rejected, "kept": ~(failed | rejected | soft)})
    return rows.drop("__ls_host", "__ls_rejected", "__ls_suspect")


def judge_documents(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT, suspect: float = SUSPECT) -> DataFrame:
    """``id, host``, the measures, ``base_failed, host_rejected, kept`` for every row of ``docs``.

    Whole texts are measured once, in Arrow batches; what is measured is stored, a few numbers a row, and read twice: for
    the rates of hosts and for the verdicts.

    Defined cases: a null or empty text has no words and fails; a row with a null host is judged by itself; repeated rows
    count as often as they occur; a null id is kept as it is; texts of any length are measured whole; an empty table gives
    an empty result; other columns are not looked at, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = stored(measure(rows, keep=["id", "host"]), "measures")
    return judge(measured, stored(host_verdicts(host_rates(measured, "host"), reject, suspect), "verdicts"), "host")


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


_RULES = BASE_RULES | HOST_RULES
_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT i, unnest(range(1, len(w) - 1)) AS k, w FROM d WHERE len(w) > 2), h AS (SELECT i, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM g),
r AS (SELECT i, unnest([k, k + 1, k + 2]) AS k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, a, b, c) AS m FROM h) WHERE m > 1), n3 AS (SELECT i, count(DISTINCT k) AS n_repeat_words FROM r GROUP BY 1),
l AS (SELECT i, unnest(string_split(t, chr(10))) AS line FROM d), m AS (SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
x AS (SELECT i, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN n3 USING (i) LEFT JOIN m USING (i)),
f AS (SELECT *, {', '.join(f'({rule}) AS f_{name}' for name, rule in _RULES.items())} FROM x),
c AS ({' UNION ALL '.join(f"SELECT source AS host, '{name}' AS rule, count(*)::DOUBLE AS n, count(*) FILTER (f_{name})::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY 1" for name in _RULES)}),
s AS (SELECT rule, count(*) AS k, sum(n) AS a, sum(n * n) AS q, sum(bad) AS b, sum(bad * bad / n) AS z FROM c GROUP BY 1),
v AS (SELECT rule, k, a, b / a AS p, (z - b * b / a) / nullif(k - 1, 0) - (b - z) / nullif(a - k, 0) AS alike, (b - z) / nullif(a - k, 0) AS within, (a - q / a) / nullif(k - 1, 0) AS each FROM s),
o AS (SELECT rule, p, CASE WHEN k < 2 OR a <= k THEN {LEAST_WEIGHT} WHEN alike <= 0 THEN {MOST_WEIGHT} ELSE least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, each * within / alike)) END AS w FROM v),
y AS (SELECT host, rule, round((bad + p * w) / (n + w), 9) AS rate FROM c JOIN o USING (rule)),
j AS (SELECT host, bool_or(rule IN ({', '.join(f"'{b}'" for b in BASE_RULES)}) AND rate >= {REJECT}) AS rejected, {', '.join(f"bool_or(rule = '{name}' AND rate >= {SUSPECT}) AS s_{name}" for name in HOST_RULES)} FROM y GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({' OR '.join(f'f_{b}' for b in BASE_RULES)}) AS base_failed,
  NOT (({' OR '.join(f'f_{b}' for b in BASE_RULES)}) OR coalesce(rejected, false) OR {' OR '.join(f'(f_{s} AND coalesce(s_{s}, false))' for s in HOST_RULES)}) AS kept, coalesce(rejected, false) AS host_rejected FROM f LEFT JOIN j ON f.source = j.host"""

QUERIES = {"op12_host_rules": op12_host_rules}
ORACLES = {"op12_host_rules": _SQL}
