"""Texts scored by a model that is counted in the cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.text import words
from loomstone.operators import language_model as L
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()


def _sql(window: int, stride: int, source: str, by: str, first: str = "1") -> str:
    """The model of all documents, and the scores of ``source`` (``key, w``: words) by ``by``."""
    return rf"""
WITH docs AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
t AS (SELECT CASE WHEN i > 2 THEN w[i - 2] ELSE '' END AS u, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS v, w[i] AS x FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
c3 AS (SELECT u, v, x, count(*) AS n FROM t WHERE u <> '' GROUP BY ALL), c2 AS (SELECT v, x, count(*) AS n FROM t WHERE v <> '' GROUP BY ALL), c1 AS (SELECT x, count(*) AS n FROM t GROUP BY 1),
a3 AS (SELECT u, v, sum(n) AS seen, count(*) AS ways FROM c3 GROUP BY ALL), a2 AS (SELECT v, sum(n) AS seen, count(*) AS ways FROM c2 GROUP BY 1), a1 AS (SELECT sum(n) AS n, count(*) AS d FROM c1),
src AS ({source}), k AS (SELECT *, unnest(range(0, ceil(greatest(len(w) - {window}, 0) / {stride}.0)::BIGINT + 1)) AS k FROM src WHERE len(w) >= 2),
win AS (SELECT *, least(len(w), {window} + k * {stride}) AS stop, CASE WHEN k = 0 THEN 1 ELSE least(len(w), {window} + (k - 1) * {stride}) END AS start FROM k),
pos AS (SELECT *, greatest(0, stop - {window}) AS begin, unnest(range(greatest(start, {first}), stop)) AS i FROM win),
g AS (SELECT {by}, CASE WHEN i - 2 >= begin THEN w[i - 1] ELSE '' END AS u, CASE WHEN i - 1 >= begin THEN w[i] ELSE '' END AS v, w[i + 1] AS x FROM pos),
p1 AS (SELECT g.*, (coalesce(c1.n, 0) + 1) / (a1.n + a1.d + 1)::DOUBLE AS p FROM g LEFT JOIN c1 USING (x), a1),
p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN a2.seen IS NULL THEN p ELSE (greatest(coalesce(c2.n, 0) - 0.75::DOUBLE, 0) + 0.75::DOUBLE * a2.ways * p) / a2.seen END AS p FROM p1 LEFT JOIN c2 USING (v, x) LEFT JOIN a2 USING (v)),
p3 AS (SELECT p2.* EXCLUDE (p), CASE WHEN a3.seen IS NULL THEN p ELSE (greatest(coalesce(c3.n, 0) - 0.75::DOUBLE, 0) + 0.75::DOUBLE * a3.ways * p) / a3.seen END AS p FROM p2 LEFT JOIN c3 USING (u, v, x) LEFT JOIN a3 USING (u, v))
SELECT {by}, count(*)::BIGINT AS n, round(-avg(ln(p)) / ln(2), 6) AS bits_per_token, round(exp(-avg(ln(p))), 5) AS perplexity FROM p3 GROUP BY {by}"""


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", words(F.col("text")).alias("w"))


def _rounded(scored):
    return L.perplexities(scored).withColumn("bits_per_token", F.round("bits_per_token", 6)).withColumn("perplexity", F.round("perplexity", 5))


@plans.add("modelled_perplexity", _sql(1024, 512, "SELECT lang, w FROM docs", "lang"))
def modelled_perplexity(spark, sf):
    """Bits a token and perplexity of each language's documents, by a trigram model of all documents."""
    docs = _documents(spark, sf)
    return _rounded(L.score_corpus(docs, F.col("w"), ["lang"]))


@plans.add("modelled_documents", _sql(64, 16, "SELECT doc_id, w FROM docs", "doc_id"))
def modelled_documents(spark, sf):
    """The same for every document by itself, through short windows."""
    docs = _documents(spark, sf)
    return _rounded(L.score_corpus(docs, F.col("w"), ["doc_id"], 64, 16))


@plans.add("modelled_completions", _sql(64, 32, "SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '\\S+') AS w FROM benchmark", "item_id", "8"))
def modelled_completions(spark, sf):
    """Items of the benchmark after their first eight words, which are read but not scored; most words are unknown pairs."""
    items = table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    docs = _documents(spark, sf)
    return _rounded(L.score_few(items, F.col("w"), docs, F.col("w"), ["item_id"], 64, 32, F.lit(8)))
