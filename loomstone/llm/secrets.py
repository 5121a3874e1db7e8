"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned for three base kinds and for long mixed tokens. Each candidate value is hashed, and its hash is
counted over the distinct owners and the distinct repositories of the whole corpus. A value that several owners share,
or that stands in many repositories, be they one owner's, is a widely copied example; one that few repositories of few
owners hold looks live. Base spans always stay, with their verdict; a mixed token becomes a span only where its value
looks live and no base span overlaps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm.common import running_sums, stored
from loomstone.session import table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds in the order in which equal starts are listed, and their patterns.
KINDS = ("assign", "access", "hex", "token")
KEYWORD = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for the least length within the pattern equals dropping shorter matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"
LEAST_ASSIGNED = 6
#: Owners and repositories from which a value is a copied example.
OWNERS, REPOSITORIES = 3, 10

_SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"
_VERDICT = "array<struct<start:int,ord:int,end:int,live:boolean,owners:bigint,repositories:bigint>>"


def _placed(matches: Column, gaps: Column, values: Column, order: int) -> Column:
    """Spans of ``matches``, placed by the lengths of the text between them (code points, end exclusive)."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    zipped = F.arrays_zip(matches.alias("m"), running_sums(sizes).alias("e"), values.alias("v"))
    spans = F.transform(zipped, lambda x: F.struct((x["e"] - F.length(x["m"])).cast("int").alias("start"), F.lit(order).alias("ord"), x["e"].cast("int").alias("end"), x["v"].alias("value")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(_SPAN))


def _text_of(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in order of start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"])))


def _verdict_text(verdicts: Column) -> Column:
    """``kind:start:end:verdict:owners:repositories`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(verdicts, lambda v: F.concat_ws(":", F.element_at(names, v["ord"] + 1), v["start"], v["end"], F.when(v["live"], "live").otherwise("copied"), v["owners"], v["repositories"])))


def _apart(placed: DataFrame) -> DataFrame:
    """``rid, repository, owner, span`` of the mixed tokens that no base span overlaps, from running bounds in order of
    start, so that a text of very many spans takes time in proportion."""
    tagged = lambda name, base: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(base).alias("is_base"), s.alias("span")))
    both = placed.where(F.size("loose") > 0).select("rid", "repository", "owner", F.explode(F.concat(tagged("base", True), tagged("loose", False))).alias("s"))
    by_start = W.partitionBy("rid").orderBy("s.start")
    ended = F.max(F.when(F.col("s.is_base"), F.col("s.span.end"))).over(by_start.rangeBetween(W.unboundedPreceding, W.currentRow))
    begun = F.min(F.when(F.col("s.is_base"), F.col("s.start"))).over(by_start.rangeBetween(W.currentRow, W.unboundedFollowing))
    bounds = both.withColumn("ended", ended).withColumn("begun", begun).where("not s.is_base")
    return bounds.where((F.coalesce("ended", F.lit(0)) <= F.col("s.start")) & (F.col("begun").isNull() | (F.col("begun") >= F.col("s.span.end")))).select("rid", "repository", "owner", F.col("s.span").alias("span"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str = "doc_id", owner: str = "source", widely: int = OWNERS, often: int = REPOSITORIES) -> DataFrame:
    """Find secrets in every whole text and tell copied examples from live-looking values.

    Result: one row per input row with ``id``, ``base`` and ``spans`` (arrays of start, ord, end, value; ``ord``
    indexes ``KINDS``), ``verdicts`` (one for every candidate span, in order: start, ord, end, live, owners,
    repositories), ``n_live`` and ``n_copied``. A value is copied that at least ``widely`` owners or at least ``often``
    repositories hold. Defined cases: null text is empty; a null owner or repository is an owner or repository of its
    own; repeated rows are scanned each for itself but count once in the frequencies; a very long text of very many
    spans takes time in proportion; an empty table gives an empty result; other columns of ``docs`` are not looked at,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = rows.select("id", "repository", "owner", "t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (("m0", ASSIGN), ("m1", ACCESS), ("m2", HEX), ("m3", TOKEN))])
    found = found.select("*", F.when(F.size("m0") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).alias("v0"))

    def spans(k: int, pattern: str, value: str) -> Column:
        return _placed(F.col(f"m{k}"), F.when(F.size(f"m{k}") > 0, F.split("t", pattern, -1)), F.col(value), k)

    def mixed(s: Column) -> Column:
        return s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")

    placed = found.select(
        F.monotonically_increasing_id().alias("rid"), "id", "repository", "owner",
        F.concat(F.filter(spans(0, ASSIGN, "v0"), lambda s: F.length(s["value"]) >= LEAST_ASSIGNED), spans(1, ACCESS, "m1"), spans(2, HEX, "m2")).alias("base"),
        F.filter(spans(3, TOKEN, "m3"), mixed).alias("loose"),
    )
    # The row numbers hold only as long as the rows do: they are written before they are joined on. Texts are not.
    placed = stored(placed, "secrets")

    candidates = placed.select("rid", "repository", "owner", F.explode("base").alias("span")).unionByName(_apart(placed)).withColumn("digest", F.sha2("span.value", 256))
    held = candidates.select("digest", "owner", "repository").distinct()
    # First within owners, then over them: a value that very many rows hold is summed up before it is moved.
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    by_repository = held.select("digest", "repository").distinct().groupBy("digest").agg(F.count("*").alias("n_repositories"))
    frequency = by_owner.groupBy("digest").agg(F.count("*").alias("n_owners")).join(by_repository, "digest")
    live = (F.col("n_owners") < widely) & (F.col("n_repositories") < often)
    judged = candidates.join(frequency, "digest").select("rid", "span", live.alias("live"), "n_owners", "n_repositories")
    one = F.struct("span.start", "span.ord", "span.end", "live", F.col("n_owners").alias("owners"), F.col("n_repositories").alias("repositories"))
    verdict = judged.groupBy("rid").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"), F.array_sort(F.collect_list(one)).alias("verdicts"),
        F.collect_list(F.when(F.col("live") & (F.col("span.ord") == 3), F.col("span"))).alias("added"),
    )
    return placed.join(verdict, "rid", "left").select(
        "id", "base", F.concat("base", F.coalesce("added", F.array().cast(_SPAN))).alias("spans"), F.coalesce("verdicts", F.array().cast(_VERDICT)).alias("verdicts"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), "n_live", "n_copied", _verdict_text(F.col("verdicts")).alias("verdicts"),
    )


def _sql_spans(pattern: str, order: int, value: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all(t, '{quoted}')) + 1), lambda i: {{'start': list_sum(list_transform(string_split_regex(t, '{quoted}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[1:i - 1], lambda x: length(x))), 0), 'ord': {order}, 'n': length(regexp_extract_all(t, '{quoted}')[i]), 'value': regexp_extract_all(t, '{quoted}', {value})[i]}})"""


def _sql() -> str:
    named = lambda spans: f"array_to_string(list_transform(list_sort({spans}), lambda s: ['assign', 'access', 'hex', 'token'][s.ord + 1] || ':' || s.start || ':' || (s.start + s.n)), ',')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS (SELECT rid, doc_id, source,
  list_concat(list_concat(list_filter({_sql_spans(ASSIGN, 0, "2")}, lambda s: length(s.value) >= {LEAST_ASSIGNED}), {_sql_spans(ACCESS, 1, "0")}), {_sql_spans(HEX, 2, "0")}) AS base,
  list_filter({_sql_spans(TOKEN, 3, "0")}, lambda s: regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[a-z]') AND regexp_matches(s.value, '[A-Z]')) AS any_loose FROM docs),
placed AS (SELECT rid, doc_id, source, base, list_filter(any_loose, lambda s: len(list_filter(base, lambda b: b.start < s.start + s.n AND s.start < b.start + b.n)) = 0) AS loose FROM found),
candidates AS (SELECT rid, doc_id, source, unnest(list_concat(base, loose)) AS span FROM placed),
frequency AS (SELECT span.value AS value, count(DISTINCT coalesce('s' || source, 'n')) AS n_owners, count(DISTINCT coalesce(doc_id::VARCHAR, 'n')) AS n_repositories FROM candidates GROUP BY 1),
judged AS (SELECT rid, span, n_owners, n_repositories, n_owners < {OWNERS} AND n_repositories < {REPOSITORIES} AS live FROM candidates JOIN frequency ON value = span.value),
verdict AS (SELECT rid, sum(live::BIGINT) AS n_live, sum((NOT live)::BIGINT) AS n_copied, list(span) FILTER (live AND span.ord = 3) AS added,
  string_agg(['assign', 'access', 'hex', 'token'][span.ord + 1] || ':' || span.start || ':' || (span.start + span.n) || ':' || CASE WHEN live THEN 'live' ELSE 'copied' END || ':' || n_owners || ':' || n_repositories, ',' ORDER BY span.start, span.ord) AS verdicts
  FROM judged GROUP BY rid)
SELECT doc_id, len(list_filter(base, lambda s: s.ord = 0))::BIGINT AS n_assign, len(list_filter(base, lambda s: s.ord = 1))::BIGINT AS n_access,
  len(list_filter(base, lambda s: s.ord = 2))::BIGINT AS n_hex, sha256({named("base")}) AS base_sha256,
  {named("CASE WHEN added IS NULL THEN base ELSE list_concat(base, added) END")} AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(verdicts, '') AS verdicts
FROM placed LEFT JOIN verdict USING (rid)"""


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES = {"op3_secret_scan": _sql()}
