"""What readers and writers do, on columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.text import strip
from loomstone.plans.base import Plans
from loomstone.session import table

plans = Plans()


@plans.add("nonempty_lines", r"""
WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS line FROM documents) SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM l WHERE line <> '' GROUP BY 1""")
def nonempty_lines(spark, sf):
    """Stripped lines that are not blank, counted per document."""
    l = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", strip(F.col("line")).alias("line")).where("line <> ''")
    return l.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@plans.add("parsed_durations", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE value::VARCHAR END AS s FROM events) SELECT 's' || event_id AS sample_id, try_cast(s AS DOUBLE) AS seconds FROM r WHERE try_cast(s AS DOUBLE) BETWEEN 0 AND 320""")
def parsed_durations(spark, sf):
    """Numbers within an inclusive range; what is no number is passed over."""
    s = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).try_cast("double")
    return table(spark, sf, "events").select(F.concat(F.lit("s"), "event_id").alias("sample_id"), s.alias("seconds")).where(F.col("seconds").between(0, 320))


@plans.add("held_out_map", "SELECT user_id AS speaker_id, arg_max(event_id, event_id) AS sample_id FROM events GROUP BY 1")
def held_out_map(spark, sf):
    """One sample per speaker; the last row counts."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("speaker_id")).agg(F.max_by("event_id", "event_id").alias("sample_id"))


@plans.add("parsed_properties", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def parsed_properties(spark, sf):
    """Numbers from JSON text, with a fixed schema."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@plans.add("probed_seconds", "SELECT event_id, round((event_id * 160) / (8000.0 * (1 + user_id % 3)), 9) AS seconds FROM events")
def probed_seconds(spark, sf):
    from loomstone.sources.readers import probe_seconds

    return table(spark, sf, "events").select("event_id", F.round(probe_seconds(F.col("event_id") * 160, 8000.0 * (1 + F.col("user_id") % 3)), 9).alias("seconds"))


@plans.add("report_rows", """SELECT '<tr><td>' || conv_id || '</td><td>' || role || '</td><td>' || replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr>' AS html FROM conversations""")
def report_rows(spark, sf):
    from loomstone.sources.sinks import html_rows

    return html_rows(table(spark, sf, "conversations"), ["conv_id", "role", "text"])


@plans.add("latex_samples", "SELECT conv_id, turn, '\\begin{quote}' || chr(10) || replace(replace(replace(text, '%', '\\%'), '&', '\\&'), '_', '\\_') || chr(10) || '\\end{quote}' AS latex FROM conversations".replace("\\\\", "\\"))
def latex_samples(spark, sf):
    """Samples as quotations of a typeset document."""
    t = F.col("text")
    for c in "%&_":
        t = F.replace(t, F.lit(c), F.lit("\\" + c))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("\\begin{quote}\n"), t, F.lit("\n\\end{quote}")).alias("latex"))
