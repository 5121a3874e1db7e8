"""Chat rendering by perspective rotation, in DataFrame functions only.

A dialogue of several speakers is rendered once for every participant: that speaker's turns become the assistant's,
all others become named users, and only the assistant's words are left unmasked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import running_sums
from loomstone.session import table

# The markers of the rendering.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
SAFE = "< |"
NAMELESS = "unknown"


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation and participant: ``conversation, perspective, n_turns, rendered, mask``.

    ``mask`` lists ``start:end`` of the code points to train on (the perspective speaker's words with their end
    marker), joined by commas. Narrators keep their own header and get no perspective of their own; a dialogue of
    narrators only is rendered once, with a null perspective and nothing to train on. Defined cases: a null speaker
    is named "unknown", a null text is empty, a null conversation id makes the row a dialogue of its own, equal
    turns are ordered by speaker and text (null turns first), repeated rows are repeated turns, and an empty table
    gives an empty result. The turns of one dialogue are one record, so its length bounds what a task gathers; rows
    without an id are never gathered. Marks cannot be forged: an opening mark within a text gets a space (``< |``), and
    bars and line ends within a name become spaces. Very long dialogues take time in proportion.
    """
    rows = turns.select(F.col(conversation).alias("conversation"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit(NAMELESS)).alias("who"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(OPEN), F.lit(SAFE)).alias("said")).alias("t"))
    named = rows.where("conversation is not null").groupBy("conversation").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    alone = rows.where("conversation is null").select("conversation", F.array("t").alias("turns"))
    talk = named.unionByName(alone)

    narrates = lambda who: who.isin(*narrators) if narrators else F.lit(False)
    people = F.array_sort(F.array_distinct(F.transform(F.filter("turns", lambda x: ~narrates(x["who"])), lambda x: x["who"])))
    talk = talk.select("conversation", "turns", F.explode_outer(people).alias("perspective"))

    def head(x: Column) -> Column:
        role = F.when(narrates(x["who"]), x["who"]).when(x["who"] == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.translate(x["who"], "|\n", "  ")))
        return F.concat(F.lit(OPEN), role, F.lit(CLOSE))

    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["said"], F.lit(END)).alias("body"), F.coalesce(x["who"] == F.col("perspective"), F.lit(False)).alias("own")))
    talk = talk.select("conversation", "perspective", F.size("turns").cast("long").alias("n_turns"), parts.alias("parts"))
    ends = running_sums(F.transform("parts", lambda x: F.length(x["head"]) + F.length(x["body"])))
    return talk.select(
        "conversation", "perspective", "n_turns",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.array_join(F.filter(F.zip_with("parts", ends, lambda x, e: F.when(x["own"], F.concat_ws(":", e - F.length(x["body"]), e))), lambda m: m.isNotNull()), ",").alias("mask"),
    )


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations")).withColumnRenamed("conversation", "conv_id")


_SQL = """
WITH t AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'r' || row_number() OVER ()) AS k, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT k, CASE WHEN who <> 'system' THEN who END AS perspective FROM t
  QUALIFY perspective IS NOT NULL OR max((who <> 'system')::INT) OVER (PARTITION BY k) = 0),
parts AS (SELECT t.conv_id, t.k, p.perspective, t.turn, t.who, t.said,
  '<|' || CASE WHEN who = 'system' THEN who WHEN who = perspective THEN 'assistant' ELSE 'user name=' || translate(who, '|' || chr(10), '  ') END || '|>' || chr(10) AS head,
  said || '<|end|>' || chr(10) AS body, row_number() OVER (PARTITION BY t.k, p.perspective ORDER BY turn NULLS FIRST, who, said) AS i
  FROM t JOIN people p ON t.k = p.k),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY k, perspective ORDER BY i) AS upto FROM parts)
SELECT any_value(conv_id) AS conv_id, perspective, count(*) AS n_turns, string_agg(head || body, '' ORDER BY i) AS rendered,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY i) FILTER (who = perspective), '') AS mask
FROM placed GROUP BY k, perspective"""

QUERIES = {"op9_chat_rotation": op9_chat_rotation}
ORACLES = {"op9_chat_rotation": _SQL}
