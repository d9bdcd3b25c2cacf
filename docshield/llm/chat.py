"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once more with that
speaker as the assistant: the participant's own turns carry the loss mask, all others
are turns of named users.  ``system`` turns are shared context: they stay system turns
in every perspective, without mask, and have no perspective of their own.

The result is one row per (conversation, perspective, turn) with the turn's place in the
rendered dialogue, so a conversation of any length is never gathered in one task: places
are running sums over blocks of turns, then over the blocks.  Native DataFrame functions
only.

Defined cases: a null role is a participant called ``unknown``; a null text is an empty
turn; a null turn number comes first; rows without a conv_id are left out; repeated rows
are rendered once each (ties are ordered by role and text); a conversation of system
turns alone has no perspective and no rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment (the rendered turn), start and length (characters in the rendered dialogue),
    content_start and content_length (the text inside), mask (1: learn from the content)."""
    c = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = c.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    c = c.join(people, "conv_id").withColumn("own", F.col("speaker") == F.col("perspective"))
    role = F.when(F.col("own"), "assistant").when(F.col("speaker") == "system", "system").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("|>\n"))
    c = c.select("conv_id", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"), head.alias("head"), F.col("own").cast("int").alias("mask"))
    c = c.withColumn("segment", F.concat("head", "text", F.lit("<|end|>\n"))).withColumn("length", F.length("segment").cast("long"))
    c = c.withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "perspective"]
    sums = c.groupBy(*key, "block").agg(F.sum("length").alias("size"))
    ahead = Window.partitionBy(*key).orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.col("block").alias("_block"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*key, "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    c = c.join(sums.withColumnsRenamed({k: f"_{k}" for k in key}), (F.col("conv_id") == F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & F.col("block").eqNullSafe(F.col("_block")))
    start = F.col("ahead") + F.col("inside")
    return c.select("conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"), "length",
                    (start + F.length("head")).alias("content_start"), F.length("text").cast("long").alias("content_length"), "mask")


#: The same rows in DuckDB SQL.
ROTATED_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
r AS (SELECT c.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role FROM c JOIN p USING (conv_id)),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT conv_id, perspective, turn, role, name, segment, start, CAST(length(segment) AS BIGINT) AS length,
       CAST(start + length(head) AS BIGINT) AS content_start, CAST(length(text) AS BIGINT) AS content_length, CAST(speaker = perspective AS INTEGER) AS mask FROM o
"""
