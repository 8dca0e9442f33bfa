"""Chat formatting by perspective rotation: each speaker of a dialogue in turn becomes the assistant.

For every participant, the dialogue is rendered with that speaker's turns as assistant and everybody else's as named
users; the loss mask covers the assistant's words and end marks only. A role in SYSTEM is no participant: its turns are
instructions, the same from every perspective, and never in the mask.

The result has a row for each perspective and turn, with its place in the rendered dialogue; segments in the order of
`start` are the dialogue. Nothing gathers a dialogue in one place: places are sums in two steps, over blocks of BLOCK
turns and within a block, so a conversation that holds a third of all turns is spread like any other.

Defined results: rows that repeat as a whole (conv_id, turn, role, text) count once. Turns of equal number are ordered
by role, then text. Null turn comes first. Null role is the speaker 'unknown'; null text is empty. Null conv_id is one
conversation of its own. A conversation of system turns only has no perspective and no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read

SYSTEM = ("system",)
BLOCK = 512
END = "<|end|>\n"


def head(role: Column, speaker: Column) -> Column:
    return F.when(role.isin(*SYSTEM), F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, role (as rendered), name, segment, start, n_chars, mask_start, mask_end."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("who"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    speakers = t.filter(~F.col("who").isin(*SYSTEM)).select("conv_id", F.col("who").alias("speaker")).distinct()
    left, right = t.alias("t"), speakers.alias("s")
    rows = left.join(right, F.col("t.conv_id").eqNullSafe(F.col("s.conv_id"))).select("t.conv_id", "speaker", "turn", "who", "text")
    segment = F.concat(head(F.col("who"), F.col("speaker")), "text", F.lit(END))
    rows = rows.withColumn("segment", segment).withColumn("n_chars", F.length("segment").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    # characters before each block: a row for each block, whatever the number of turns in it
    blocks = rows.groupBy("conv_id", "speaker", "block").agg(F.sum("n_chars").alias("in_block"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("speaker").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("in_block").over(W.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("p")) & (F.col("block") == F.col("b")))
    inside = W.partitionBy("conv_id", "speaker", "block").orderBy("turn", "who", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("n_chars").over(inside), F.lit(0)))
    mine = F.col("who") == F.col("speaker")
    return placed.select(
        "conv_id",
        "speaker",
        "turn",
        F.when(F.col("who").isin(*SYSTEM), "system").when(mine, "assistant").otherwise("user").alias("role"),
        F.when(~mine & ~F.col("who").isin(*SYSTEM), F.col("who")).alias("name"),
        "segment",
        "start",
        "n_chars",
        F.when(mine, F.col("start") + F.length(head(F.col("who"), F.col("speaker")))).alias("mask_start"),
        F.when(mine, F.col("start") + F.col("n_chars")).alias("mask_end"),
    )


def op6_perspectives(spark, sf_dir: str) -> DataFrame:
    out = rotate(read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "speaker", "turn", "role", "name", "start", "n_chars", "mask_start", "mask_end", F.sha2("segment", 256).alias("segment_sha256"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
r AS (
  SELECT t.conv_id, speaker, turn, who, text,
         CASE WHEN who = 'system' THEN '<|system|>' WHEN who = speaker THEN '<|assistant|>' ELSE '<|user name=' || who || '|>' END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM r),
p AS (SELECT *, length(segment)::BIGINT AS n_chars,
             coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM g)
SELECT conv_id, speaker, turn,
       CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN who NOT IN ('system', speaker) THEN who END AS name,
       start, n_chars,
       CASE WHEN who = speaker THEN start + length(head) END AS mask_start,
       CASE WHEN who = speaker THEN start + n_chars END AS mask_end,
       sha256(segment) AS segment_sha256
FROM p
"""
