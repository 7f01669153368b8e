"""Chat formatting: every participant's perspective of a multi-party dialogue.

For each conversation and each speaker in it, the dialogue is rendered with that speaker as the
assistant and the others as named users; system turns stay system turns and are nobody's
perspective.  The result is one row a (conversation, perspective, turn) with the rendered segment,
its character range in the rendered dialogue, and the range the loss covers (the assistant's body),
so a dialogue is its segments in order of `position`, however long it is, and none is gathered
in one place.  Ranges and positions are two-level prefix sums: within blocks of `BLOCK` turn numbers,
then over a conversation's blocks.

Bodies are escaped (`\\` to `\\\\`, `<|` to `<\\|`), so a header never occurs in one and
`unescape` gives the text back.  Names in headers are escaped further (`|>` to `|\\>`, line ends to
`\\n`), so no role ends its header early.

Defined cases: null texts are empty; a null role is the participant "unknown"; turns that are equal
or null stand in the order of (turn, role, text), nulls first; repeated rows are repeated turns; a
conversation without speakers (system only) has no perspective; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 128
SYSTEM = "system"
UNKNOWN = "unknown"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_name(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit("\\n"))


def unescape(body: str) -> str:
    return body.replace("<\\|", "<|").replace("\\\\", "\\")


def _header(perspective: Column, role: Column) -> Column:
    return (
        F.when(role == SYSTEM, "<|system|>\n")
        .when(role == perspective, "<|assistant|>\n")
        .otherwise(F.concat(F.lit("<|user name="), escape_name(role), F.lit("|>\n")))
    )


def perspectives(turns: DataFrame) -> DataFrame:
    """Segments of every perspective of `turns` (conv_id, turn, role, text)."""
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("_block"),
    )
    seats = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(seats, said.conv_id.eqNullSafe(seats["_conv"])).drop("_conv")
    seen = seen.withColumn("_header", _header(F.col("perspective"), F.col("speaker")))
    seen = seen.withColumn("segment", F.concat("_header", "body", F.lit("\n"))).withColumn("_size", F.length("segment").cast("long"))
    keys = ["conv_id", "perspective"]
    blocks = seen.groupBy(*keys, "_block").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        *(F.col(k).alias(f"_{k}") for k in keys),
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_from"),
        F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_first"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("turn", "speaker", "body")
    running = seen.withColumn("_end", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(inside) - 1)
    out = running.join(before, running.conv_id.eqNullSafe(before["_conv_id"]) & (running.perspective == before["_perspective"]) & (running["_block"] == before["_b"]))
    end = F.col("_from") + F.col("_end")
    start = end - F.col("_size")
    own = F.col("speaker") == F.col("perspective")
    return out.select(
        "conv_id",
        "perspective",
        (F.col("_first") + F.col("_nth")).alias("position"),
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        end.alias("end"),
        F.when(own, start + F.length("_header")).alias("mask_start"),
        F.when(own, end).alias("mask_end"),  # with the line end that closes the turn
    )


def op3_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS body
  FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT s.*, p.perspective,
         CASE WHEN s.speaker = 'system' THEN '<|system|>' || chr(10)
              WHEN s.speaker = p.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(replace(replace(replace(s.speaker, '\', '\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n') || '|>' || chr(10) END AS header
  FROM said s JOIN seats p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, header || body || chr(10) AS segment FROM seen),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
                                    ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, segment,
       CAST(upto - length(segment) AS BIGINT) AS start, CAST(upto AS BIGINT) AS "end",
       CAST(CASE WHEN speaker = perspective THEN upto - length(segment) + length(header) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN speaker = perspective THEN upto END AS BIGINT) AS mask_end
FROM placed
"""
