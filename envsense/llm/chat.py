"""Operator 7: perspective rotation of dialogues.

For every participant of a dialogue (every distinct role or speaker) the whole dialogue is rendered with
that speaker as ``assistant`` and the others as ``user`` with their names; only the assistant's turns,
end mark included, are trained on. The result is one row per dialogue, perspective and turn, with the
turn's place in the rendered dialogue, so a dialogue of any length never has to fit into one row or task:
running lengths are summed within blocks of turns, then over the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column

#: Turns of a dialogue that are numbered and summed together.
BLOCK_TURNS = 512
#: The marks of the rendering.
START, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, *, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, trained, mask_start, mask_end, start, end.

    ``segment`` is ``<|im_start|>assistant\\n…<|im_end|>\\n`` or ``<|im_start|>user name=…\\n…<|im_end|>\\n``;
    the segments of a perspective in the order of ``start`` are the rendered dialogue. ``trained`` marks
    the perspective's own turns; characters [mask_start, mask_end) of the rendering are then trained on
    (content and end mark); for others that range is empty. Turns are ordered by number, then speaker, then text.
    A null speaker is a participant named ``unknown``; a null text renders as empty; null dialogue ids
    are one dialogue, null turn numbers come first. Repeated rows are repeated turns. Other columns are
    not carried. An empty table gives an empty result.
    """
    rows = turns.select(
        column(dialogue).alias("conv_id"),
        F.coalesce(F.concat(F.lit("k"), column(dialogue).cast("string")), F.lit("null")).alias("key"),
        column(turn).cast("long").alias("turn"),
        F.coalesce(column(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(column(text).cast("string"), F.lit("")).alias("content"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    # Lengths alone go through the sums: all turns as those of users, then what differs for one's own.
    tail, own_head, user_head = len(END) + 1, len(START) + len("assistant\n"), F.char_length("speaker") + len(f"{START}user name=\n")
    per = rows.groupBy("key", "block", "speaker").agg(F.count("*").alias("n"), F.sum(F.char_length("content") + user_head + tail).alias("as_user"))
    blocks = per.groupBy("key", "block").agg(F.sum("as_user").alias("as_users"))
    people = per.select("key", F.col("speaker").alias("perspective")).distinct()
    own = per.select("key", "block", F.col("speaker").alias("perspective"), (F.col("n") * (own_head - user_head)).alias("less"))
    grid = blocks.join(people, "key").join(own, ["key", "block", "perspective"], "left")
    total = F.col("as_users") + F.coalesce("less", F.lit(0))
    so_far = F.sum(total).over(Window.partitionBy("key", "perspective").orderBy("block"))
    grid = grid.select("key", "block", "perspective", (so_far - total).alias("before"))
    # Texts move once, by dialogue and block.
    seen = rows.join(grid, ["key", "block"])
    trained = F.col("speaker") == F.col("perspective")
    head = F.when(trained, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), "speaker", F.lit("\n")))
    seen = seen.withColumns({"trained": trained, "head": F.char_length(head), "segment": F.concat(head, "content", F.lit(f"{END}\n"))})
    inside = Window.partitionBy("key", "block", "perspective").orderBy("turn", "speaker", "content").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("segment").cast("long")
    start = F.col("before") + F.coalesce(F.sum(length).over(inside), F.lit(0))
    end = F.col("start") + length
    return seen.withColumn("start", start).select(
        "conv_id", "perspective", "turn", "speaker", "segment", "trained",
        F.when(F.col("trained"), F.col("start") + F.col("head")).otherwise(end).alias("mask_start"),
        F.when(F.col("trained"), end - 1).otherwise(end).alias("mask_end"),
        "start", end.alias("end"),
    )


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, from the perspective of every participant."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t
), s AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.content, t.speaker = p.perspective AS trained,
         CASE WHEN t.speaker = p.perspective THEN '{START}assistant' || chr(10)
              ELSE '{START}user name=' || t.speaker || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (
  SELECT *, head || content || '{END}' || chr(10) AS segment FROM s
), o AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end"
  FROM r
)
SELECT conv_id, perspective, turn, speaker, segment, trained,
       CASE WHEN trained THEN "end" - length(segment) + length(head) ELSE "end" END AS mask_start,
       CASE WHEN trained THEN "end" - 1 ELSE "end" END AS mask_end,
       "end" - length(segment) AS start, "end"
FROM o
"""
