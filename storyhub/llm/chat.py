"""Chat formatting from every participant's side.

For each participant of a conversation the dialogue is rendered once: their own
turns as the assistant's, everyone else's as those of a named user, and a mask
that marks what the assistant says. Long conversations are rendered in chunks of
`chunk_turns` turn numbers, so that no row or task has to hold one of unbounded
length; a conversation of ordinary length is one row per participant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, chunk_turns: int = 64) -> DataFrame:
    """conv_id, speaker, chunk, n_turns, n_own, rendered, mask.

    `rendered` holds one block per turn: a header that names the speaker
    ("assistant" for the participant's own turns, else "user name=..."), the
    text, a closing mark. `mask` has one letter per code point of `rendered`: 1
    over the text and closing mark of own turns, else 0.

    A null role is the participant "unknown"; null text is empty; a turn without
    a conversation is left out, a null turn number comes first. Turns with the
    same number are ordered by role, then text; a turn that occurs twice is
    rendered twice. Other columns are ignored; no turns give no rows.
    """
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    said = said.withColumn("chunk", F.coalesce(F.expr(f"cast(floor(turn / {int(chunk_turns)}) as bigint)"), F.lit(-1)))
    # A chunk is gathered once; each participant's view is made from it.
    chunks = said.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    people = said.select("conv_id", F.col("role").alias("speaker")).distinct()
    views = chunks.join(people, "conv_id")

    def header(x: Column) -> Column:
        name = F.when(x["role"] == F.col("speaker"), "assistant").otherwise(F.concat(F.lit("user name="), x["role"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    def body(x: Column) -> Column:
        return F.concat(x["text"], F.lit(CLOSE + "\n"))

    def marks(x: Column) -> Column:
        own = F.when(x["role"] == F.col("speaker"), "1").otherwise("0")
        return F.concat(
            F.repeat(F.lit("0"), F.char_length(header(x))), F.repeat(own, F.char_length(body(x)))
        )

    return views.select(
        "conv_id",
        "speaker",
        "chunk",
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["role"] == F.col("speaker"))).cast("long").alias("n_own"),
        F.array_join(F.transform("t", lambda x: F.concat(header(x), body(x))), "").alias("rendered"),
        F.array_join(F.transform("t", marks), "").alias("mask"),
    )


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS chunk
  FROM conversations WHERE conv_id IS NOT NULL
),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM said),
blocks AS (
  SELECT s.conv_id, p.speaker, s.chunk, s.turn, s.role, s.text,
         '<|im_start|>' || CASE WHEN s.role = p.speaker THEN 'assistant' ELSE 'user name=' || s.role END || chr(10) AS head,
         s.text || '<|im_end|>' || chr(10) AS body, s.role = p.speaker AS own
  FROM said s JOIN people p USING (conv_id)
)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       string_agg(repeat('0', length(head)) || repeat(CASE WHEN own THEN '1' ELSE '0' END, length(body)), ''
                  ORDER BY turn NULLS FIRST, role, text) AS mask
FROM blocks GROUP BY conv_id, speaker, chunk
"""
