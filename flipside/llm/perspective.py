"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as
``assistant`` and everyone else as ``user``, named; only the assistant's words are trained on.
A rendered dialogue is returned as its turns in order, each with its text and its span in the
whole, so that no conversation, however long, has to fit into one row or task: spans are summed
per run of turns first, then over the runs. ``dialogue`` joins the turns of short conversations
into one text with its training spans.

A turn is rendered as ``<|user|>name: text`` or ``<|assistant|>text``, closed by ``<|end|>`` and a
line feed; the mask covers the text and the end mark of the assistant's turns.

Edge cases: turns with a null conversation are left out; a null speaker is the participant
``unknown``; a null text is empty; a null turn comes first; turns of equal number are ordered by
speaker and text, and repeated rows are repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Consecutive turn numbers summed up together.
RUN_TURNS = 256
UNKNOWN = "unknown"
USER, ASSISTANT, END = "<|user|>", "<|assistant|>", "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation, participant and turn.

    ``chat_role`` is what the turn is rendered as, ``rendered`` its text, ``start`` and ``stop``
    its span of characters in the whole dialogue, ``mask_start`` and ``mask_stop`` the part that is
    trained on (null in others' turns).
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("words"),
    ).filter("conv_id IS NOT NULL")
    participants = rows.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), "speaker", F.lit(": ")))
    rendered = (
        rows.join(participants, "conv_id")
        .withColumn("chat_role", F.when(own, F.lit("assistant")).otherwise(F.lit("user")))
        .withColumn("rendered", F.concat(header, "words", F.lit(END)))
        .withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit(-(1 << 60))))
        .withColumn("size", F.length("rendered").cast("bigint"))
    )
    dialogue = ["conv_id", "perspective"]
    runs = rendered.groupBy(*dialogue, "run").agg(F.sum("size").alias("run_size"), F.count("*").alias("run_turns"))
    earlier = Window.partitionBy(*dialogue).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *dialogue,
        "run",
        F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_start"),
        F.coalesce(F.sum("run_turns").over(earlier), F.lit(0)).alias("run_place"),
    )
    inside = Window.partitionBy(*dialogue, "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "words")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rendered.withColumn("stop_in_run", F.sum("size").over(inside))
        .withColumn("place_in_run", F.count("*").over(inside))
        .join(starts, [*dialogue, "run"])
        .withColumn("stop", F.col("run_start") + F.col("stop_in_run"))
        .withColumn("start", F.col("stop") - F.col("size"))
    )
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("run_place") + F.col("place_in_run") - 1).alias("place"),
        "turn",
        "speaker",
        "chat_role",
        "rendered",
        "start",
        "stop",
        F.when(own, F.col("start") + len(ASSISTANT)).alias("mask_start"),
        F.when(own, F.col("stop") - 1).alias("mask_stop"),
    )


def dialogue(perspectives: DataFrame) -> DataFrame:
    """Whole texts of conversations that fit into a row: ``(conv_id, perspective, text, masks)``."""
    turn = F.struct("place", "rendered", "mask_start", "mask_stop")
    whole = perspectives.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    trained = F.filter("turns", lambda part: part.mask_start.isNotNull())
    return whole.select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("turns", lambda part: part.rendered), "").alias("text"),
        F.transform(trained, lambda part: F.struct(part.mask_start, part.mask_stop)).alias("masks"),
    )


ORACLE_SQL = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS words
    FROM conversations WHERE conv_id IS NOT NULL
), rendered AS (
    SELECT r.*, p.perspective, r.speaker = p.perspective AS own,
           CASE WHEN r.speaker = p.perspective THEN '<|assistant|>' ELSE '<|user|>' || r.speaker || ': ' END
               || r.words || '<|end|>' || chr(10) AS rendered
    FROM rows r JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM rows) p USING (conv_id)
), placed AS (
    SELECT *, sum(length(rendered)) OVER w AS stop, count(*) OVER w - 1 AS place
    FROM rendered
    WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, words
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, perspective, CAST(place AS BIGINT) AS place, turn, speaker,
       CASE WHEN own THEN 'assistant' ELSE 'user' END AS chat_role, rendered,
       CAST(stop - length(rendered) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
       CAST(CASE WHEN own THEN stop - length(rendered) + 13 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN own THEN stop - 1 END AS BIGINT) AS mask_stop
FROM placed
"""
