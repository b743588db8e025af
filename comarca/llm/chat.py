"""Preference formatting: common turns once as the prompt, then both completions with loss masks.

The longest common prefix of a chosen and a rejected conversation is found by joining their turns by
place and taking the first place at which they differ; no conversation is collected for it. Turns
are rendered in the task that reads them and put together per pair at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END))


def placed(turns: DataFrame, key: str = "pair_id") -> DataFrame:
    """Turns (key, turn, role, text) with `place`, 0-based in order of turn.

    Turns that repeat role and text at the same number count once; other ties go by role, then
    text. Null roles and texts are empty; turns without key or number are left out."""
    rows = turns.filter(F.col(key).isNotNull() & F.col("turn").isNotNull())
    rows = rows.select(key, "turn", *[F.coalesce(k, F.lit("")).alias(k) for k in ("role", "text")]).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn", "role", "text")) - 1
    return rows.select(key, place.alias("place"), "role", "text")


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair_id that both sides have: prompt, n_prompt_turns, chosen, rejected, and their masks.

    Both tables hold placed turns (pair_id, place, role, text). A completion is the rendered rest of
    its conversation, empty if the prompt is all of it. A mask lists [start, length] in characters of
    what counts for the loss: the text and end mark of assistant turns. Pairs whose conversations are equal
    carry no preference and are left out.
    """
    both = chosen.withColumn("side", F.lit(1)).union(rejected.withColumn("side", F.lit(0)))
    at = both.groupBy("pair_id", "place").agg(
        F.count("*").alias("n"), F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1")
    )
    same = (F.col("n") == 2) & (F.col("r0") == F.col("r1")) & (F.col("t0") == F.col("t1"))
    parts = both.groupBy("pair_id").agg(F.min("side").alias("x"), F.max("side").alias("y")).filter("x < y")
    common = at.filter(~same).groupBy("pair_id").agg(F.min("place").alias("common"))
    pairs = common.join(parts.select("pair_id"), "pair_id")
    rows = both.join(pairs, "pair_id").filter((F.col("side") == 1) | (F.col("place") >= F.col("common")))
    part = F.when(F.col("place") < F.col("common"), "prompt").when(F.col("side") == 1, "chosen").otherwise("rejected")
    turn = F.struct("place", rendered(F.col("role"), F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"), F.length("role").alias("role"))
    grouped = rows.select("pair_id", "common", part.alias("part"), turn.alias("turn"))
    grouped = grouped.groupBy("pair_id", "common").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("part") == k, F.col("turn")))).alias(k) for k in ("prompt", "chosen", "rejected")]
    )
    texts = {k: F.array_join(F.transform(k, lambda t: t["text"]), "") for k in ("prompt", "chosen", "rejected")}
    return grouped.select(
        "pair_id",
        F.col("common").cast("long").alias("n_prompt_turns"),
        *[texts[k].alias(k) for k in texts],
        *[_mask(k).alias(f"{k}_mask") for k in ("chosen", "rejected")],
    )


def _mask(part: str) -> Column:
    """[start, length] of the assistant's text and end mark in a completion."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        head = F.lit(len(BEGIN) + 1) + turn["role"]
        size = F.length(turn["text"])
        span = F.array(F.array(state["at"] + head, size - head - 1))
        spans = F.when(turn["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return F.aggregate(part, start, add, lambda state: state["spans"])


def ablated(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from single conversations (pair_id, place, role, text).

    Chosen is a conversation up to its last assistant turn. Rejected says there what the assistant said
    first in it, or nothing, where there is one assistant turn only or both say the same. Conversations
    without an assistant turn give no pair.
    """
    said = turns.filter(F.col("role") == "assistant")
    ends = said.groupBy("pair_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    chosen = turns.join(ends, "pair_id").filter("place <= last").select("pair_id", "place", "role", "text")
    opening = said.join(ends, "pair_id").filter("place = first and first < last")
    opening = opening.select("pair_id", F.col("last").alias("place"), F.col("text").alias("again"))
    rows = turns.join(ends, "pair_id").filter("place <= last")
    rows = rows.join(opening, ["pair_id", "place"], "left")
    again = F.when(F.col("again") == F.col("text"), "").otherwise(F.coalesce("again", F.lit("")))
    text = F.when(F.col("place") == F.col("last"), again).otherwise(F.col("text"))
    return chosen, rows.select("pair_id", "place", "role", text.alias("text"))


def oracle() -> str:
    """`preferences` over `ablated` conversations in DuckDB's SQL, masks as text."""
    shown = f"'{BEGIN}' || role || chr(10) || text || '<|im_end|>' || chr(10)"
    head = f"{len(BEGIN) + 1} + length(role)"
    return f"""
    WITH t AS (
      SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place
      FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    ), ends AS (
      SELECT conv_id, min(place) AS first, max(place) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id
    ), c AS (
      SELECT t.*, last, first FROM t JOIN ends USING (conv_id) WHERE place <= last
    ), opening AS (
      SELECT conv_id, text AS again FROM c WHERE place = first AND first < last
    ), r AS (
      SELECT c.conv_id, c.place, c.role, c.last, CASE WHEN c.place < c.last THEN c.text
        WHEN o.again = c.text THEN '' ELSE coalesce(o.again, '') END AS text
      FROM c LEFT JOIN opening o USING (conv_id)
    ), common AS (
      SELECT c.conv_id, min(c.place) AS common FROM c JOIN r USING (conv_id, place) WHERE c.text <> r.text GROUP BY c.conv_id
    ), p AS (
      SELECT c.conv_id, string_agg({shown}, '' ORDER BY place) AS prompt
      FROM c JOIN common USING (conv_id) WHERE place < common GROUP BY c.conv_id
    )
    SELECT m.conv_id AS pair_id, m.common AS n_prompt_turns, coalesce(p.prompt, '') AS prompt,
      (SELECT {shown} FROM c WHERE c.conv_id = m.conv_id AND c.place = m.common) AS chosen,
      (SELECT {shown} FROM r WHERE r.conv_id = m.conv_id AND r.place = m.common) AS rejected,
      (SELECT '[[' || ({head}) || ',' || (length({shown}) - ({head}) - 1) || ']]' FROM c WHERE c.conv_id = m.conv_id AND c.place = m.common) AS chosen_mask,
      (SELECT '[[' || ({head}) || ',' || (length({shown}) - ({head}) - 1) || ']]' FROM r WHERE r.conv_id = m.conv_id AND r.place = m.common) AS rejected_mask
    FROM common m LEFT JOIN p ON p.conv_id = m.conv_id
    """
