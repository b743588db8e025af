"""Mixing sources to target weights by capped water-filling.

Each source's share of all words follows its weight, but stops at `most` times its own size; the
excess goes to the others by weight until none is above. With sources ordered by cap over
weight, the clamped ones come first, and the level of the rest is what is left over their
weights: prefix sums over one row per source.

A document is repeated whole as often as its source is, and the fraction left is made up of whole
documents too: in a seeded order of the source, those up to the point where the fraction's words
are reached, and one more, the largest document that still fits. What decides is one row per
source, so texts are neither shuffled nor sorted.

`further` fills instead of closing with one document: all later documents are looked at in the
seeded order, and each that still fits is taken. A round takes those up to the first one too large
for what is left; the next goes on behind with documents no larger than that, until none fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.lineage import cut, written
from comarca.llm.tables import apart

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source's seeded order. The part in which a fraction ends is looked at row by row.
PARTS = 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order(seed: int) -> Column:
    """Place of a document in the seeded order of its source: 60 bits of a checksum of its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _present(column: Column) -> list[Column]:
    """Keys that join null with null."""
    return [F.coalesce(column, F.lit("")).alias("_source"), column.isNull().alias("_none")]


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """_source, _none, source_size, target: one row per source of `sizes` (source, size).

    Sources are ordered by code point, null last; `weights` repeat along that order. The windows
    hold one row per source."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    rows = rows.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    rows = (
        rows.withColumn("k", F.row_number().over(by_ratio))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    )
    holds = F.col("level") <= F.col("cap") / F.col("w")
    level = F.min(F.when(holds, F.struct("k", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return rows.select(*_present(F.col("source")), "source_size", target.alias("target"))


def _prefix(keyed: DataFrame, goal: DataFrame) -> DataFrame:
    """`goal` (need) with upto, have and next: the last place in the seeded order up to which the rows of
    `keyed` (size, place) stay within the need, -1 if none, their words, and the first place there is."""
    key = ["_source", "_none"]
    names = goal.columns
    part = F.shiftright("place", 48)
    parts = keyed.groupBy(*key, part.alias("part")).agg(F.sum("size").alias("size"), F.max("place").alias("last"), F.min("place").alias("next"))
    along = Window.partitionBy(*key).orderBy("part")
    parts = parts.withColumn("upto", F.sum("size").over(along)).join(goal.select(*key, "need"), key)
    # Parts wholly within the need, and the one after them.
    full = F.col("upto") <= F.col("need")
    ends = parts.groupBy(*key).agg(
        F.max(F.when(full, F.col("upto"))).alias("have"),
        F.max(F.when(full, F.col("last"))).alias("last"),
        F.min(F.when(~full, F.col("part"))).alias("part"),
        F.min("next").alias("next"),
    )
    goal = written(goal.join(ends, key, "left"), "mix-parts")
    inner = keyed.withColumn("part", part).join(goal.select(*key, "part", "need", "have"), [*key, "part"])
    reached = F.coalesce("have", F.lit(0)) + F.sum("size").over(
        Window.partitionBy(*key).orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    )
    inner = inner.withColumn("reached", reached).filter("reached <= need")
    inner = inner.groupBy(*key).agg(F.max("place").alias("inner"), F.max("reached").alias("inner_have"))
    return goal.join(inner, key, "left").select(
        *names,
        F.coalesce("inner", "last", F.lit(-1)).alias("upto"),
        F.coalesce("inner_have", "have", F.lit(0)).alias("have"),
        "next",
    )


def _rounds(keyed: DataFrame, goal: DataFrame) -> DataFrame:
    """`goal` with rounds: (after, upto, most), the places in the seeded order in which documents of
    at most `most` words are taken once more."""
    key = ["_source", "_none"]
    names = [*key, "source_size", "target", "whole", "upto"]
    none = F.array().cast("array<struct<after:bigint,upto:bigint,most:double>>")
    goal = goal.select(*names, (F.col("need") - F.col("have")).alias("need"), F.col("upto").alias("after"), none.alias("rounds"))
    goal = goal.withColumnRenamed("upto", "first_upto")
    while True:
        left = keyed.join(goal.select(*key, "need", "after"), key)
        left = left.filter((F.col("place") > F.col("after")) & (F.col("size") > 0) & (F.col("size") <= F.col("need")))
        left = left.select(*keyed.columns)
        found = _prefix(left, goal)
        taken = F.struct("after", "upto", F.col("need").alias("most"))
        # Rows that share a place may be too large only together; then the next round passes them over.
        goal = written(
            found.select(
                *[c for c in goal.columns if c not in ("need", "after", "rounds")],
                (F.col("need") - F.col("have")).alias("need"),
                F.when(F.col("have") > 0, F.col("upto")).otherwise(F.coalesce("next", "after")).alias("after"),
                F.when(F.col("have") > 0, F.concat("rounds", F.array(taken))).otherwise(F.col("rounds")).alias("rounds"),
                F.col("next").isNotNull().alias("open"),
            ),
            "mix-round",
        )
        if goal.filter("open").isEmpty():
            break
        goal = goal.drop("open")
    return goal.withColumnRenamed("first_upto", "upto").select(*names, "rounds")


def decisions(sizes: DataFrame, weights: tuple[int, ...], most: int, further: bool = False) -> DataFrame:
    """One row per source: source_size, target, whole (times every document is taken), upto (the last
    place in the seeded order that is taken once more) and closing (a further such place), or with
    `further` instead of closing the rounds that fill what is left.

    `sizes` has source, size and place, a row per document."""
    keyed = sizes.select(*_present(F.col("source")), "size", "place")
    key = ["_source", "_none"]
    goal = targets(sizes, weights, most)
    goal = goal.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    goal = goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = written(_prefix(keyed, written(goal, "mix-goal")).drop("next"), "mix-upto")
    if further:
        return _rounds(keyed, goal)
    left = keyed.join(goal, key).filter((F.col("place") > F.col("upto")) & (F.col("size") > 0) & (F.col("have") + F.col("size") <= F.col("need")))
    closing = left.groupBy(*key).agg(F.max(F.struct("size", (-F.col("place")).alias("place"))).alias("best"))
    closing = closing.select(*key, (-F.col("best.place")).alias("closing"))
    return written(goal.join(closing, key, "left").select(*key, "source_size", "target", "whole", "upto", "closing"), "mix")


def mixed(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, further: bool = False
) -> DataFrame:
    """`documents` (doc_id, source, text and any others) with size, source_size, target and copies.

    `copies` says how often the mix takes the document, 0 to `most`. A null text has size 0; null is
    a source like others, ordered last. Rows that repeat a doc_id share a place in the order and are
    taken alike; with `further`, rows of one doc_id may differ if their sizes do. A source without words has target 0. Empty tables give no rows. Columns of these
    names in the input are replaced, others are carried along.
    """
    own = ("size", "source_size", "target", "copies")
    rows, at = apart(documents, ("doc_id", "source", "text"), own)
    sizes = cut(documents.select(F.col("source").cast("string").alias("source"), words().alias("size"), order(seed).alias("place")))
    goal = decisions(sizes, weights, most, further).withColumnsRenamed({"_source": "_s", "_none": "_n"})
    source = F.col("source").cast("string")
    same = (F.coalesce(source, F.lit("")) == F.col("_s")) & (source.isNull() == F.col("_n"))
    found = rows.join(goal.withColumnsRenamed({"source_size": "_size", "target": "_target"}), same)
    found = found.withColumn("_words", words()).withColumn("_place", order(seed))
    place = F.col("_place")
    if further:
        fits = lambda x: (place > x["after"]) & (place <= x["upto"]) & (F.col("_words") <= x["most"])
        closing = (F.col("_words") > 0) & F.exists("rounds", fits)
    else:
        closing = F.coalesce(place == F.col("closing"), F.lit(False))
    extra = (place <= F.col("upto")) | closing
    return found.select(
        *at.values(),
        F.col("_words").alias("size"),
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.least(F.col("whole") + extra.cast("long"), F.lit(most)).cast("int").alias("copies"),
    )


def repeated(mix: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a mix as often as it is taken."""
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")
    return mix.filter("copies > 0").select(*columns, times).drop("_copy")


def oracle(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> str:
    """doc_id, size, source_size, target and taken in DuckDB's SQL."""
    cycle = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    return rf"""
    WITH docs AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
      FROM documents
    ), sums AS (
      SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
    ), weighted AS (
      SELECT *, ([{cycle}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS w,
        source_size * {most} AS cap FROM sums
    ), ranked AS (
      SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM weighted WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
    ), levels AS (
      SELECT *, (total - before)::DOUBLE / rest AS level FROM ranked
    ), chosen AS (
      SELECT level FROM levels WHERE level <= cap / w ORDER BY k LIMIT 1
    ), goals AS (
      SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM chosen), 'inf'::DOUBLE) * w) AS target FROM levels
    ), wholes AS (
      SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM goals
    ), needs AS (
      SELECT *, target - whole * source_size AS need FROM wholes
    ), along AS (
      SELECT d.*, n.source_size, n.target, n.whole, n.need,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM docs d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
    ), had AS (
      SELECT source, coalesce(max(upto) FILTER (upto <= need), 0) AS have FROM along GROUP BY source
    ), closing AS (
      SELECT a.source, a.place, row_number() OVER (PARTITION BY a.source ORDER BY a.size DESC, a.place) AS nth
      FROM along a JOIN had h ON a.source IS NOT DISTINCT FROM h.source
      WHERE a.upto > a.need AND a.size > 0 AND h.have + a.size <= a.need
    )
    SELECT a.doc_id, a.size, a.source_size, a.target,
      (a.size * (a.whole + CASE WHEN a.upto <= a.need OR c.place IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM along a LEFT JOIN (SELECT * FROM closing WHERE nth = 1) c ON a.source IS NOT DISTINCT FROM c.source AND a.place = c.place
    """
