"""Hard negatives by segment summaries: exact searches that score few rows.

A vector is cut into segments at several levels (1 segment, then 4, then 16 ...). Of each segment its mean and
its deviation (the length of what is left without the mean) are stored. For two vectors

    sum of size * mean * mean  -  sum of deviation * deviation  <=  score  <=  the same with +

holds at every level, and finer levels give closer bounds. A search starts at the coarsest level with all rows of
a block, drops the rows whose bounds rule them out, looks at the next level for the rest, and scores
exactly what is left after the last.

1. Rows are dealt by hash into blocks of about `block_rows`, one row of a table with the block's vectors and summaries.
   Anchors are dealt into groups in the same way.
2. Every group of anchors meets every block, by a join on the block's number: a stated query set against all rows, in
   blocks. Each meeting gives the best of its block for each anchor, and the best of those count.
3. First the positives are searched so (the best of the same label), then for each positive the best rows of other
   labels whose scores lie in its range.

All scores are sums of products of integers; they are exact as long as they fit 53 bits, which `LARGEST` sees to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.lineage import cut

#: Components (times 256) beyond this are an error: scores couldn't be told exactly.
LARGEST = 1 << 20
#: A missing id stands behind all others.
_NO_ID = np.int64(2**63 - 1)
_BLOCK = "dim int, block int, ids binary, labels binary, vectors binary, summaries array<binary>"


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part, equal rows once.

    Left out: null labels, null vectors, vectors with a null or non-finite component. Rows without vec_id take part as
    candidates. Rows that share an id but differ are rows of their own."""
    values = F.col("vector")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & finite)
    whole = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    checked = F.when(F.forall(values, lambda x: F.abs(x) <= float(LARGEST // scale)), whole)
    checked = F.when(values.isNull(), None).otherwise(F.coalesce(checked, F.raise_error(F.lit("component too large")).cast("array<bigint>")))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), checked.alias("vector")).distinct()


def _segments(dim: int) -> list[np.ndarray]:
    """Where the segments of each level begin; the last level has segments of four components."""
    levels, size = [], max(dim, 1)
    while size >= 4:
        levels.append(np.arange(0, dim, size))
        size //= 4
    return levels or [np.zeros(1 if dim else 0, np.int64)]


def summarised(vectors: np.ndarray) -> list[np.ndarray]:
    """For each level the means of the segments times the root of their sizes, then the deviations.

    With that factor the sum of size * mean * mean is an inner product."""
    found = []
    squares = vectors * vectors
    for begins in _segments(vectors.shape[1]):
        if not len(begins):
            found.append(np.zeros((len(vectors), 0)))
            continue
        sizes = np.diff(np.append(begins, vectors.shape[1]))
        total = np.add.reduceat(vectors, begins, axis=1)
        left = np.maximum(np.add.reduceat(squares, begins, axis=1) - total * total / sizes, 0)
        found.append(np.hstack([total / np.sqrt(sizes), np.sqrt(left)]))
    return found


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) if rows else np.zeros((0, 0))


def _packed(rows: DataFrame, number: Column) -> DataFrame:
    """One row per dimension and number: vectors as 32-bit integers, their summaries, ids and labels."""

    def pack(key, table):
        n = table.num_rows
        order = np.argsort(table.column("vec_id").fill_null(int(_NO_ID)).to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        vectors = _matrix(table.column("vector").combine_chunks(), n)
        ids = table.column("vec_id").fill_null(int(_NO_ID)).to_numpy().astype("<i8")
        columns = {
            "dim": pa.array([key[0].as_py()], pa.int32()),
            "block": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "labels": pa.array([table.column("label").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([vectors.astype("<i4").tobytes()], pa.binary()),
            "summaries": pa.array([[x.astype("<f8").tobytes() for x in summarised(vectors)]], pa.list_(pa.binary())),
        }
        return pa.table(columns)

    keyed = rows.withColumn("dim", F.size("vector")).withColumn("block", number)
    return keyed.groupBy("dim", "block").applyInArrow(pack, _BLOCK)


class Block:
    """The vectors of a packed row with what is needed to bound and score them."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, vectors: bytes, summaries: list[bytes]) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, "<i4").reshape(len(self.ids), dim).astype(float)
        self.levels = [np.frombuffer(x, "<f8").reshape(len(self.ids), -1) for x in summaries]

    def best(self, anchor: Block, at: int, rows: np.ndarray, ranges: list[tuple[float, float]], most: int) -> list[tuple]:
        """For each range of scores the `most` best of `rows` (score down, then id) with a score in it: (places, scores).

        A row is dropped for a range if its bounds miss the range or lie below `most` rows of which the
        bounds are certain to be in it; it is dropped for good once no range keeps it."""
        keep = [rows] * len(ranges)
        for own, mine in zip(self.levels, anchor.levels, strict=True):
            half = own.shape[1] // 2
            union = rows if all(k is rows for k in keep) else np.unique(np.concatenate(keep))
            if not len(union):
                break
            here = own[union]
            middle, spread = here[:, :half] @ mine[at, :half], here[:, half:] @ mine[at, half:]
            slack = 1e-6 + 1e-9 * (np.abs(middle) + spread)  # of the doubles above
            low, high = middle - spread - slack, middle + spread + slack
            for k, (least, greatest) in enumerate(ranges):
                part = np.searchsorted(union, keep[k])
                lower, upper = low[part], high[part]
                sure = lower[(lower >= least) & (upper <= greatest)]
                floor = np.partition(sure, -most)[-most] if len(sure) >= most else least
                keep[k] = keep[k][(upper >= max(least, floor)) & (lower <= greatest)]
        union = np.unique(np.concatenate(keep)) if keep else rows[:0]
        scores = self.vectors[union] @ anchor.vectors[at]
        found = []
        for part, (least, greatest) in zip(keep, ranges, strict=True):
            own = scores[np.searchsorted(union, part)]
            part, own = part[inside := (own >= least) & (own <= greatest)], own[inside]
            if len(own) > most:
                close = own >= np.partition(own, -most)[-most]
                part, own = part[close], own[close]
            order = np.lexsort((part, -own))[:most]  # rows of a block are in order of their ids
            found.append((part[order], own[order].astype(np.int64)))
        return found


def _same_row(block: Block, anchor: Block, at: int) -> np.ndarray:
    """The places of the anchor's own row in a block."""
    places = np.arange(*np.searchsorted(block.ids, [anchor.ids[at], anchor.ids[at] + 1]) if anchor.ids[at] != _NO_ID else (0, 0))
    same = (block.labels[places] == anchor.labels[at]) & (block.vectors[places] == anchor.vectors[at]).all(axis=1)
    return places[same]


def _meetings(index: DataFrame, groups: DataFrame, blocks: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every group of anchors beside every block of its dimension: each group is dealt to all blocks."""
    names = ["ids", "labels", "vectors", "summaries", *extra]
    dealt = groups.select("dim", F.col("block").alias("group"), *[F.col(k).alias(f"anchor_{k}") for k in names])
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return index.join(dealt, ["dim", "block"])


def _sides(row: dict) -> tuple[Block, Block]:
    own, anchor = ([row[f"{p}{k}"] for k in ("ids", "labels", "vectors", "summaries")] for p in ("", "anchor_"))
    return Block(row["dim"], *own), Block(row["dim"], *anchor)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _ids(column: np.ndarray) -> pa.Array:
    return pa.array(column, pa.int64(), mask=column == _NO_ID)


def _find_positives(most: int):
    names = ["dim", "anchor_block", "anchor_place", "vec_id", "score"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block, anchors = _sides(row)
            parts = []
            for at in range(len(anchors.ids)):
                rows = np.flatnonzero(block.labels == anchors.labels[at])
                rows = np.setdiff1d(rows, _same_row(block, anchors, at), assume_unique=True)
                ((places, scores),) = block.best(anchors, at, rows, [(-np.inf, np.inf)], most)
                parts.append((np.full(len(places), at), block.ids[places], scores))
            place, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            same = [np.full(len(place), row[k], np.int32) for k in ("dim", "group")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(place), _ids(ids), pa.array(scores)], names)

    return found


def _find_negatives(most: int, least: int, greatest: int):
    names = ["anchor_id", "anchor_block", "anchor_place", "positive_id", "positive", "negative_id", "positive_score", "negative_score"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block, anchors = _sides(row)
            parts: list[list] = [[] for _ in names]
            for at in range(len(anchors.ids)):
                positives = row["anchor_positives"][at]
                # Whole scores s with least * p <= 100 * s <= greatest * p, in whole numbers.
                ranges = [(-(-least * p["score"] // 100), greatest * p["score"] // 100) for p in positives]
                rows = np.flatnonzero(block.labels != anchors.labels[at])
                for k, (places, scores) in enumerate(block.best(anchors, at, rows, ranges, most)):
                    n, p = len(places), positives[k]
                    positive = _NO_ID if p["vec_id"] is None else p["vec_id"]
                    values = (anchors.ids[at], row["group"], at, positive, k, block.ids[places], p["score"], scores)
                    for part, value in zip(parts, values, strict=True):
                        part.append(np.broadcast_to(np.asarray(value, np.int64), n))
            columns = [np.concatenate([np.zeros(0, np.int64), *p]) for p in parts]
            yield pa.RecordBatch.from_arrays([_ids(c) if k.endswith("_id") else pa.array(c) for k, c in zip(names, columns, strict=True)], names)

    return found


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    greatest: int = 90,
    scale: int = 256,
    block_rows: int = 8192,
    group_rows: int = 512,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `vectors` has vec_id, embedding and label; `anchors` says over vec_id which rows are anchors, `label` gives another
    label over vec_id and label. Components become floor(scale * x). An anchor's positives are the best
    `positives` other rows of its label; for each, the best `negatives` rows of other labels are returned whose
    scores are from `least` to `greatest` percent of the positive's. Best: highest inner product, then smallest id.

    See `prepared` for rows that take no part and rows that repeat. Only vectors of the same length have a
    score. Anchors without positives, and positives without negatives, give no rows; an empty table gives none.
    """
    rows = prepared(vectors, scale)
    rows = cut(rows.withColumn("label", label) if label is not None else rows)
    chosen = rows.filter(anchors)
    blocks, groups = (max(1, -(-df.count() // size)) for df, size in ((rows, block_rows), (chosen, group_rows)))
    index = cut(_packed(rows, F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)).cast("int")))
    number = F.pmod(F.xxhash64("vec_id", "label", "vector", F.lit(1)), F.lit(groups)).cast("int")
    asked = cut(_packed(chosen, number))

    kind = "dim int, anchor_block int, anchor_place bigint, vec_id bigint, score bigint"
    near = _meetings(index, asked, blocks).mapInArrow(_find_positives(positives), kind)
    anchor = ["dim", "anchor_block", "anchor_place"]
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*anchor).orderBy(*order))).filter(F.col("_rank") <= positives)
    # The positives of a group's anchors, in the order of its rows.
    near = near.groupBy(*anchor).agg(F.array_sort(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("found"))
    near = near.groupBy("dim", F.col("anchor_block").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("anchor_place", "found"))).alias("_of"))
    size = (F.length("ids") / 8).cast("long")
    listed = F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda k: F.coalesce(F.try_element_at("_of", k), F.array().cast("array<struct<_rank:int,vec_id:bigint,score:bigint>>")))
    known = cut(asked.join(near, ["dim", "block"]).withColumn("positives", listed).drop("_of"))

    kind = "anchor_id bigint, anchor_block bigint, anchor_place bigint, positive_id bigint, positive bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    found = _meetings(index, known, blocks, ("positives",)).mapInArrow(_find_negatives(negatives, least, greatest), kind)
    each = Window.partitionBy("anchor_id", "anchor_block", "anchor_place", "positive").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The same by scoring every anchor against every row."""
    return """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
               CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
        FROM rows a JOIN rows r ON a.vec_id <> r.vec_id
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), ranked AS (
        SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
        WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """
