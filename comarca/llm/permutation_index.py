"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which pivots are near to it. The index is a table of blocks of rows. A block
has a posting list for each pivot, with the rows that count it among their `posted` nearest, and for each pivot
the places that it has in the orders of all rows.

1. Pivots: `pivots` distinct vectors of each length, drawn by hash. Every vector is indexed.
2. Groups of queries meet the blocks. A query reads the posting lists of its `read` nearest pivots. Rows in none of them
   are not looked at any further.
3. Rows found are ranked by the footrule distance, the sum of differences of places, over the query's `footrule`
   nearest pivots; the nearest by it, `examined` of the block's rows, are scored exactly. The best of a block go on, the
   best of those count.

Blocks bound everything: a pivot that is near to a third of all rows has its list split over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.lineage import cut, written

#: Parts in which the smallest hashes are looked for before those of all parts are compared.
_SALTS = 64


def usable(vectors: DataFrame, queries: DataFrame | Column, key: str, vector: str) -> DataFrame:
    """vec_id, vector (doubles), dim (its length), asked of what can be searched.

    Left out: null ids, null, empty or zero vectors, vectors with null or non-finite components. Equal rows count
    once; rows that share an id but differ are rows of their own."""
    asked = queries if isinstance(queries, Column) else F.lit(False)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id", "vector").agg(F.max("asked").alias("asked"))
    if isinstance(queries, DataFrame):
        ids = queries.select(F.col(key).alias("vec_id")).filter("vec_id is not null").distinct().withColumn("_in", F.lit(True))
        rows = rows.join(ids, "vec_id", "left").select("vec_id", "vector", F.coalesce("_in", F.lit(False)).alias("asked"))
    return rows.withColumn("dim", F.size("vector"))


def drawn_pivots(rows: DataFrame, pivots: int) -> DataFrame:
    """dim, pivots: of each length at most `pivots` distinct vectors, those with the smallest hashes."""
    hashed = rows.select("dim", F.xxhash64("vector").alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(_SALTS)))
    for part in (["dim", "salt"], ["dim"]):
        hashed = hashed.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy("h"))).filter(F.col("_at") <= pivots).drop("_at")
    smallest = written(hashed.select("dim", "h"), "pivot-hashes")
    found = rows.withColumn("h", F.xxhash64("vector")).join(smallest, ["dim", "h"]).groupBy("dim", "h").agg(F.min("vector").alias("vector"))
    listed = F.array_sort(F.collect_list(F.struct("h", "vector")))
    return found.groupBy("dim").agg(F.transform(listed, lambda x: x["vector"]).alias("pivots"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _sorted(table: pa.Table, pivots: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids in order, their vectors, and for each vector the pivots from the nearest on."""
    table = table.take(pc.sort_indices(table.column("vec_id")))
    vectors = _matrix(table.column("vector"), table.num_rows)
    points = np.array(pivots.column("pivots")[0].as_py(), float)
    return table.column("vec_id").combine_chunks(), vectors, np.argsort(-(vectors @ points.T), axis=1, kind="stable")


def _places(order: np.ndarray) -> np.ndarray:
    """The place of each pivot in each row's order, one byte each."""
    places = np.empty(order.shape, np.uint8)
    np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return places


def _lists(order: np.ndarray, pivots: int, posted: int) -> tuple[np.ndarray, np.ndarray]:
    """The posting lists one after the other, and where each begins: rows under each of their `posted` nearest pivots."""
    near = order[:, :posted]
    under = near.ravel()
    rows = np.repeat(np.arange(len(order), dtype="<i4"), near.shape[1])[np.argsort(under, kind="stable")]
    return rows, np.concatenate([[0], np.cumsum(np.bincount(under, minlength=pivots))]).astype("<i4")


def _packed(rows: DataFrame, pivots: DataFrame, parts: str, kind: str, columns: str, contents) -> DataFrame:
    """One row per dim and block: ids, vectors (doubles) and the `columns` that `contents` makes of the orders of pivots."""
    names = ["dim", "block", "ids", "vectors", *(c.split()[0] for c in columns.split(", "))]

    def pack(key, table: pa.Table, points: pa.Table) -> pa.Table:
        values: list[list] = [[] for _ in names]
        if table.num_rows:
            ids, vectors, order = _sorted(table, points)
            found = [key[0].as_py(), key[1].as_py(), ids, vectors.astype("<f8").tobytes(), *(x.tobytes() for x in contents(order))]
            values = [[x] for x in found]
        types = [pa.int32(), pa.int32(), pa.list_(table.schema.field("vec_id").type), *[pa.binary()] * (len(names) - 3)]
        return pa.table([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    every = pivots.select("dim", "pivots", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("block"))
    block = F.pmod(F.xxhash64("vec_id", "vector", F.lit(parts)), F.col(parts)).cast("int")
    rows = rows.select("dim", block.alias("block"), "vec_id", "vector")
    kind = f"dim int, block int, ids array<{kind}>, vectors binary, {columns}"
    return rows.groupBy("dim", "block").cogroup(every.groupBy("dim", "block")).applyInArrow(pack, kind)


class Block:
    """The posting lists, places and vectors of a packed row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> None:
        self.ids, self.vectors, self.places, self.rows, self.starts = ids, vectors, places, rows, starts

    def candidates(self, near: np.ndarray, read: int, least: int) -> np.ndarray:
        """Rows in the lists of the `read` nearest pivots; further lists where those have fewer than `least`."""
        found = np.zeros(len(self.ids), bool)
        for at, pivot in enumerate(near):
            if at >= read and np.count_nonzero(found) >= least:
                break
            found[self.rows[self.starts[pivot] : self.starts[pivot + 1]]] = True
        rows = np.flatnonzero(found)
        return rows if len(rows) >= least else np.arange(len(self.ids))

    def ranked(self, rows: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """The `most` rows nearest by footrule over the pivots `near`, and all others as near as the last."""
        if len(rows) <= most:
            return rows
        distance = np.zeros(len(rows), np.int16 if len(near) <= 128 else np.int32)
        for place, pivot in enumerate(near):
            distance += np.abs(self.places[pivot, rows].astype(np.int16) - np.int16(place))
        return rows[distance <= np.partition(distance, most - 1)[most - 1]]

    def best(self, rows: np.ndarray, own, vector: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of `rows` by inner product, without the query's own; their places and scores."""
        same = np.arange(np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right"))
        same = same[(self.vectors[same] == vector).all(axis=1)]
        rows = rows[~np.isin(rows, same)] if len(same) else rows
        scores = self.vectors[rows] @ vector
        if len(scores) > nearest:
            floor = np.partition(scores, -nearest)[-nearest]
            rows = rows[scores >= floor - 1e-9 * (1 + abs(floor))]
        # Summed row by row alike, so that equal vectors have equal scores.
        scores = (self.vectors[rows] * vector).sum(axis=1)
        order = np.lexsort((rows, -scores))[:nearest]  # rows are in order of their ids
        return rows[order], scores[order]


def _search(nearest: int, read: int, footrule: int, examined: float):
    """Searches blocks for the queries of the groups beside them."""
    names = ["dim", "group", "at", "query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                dim, ids, asked = row["dim"].as_py(), row["ids"].values, row["asked_ids"].values
                raw = {n: np.frombuffer(row[n].as_buffer(), t) for n, t in _TYPES.items()}
                n, m = len(ids), len(asked)
                block = Block(ids.to_numpy(zero_copy_only=False), raw["vectors"].reshape(n, dim), raw["places"].reshape(-1, n), raw["rows"], raw["starts"])
                vectors, near = raw["asked_vectors"].reshape(m, dim), raw["asked_near"].reshape(m, -1)
                least = min(n, nearest + 1)
                most = max(2 * nearest, int(np.ceil(examined * n)))
                found = []
                for at, own in enumerate(asked.to_numpy(zero_copy_only=False)):
                    rows = block.ranked(block.candidates(near[at], read, least), near[at, :footrule], most)
                    found.append(block.best(rows, own, vectors[at], nearest))
                ats = np.repeat(np.arange(m, dtype=np.int32), [len(rows) for rows, _ in found])
                places, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                same = [pa.array(np.full(len(ats), row[x].as_py(), np.int32)) for x in ("dim", "group")]
                columns = [*same, pa.array(ats), asked.take(pa.array(ats)), ids.take(pa.array(places)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return search


_TYPES = {"vectors": "<f8", "places": "u1", "rows": "<i4", "starts": "<i4", "asked_vectors": "<f8", "asked_near": "u1"}


def neighbours(
    vectors: DataFrame,
    queries: DataFrame | Column,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = 20,
    pivots: int = 256,
    posted: int = 16,
    read: int = 16,
    footrule: int = 32,
    examined: float = 0.25,
    block_values: int = 1 << 19,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product): the `nearest` found for each query.

    `queries` holds ids out of `vectors`, or is a condition over the columns of `vectors`. A query's own row is no
    candidate; only vectors of its length are. Ties go to the smaller id. See `usable` for what takes no part; ids that it
    leaves out are not answered. Where fewer candidates exist all are returned. Empty tables give no rows. At most 256
    pivots of a length (places are bytes). Blocks have about `block_values` components, and 256 rows at least.
    """
    if pivots > 256:
        raise ValueError("places of pivots are bytes: 256 pivots at most")
    rows = cut(usable(vectors, queries, key, vector))
    kind = dict(rows.dtypes)["vec_id"]
    per_block = F.greatest(F.lit(256.0), F.lit(float(block_values)) / F.col("dim"))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("m"))
    counts = counts.select("dim", *[F.greatest(F.lit(1), F.ceil(F.col(c) / (per_block / s))).cast("int").alias(a) for c, s, a in (("n", 1, "blocks"), ("m", 8, "groups"))])
    sizes = written(counts, "vector-lengths")
    points = written(drawn_pivots(rows, pivots).join(sizes, "dim"), "pivots")
    dealt = rows.join(sizes, "dim")

    def posting(order: np.ndarray) -> tuple[np.ndarray, ...]:
        return np.ascontiguousarray(_places(order).T), *_lists(order, order.shape[1], posted)

    index = cut(_packed(dealt, points, "blocks", kind, "places binary, rows binary, starts binary", posting))
    asked = _packed(dealt.filter("asked"), points, "groups", kind, "near binary", lambda order: (order.astype(np.uint8),))
    asked = asked.join(sizes, "dim").select(
        "dim", F.col("block").alias("group"), *[F.col(c).alias(f"asked_{c}") for c in ("ids", "vectors", "near")], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    found = index.join(asked, ["dim", "block"])
    found = found.mapInArrow(_search(nearest, read, footrule, examined), f"dim int, group int, at int, query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("dim", "group", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
