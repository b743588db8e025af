"""Similarity join of documents by n-gram Jaccard: rare-first prefixes, filters, one verification.

1. Shingles of each text are hashed in the task that reads it. Their frequencies go into a sketch
   of fixed size (2**`SKETCH_BITS` counters), which defines one global order: rarer first, ties by
   hash. Any total order gives right results; the sketch only makes prefixes selective.
2. Texts with equal shingle sets form one class, represented by its smallest id.
3. A class is posted under the shingles of its prefix, n - ceil(t n) + 1 of them: two classes over
   the threshold share one at least. Shingles posted once are dropped by a count.
4. Of each posting list, one hub (the class that has the shingle earliest) meets all others. Pairs
   that pass the length, positional and suffix filters are verified on the whole sets, once, and
   linked classes become components. Then the members of a list that lie in different components
   meet each other under the same filters. Pairs within a component need not be compared: they
   can't change it. So no group of copies is expanded into all its pairs, and no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.llm import textbytes
from comarca.llm.components import components
from comarca.llm.lineage import cut, written

SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Hash ranges whose counts bound an overlap in the suffix filter.
RANGES = 16
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, hashes) of each slice: the distinct shingles of each row, sorted."""
    for first, end, data, offsets in textbytes.text_slices(texts):
        data = textbytes.LOWER[data]
        starts, ends, rows = textbytes.words(data, offsets)
        if not len(starts):
            yield first, end, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        word = textbytes.Hasher(data).strong(starts, ends)
        number = np.bincount(rows, minlength=end - first)
        after = np.cumsum(number)[rows]  # index behind the row's last word
        place = np.arange(len(word))
        begins = (place + words <= after) | ((place == after - number[rows]) & (number[rows] < words))
        at = np.flatnonzero(begins)
        value = np.zeros(len(at), np.uint64)
        for k in range(words):
            there = at + k < after[at]
            value = textbytes.mix(value * _ODD[4] + np.where(there, word[np.minimum(at + k, len(word) - 1)], _ODD[k % 4]))
        rows = rows[at]
        order = np.lexsort((value, rows))
        value, rows = value[order], rows[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
        yield first, end, rows[keep], value[keep]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signatures(documents: DataFrame, words: int) -> DataFrame:
    """A row per text (doc_id, n and two checksums of its shingle set) and, per task, the rows of its
    part of the sketch (part, deflated counts: most are small)."""
    kind = dict(documents.dtypes)["doc_id"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "a", "b", "part", "counts"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            n = np.zeros(batch.num_rows, np.int64)
            a, b = np.zeros((2, batch.num_rows), np.uint64)
            for first, end, rows, value in shingle_sets(batch.column(1), words):
                n[first:end] = np.bincount(rows, minlength=end - first)
                np.add.at(a, first + rows, textbytes.mix(value ^ _ODD[0]))
                np.add.at(b, first + rows, textbytes.mix(value ^ _ODD[1]))
                sketch += np.bincount((value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _signed(a), _signed(b), *none], names)
        if id_type is not None:
            parts = sketch.reshape(SKETCH_PARTS, -1)
            nothing = [pa.nulls(SKETCH_PARTS, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            filled = [pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts])]
            yield pa.RecordBatch.from_arrays([*nothing, *filled], names)

    return documents.select("doc_id", "text").mapInArrow(
        signed, f"doc_id {kind}, n bigint, a bigint, b bigint, part int, counts binary"
    )


def _order(signatures: DataFrame) -> np.ndarray:
    """For each counter of the sketch a byte that grows with the logarithm of its count."""

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()])})

    parts = signatures.filter("part is not null").select("part", "counts")
    parts = parts.groupBy("part").applyInArrow(summed, "part int, counts binary").collect()  # of fixed size
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for row in parts:
        counts[row["part"]] = np.frombuffer(row["counts"], "<i8")
    return np.floor(4 * np.log2(counts.ravel() + 1.0)).astype(np.uint8)


def _prefixes(documents: DataFrame, words: int, percent: int, order) -> DataFrame:
    """doc_id, n, tokens (the prefix in global order) and ranges (shingles in each hash range)."""
    kind = dict(documents.dtypes)["doc_id"]

    def cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(order.value, np.uint8)
        for batch in batches:
            for first, end, rows, value in shingle_sets(batch.column(1), words):
                rank = level[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                token = (rank << np.uint64(55)) | (value & np.uint64((1 << 55) - 1))
                token = token[np.lexsort((token, rows))]
                n = np.bincount(rows, minlength=end - first)
                begin = np.cumsum(n) - n
                size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                upto = np.cumsum(size)
                place = np.repeat(begin - (upto - size), size) + np.arange(int(upto[-1]))
                tokens = pa.ListArray.from_arrays(np.append(0, upto).astype(np.int32), _signed(token[place]))
                ranges = np.bincount(rows * RANGES + (value & np.uint64(RANGES - 1)).astype(np.int64), minlength=(end - first) * RANGES)
                ranges = pa.ListArray.from_arrays(np.arange(0, len(ranges) + 1, RANGES, dtype=np.int32), pa.array(ranges.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n), tokens, ranges], ["doc_id", "n", "tokens", "ranges"]
                )

    return documents.select("doc_id", "text").mapInArrow(
        cut_off, f"doc_id {kind}, n bigint, tokens array<bigint>, ranges array<int>"
    )


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """cls, n and the whole shingle set of each text."""
    kind = dict(texts.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, rows, value in shingle_sets(batch.column(1), words):
                n = np.bincount(rows, minlength=end - first)
                sets = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), _signed(value))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), sets], ["cls", "n", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(whole, f"cls {kind}, n bigint, shingles array<bigint>")


def _may_link(percent: int, p: str, q: str) -> Column:
    """Length and positional filters for two entries of one posting list."""
    a, b, i, j = (F.col(f"{x}.{y}") for y in ("n", "pos") for x in (p, q))
    long_enough = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    still_possible = 1 + F.least(a - i - 1, b - j - 1)
    return long_enough & ((100 + percent) * still_possible >= percent * (a + b))


def _verified(pairs: DataFrame, ranges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (lo, hi) that link: suffix filter on the counts by hash range, then the whole sets.

    Sets are made only of the texts that a pair is left for."""
    for side in ("lo", "hi"):
        named = ranges.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("ranges").alias(f"r_{side}"))
        pairs = pairs.join(named, side)
    most = reduce(lambda x, y: x + y, [F.least(F.col("r_lo")[k], F.col("r_hi")[k]) for k in range(RANGES)])
    pairs = pairs.filter((100 + percent) * most >= percent * (F.col("n_lo") + F.col("n_hi")))
    pairs = cut(pairs.select("lo", "hi").distinct())
    asked = written(pairs.select(F.explode(F.array("lo", "hi")).alias("doc_id")).distinct(), "asked")
    sets = _sets(texts.join(asked, "doc_id", "left_semi"), words)
    for side in ("lo", "hi"):
        named = sets.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}"))
        pairs = pairs.join(named, side)
    both = F.size(F.array_intersect("s_lo", "s_hi"))
    return pairs.filter((100 + percent) * both >= percent * (F.col("n_lo") + F.col("n_hi"))).select("lo", "hi")


def _pair(p: str, q: str) -> list[Column]:
    return [F.least(f"{p}.cls", f"{q}.cls").alias("lo"), F.greatest(f"{p}.cls", f"{q}.cls").alias("hi")]


def linked(documents: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `documents` (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased; the set of a text is its distinct
    shingles of `words` words, or its whole sequence where it is shorter. Texts link when
    100 * intersection >= percent * union. A text without words (or null) has an empty set and
    links with nothing. Rows that repeat a doc_id are one node with the links of all its texts.
    Rows without doc_id come back with a null component and take no part. An empty table gives
    no rows; further columns are ignored.
    """
    spark = documents.sparkSession
    signatures = cut(_signatures(documents, words))
    order = spark.sparkContext.broadcast(_order(signatures).tobytes())  # 2**SKETCH_BITS bytes
    texts = signatures.filter("part is null").select("doc_id", "n", "a", "b")
    known = texts.filter("doc_id is not null")
    same = known.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("cls"))
    members = cut(known.join(same, ["n", "a", "b"], "left").select("doc_id", "n", F.coalesce("cls", "doc_id").alias("cls")))
    heads = members.filter("doc_id = cls and n > 0").select("doc_id").distinct()
    ids = documents.filter("doc_id is not null")
    prefixes = cut(_prefixes(ids, words, percent, order).join(heads, "doc_id", "left_semi"))

    # Entries travel as three numbers; what is posted once goes before anything is added to the rest.
    at = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at")
    entries = prefixes.select(F.col("doc_id").alias("cls"), "n", F.posexplode("tokens").alias("pos", "token"))
    entries = entries.select("token", "cls", at)
    shared = entries.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    n, pos = F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")
    posted = cut(entries.join(shared, "token").select("token", "cls", n, pos))
    early = F.shiftleft("pos", 40).bitwiseOR(F.xxhash64("cls").bitwiseAND(F.lit((1 << 40) - 1)))
    lists = posted.groupBy("token").agg(F.min(early).alias("hub"))

    hubs = posted.join(lists, "token").filter(F.col("hub") == early).drop("hub").alias("h")
    met = posted.alias("x").join(hubs, F.col("x.token") == F.col("h.token"))
    met = met.filter((F.col("x.cls") != F.col("h.cls")) & _may_link(percent, "x", "h")).select(_pair("x", "h")).distinct()
    met = cut(met)
    links = cut(_verified(met, prefixes, ids, words, percent))
    found = components(links, "lo", "hi")

    labelled = posted.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "cls"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    open_ = cut(labelled.join(mixed.select("token"), "token", "left_semi").select("token", "cls", "n", "pos", "component"))
    rest = open_.alias("x").join(open_.alias("y"), F.col("x.token") == F.col("y.token"))
    rest = rest.filter((F.col("x.component") < F.col("y.component")) & _may_link(percent, "x", "y"))
    rest = rest.select(_pair("x", "y")).distinct().join(met, ["lo", "hi"], "left_anti")
    more = _verified(rest, prefixes, ids, words, percent)

    # Rows that repeat a doc_id with different texts tie their classes together.
    twice = members.select("doc_id", "cls").distinct()
    least = twice.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("top")).filter("lo < top")
    tied = twice.join(least, "doc_id").filter("cls > lo").select("lo", F.col("cls").alias("hi"))
    final = components(found.select("node", "component").union(more).union(tied), "node", "component")
    result = members.join(final.withColumnRenamed("node", "cls"), "cls", "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("component_id"))
    without = texts.filter("doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return result.union(without)
