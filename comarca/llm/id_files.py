"""Token ids of documents written to binary files in document order and read back.

1. Documents are dealt by ranges of their id (rows that share an id by the hash of their text, then by the
   task that read them), sorted, tokenised, and coded in groups of whole documents (`id_coder`).
2. Each task writes its groups one after the other to files of its own. Spark's text writer puts the bytes
   down as they are, one group a row, with the commit and retry rules of any Spark output, to any
   store that Spark writes to.
3. Files are read whole, decoded and checked. Where a document's ids start among all ids follows from
   sums over files, taken in two steps, with one row a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.llm.id_coder import BLOCK_IDS, END, decode_groups, encode_group
from comarca.llm.packing import Vocabulary, token_ids

#: Groups of a file at most, and files that one window adds up.
GROUPS_A_FILE = 32
FILES_A_SUM = 1024


def in_order(documents: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id order over all partitions (null ids first; then by text)."""
    keys = [F.col("doc_id"), F.xxhash64("text"), F.spark_partition_id()]
    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*keys)
    return dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")


def encoded(ordered: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """payload: groups of whole documents, each with the end id 0 behind its ids, in the order of the rows.

    A group is closed once it has `BLOCK_IDS` ids, so it is bounded by the longest document, and before a
    document that would only add a block: a block of few ids takes about a third of a full one's time."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def blocks(ids: int) -> int:
            return -(-ids // BLOCK_IDS)

        def group() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_group(names, parts)], pa.binary())], ["payload"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1), vocabulary), strict=True):
                more = len(ids) + 1
                if size and blocks(size) + blocks(more) <= blocks(size + more):
                    yield group()
                    names, parts, size = [], [], 0
                names.append(name)
                parts.append(np.append(ids, np.zeros(1, "<u4")))
                size += more
                if size >= BLOCK_IDS:
                    yield group()
                    names, parts, size = [], [], 0
        if names:
            yield group()

    return ordered.select("doc_id", "text").mapInArrow(coded, "payload binary")


def write_ids(documents: DataFrame, vocabulary: Vocabulary, path: str) -> None:
    """Writes the ids of all rows of `documents` (doc_id, text; a null text is empty) to files under `path`.

    Repeated rows and rows without doc_id are documents like any other; further columns are ignored."""
    groups = encoded(in_order(documents), vocabulary)
    # The bytes pass the writer unread: a group is one "line", and `END` is what ends lines.
    lines = groups.select(F.col("payload").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", GROUPS_A_FILE).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """file, place, doc_id, n_tokens, ids (little-endian unsigned 32 bit): one row per document.

    `file` names the file and `place` is the place of the first id in it; file names sort as they were
    written. Anything that differs from what was written is an error. A folder without files gives no rows."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                place = 0
                for names, sizes, ids in decode_groups(batch.column(1)[row].as_py()):
                    ends = np.cumsum(sizes)
                    offsets = pa.py_buffer(np.append(0, 4 * ends).astype(np.int64))
                    raw = pa.Array.from_buffers(pa.large_binary(), len(names), [None, offsets, pa.py_buffer(ids.tobytes())])
                    of_file = pa.array([batch.column(0)[row].as_py()] * len(names))
                    columns = [of_file, pa.array(place + ends - sizes), pa.array(names, pa.int64()), pa.array(sizes), raw.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "place", "doc_id", "n_tokens", "ids"])
                    place += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "content").mapInArrow(
        decoded, "file string, place bigint, doc_id bigint, n_tokens bigint, ids binary"
    )


def with_starts(rows: DataFrame) -> DataFrame:
    """`rows` (file, place, n_tokens, ...) with `start`: the ids before the document in all files.

    Files are added up in runs of `FILES_A_SUM`, and the runs among themselves."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    # part-NNNNN-...-cNNN.txt: the task, and which of its files.
    part, number = (F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)-", r"-c(\d+)\.txt$"))
    files = files.select("file", "_n", part.alias("_part"), number.alias("_number"), (part / FILES_A_SUM).cast("long").alias("_run"))
    runs = files.groupBy("_run").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_run", before.alias("_runs_before"))
    window = Window.partitionBy("_run").orderBy("_part", "_number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0))).join(runs, "_run")
    files = files.select("file", (F.col("_before") + F.col("_runs_before")).alias("_start"))
    return rows.join(files, "file").withColumn("start", F.col("_start") + F.col("place")).drop("_start")
