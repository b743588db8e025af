"""A training corpus in five stages: toxicity, line dedup, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm import jaccard_join, line_dedup, mixing, packing, queries, toxicity
from comarca.llm.lineage import shared_folder, written
from comarca.llm.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after what happened to the text."""
    length = F.length("text").cast("long").alias("n_chars")
    return df.select(*[length if c == "n_chars" else F.col(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, doesn't call toxic."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, tuple(COLUMNS)).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of lines go; documents of which nothing is left go too."""
    found = line_dedup.deduplicated(docs.select(*COLUMNS))
    return _documents(found.filter("n_removed = 0 or n_removed < n_lines"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the document
    with the smallest id stays. Of rows that repeat an id and text one stays (the smallest by its
    other columns); texts that share an id are documents of their own, ordered by hash. Rows without
    an id take no part and stay."""
    rows, once = _one_per_text(docs.select(*COLUMNS))
    text = F.xxhash64("text")
    # Only where an id has several texts do nodes need the text too: wider nodes cost disk.
    node = F.col("doc_id") if once else F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text.alias("row")))
    found = jaccard_join.linked(rows.select(node.alias("doc_id"), "text"), words=5, percent=80)
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    if once:
        return rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    gone = gone.select(F.col("doc_id.doc_id").alias("_doc"), F.col("doc_id.row").alias("_row"))
    return rows.join(gone, (F.col("doc_id") == F.col("_doc")) & (text == F.col("_row")), "left_anti").select(*COLUMNS)


def _one_per_text(rows: DataFrame) -> tuple[DataFrame, bool]:
    """`rows` with one row per doc_id and text, and whether no doc_id is left twice. Texts are shuffled
    only of ids that repeat."""
    twice = rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = written(twice, "repeated-ids")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    kept = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest"))
    kept = written(kept.select(*[F.col(f"rest.{c}") if c in others else F.col(c) for c in COLUMNS]), "one-per-text")
    once = kept.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return rows.join(twice, "doc_id", "left_anti").select(*COLUMNS).union(kept), once


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, filled until no document fits."""
    return mixing.repeated(mixing.mixed(docs.select(*COLUMNS), further=True), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most `queries.CAPACITY` tokens."""
    return packing.packed(docs, queries.byte_vocabulary(), queries.CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Tokenisers and classifiers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
