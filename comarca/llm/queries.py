"""One query per operator over the whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm import chat, hard_negatives, line_dedup, mixing
from comarca.llm.lineage import cut, shared_folder
from comarca.llm.tables import table

CAPACITY = 2048


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary():
    import public_tokenizers

    from comarca.llm.packing import Vocabulary

    path = public_tokenizers.path
    return Vocabulary(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def remainder(parts: int):
    """crc32 of doc_id as text, modulo `parts`; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from rows whose remainder is known and not 2; a null id is not held out."""
    from comarca.llm.language import fit, identified

    documents = table(spark, folder, "documents")
    model = fit(documents.filter(remainder(4) != 2), piece_model())
    found = identified(documents, model)
    return found.withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.line_dedup import deduplicated

    found = deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), piece_model())


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.packing import packed

    return packed(table(spark, folder, "documents"), byte_vocabulary(), CAPACITY)


def op5_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.permutation_index import neighbours

    vectors = table(spark, folder, "embeddings")
    return neighbours(vectors, F.col("vec_id") % 20 == 0, nearest=20)


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.mixing import mixed

    found = mixed(table(spark, folder, "documents"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken)


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.quality import judged

    return judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation against itself with its last assistant turn replaced. Masks as text."""
    from comarca.llm.chat import ablated, placed, preferences

    turns = cut(placed(table(spark, folder, "conversations").withColumnRenamed("conv_id", "pair_id")))
    found = preferences(*ablated(turns))
    return found.withColumns({k: F.to_json(k) for k in ("chosen_mask", "rejected_mask")})


def toxicity_model(documents: DataFrame, labels: DataFrame):
    """Learns from labelled rows whose remainder is known and not 0."""
    from comarca.llm.toxicity import fit, training_rows

    return fit(training_rows(documents, labels.filter(remainder(5) != 0)))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A null id is not held out."""
    from comarca.llm.toxicity import scored

    documents = table(spark, folder, "documents")
    model = toxicity_model(documents, table(spark, folder, "labels"))
    return scored(documents, model).withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.jaccard_join import linked

    return linked(table(spark, folder, "documents"), words=3, percent=90)


def op11_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of all documents written to files of the shared folder and read back."""
    from comarca.llm.id_files import read_ids, with_starts, write_ids

    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, folder, "documents"), byte_vocabulary(), path)
    found = read_ids(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_starts(cut(found)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from comarca.llm.alignment import alignments

    return alignments(table(spark, folder, "documents"), byte_vocabulary(), piece_model())[0]


REGISTRY = {
    "op1_language": op1_language,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_permutation_index": op5_permutation_index,
    "op6_source_mix": op6_source_mix,
    "op7_quality_rules": op7_quality_rules,
    "op8_preference_format": op8_preference_format,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_id_files": op11_id_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_alignment": op13_alignment,
}
SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.oracle(),
    "op6_source_mix": mixing.oracle(),
    "op8_preference_format": chat.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
}
