"""JSON documents: an envelope of metadata around one or two arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.text import aliased, fill_in
from comarca.operators.lookups import last_by_key

MASTER_FIELDS = "state_code string, cve_ent string, estado string, aliases array<string>, region string, capital string"
CATEGORY_FIELDS = "categoria_id string, nombre string, descripcion string"
VARIABLE_FIELDS = (
    "variable_id string, categoria_id string, nombre string, descripcion string, unidad_base string, "
    "tipo_valor string, agregacion_default string, fuente_sugerida string, sinonimos array<string>"
)
METRIC_FIELDS = (
    "variable_id string, categoria_id string, label string, unidad string, source_table string, anio int"
)
LONG_FIELDS = (
    "state_code string, cve_ent string, estado string, categoria string, variable string, "
    "valor double, anio int, fuente string, unidad string"
)
WIDE_FIELDS = (
    "state_code string, cve_ent string, estado string, region string, anio int, metrics map<string,double>"
)
_HEAD = "updated_at string, schema_version string, dataset_id string, source string"


def read_envelope(spark: SparkSession, path: str, arrays: dict[str, str], head: str = _HEAD) -> DataFrame:
    """One row per document; a document is parsed by one task, so large data belongs in JSON lines."""
    fields = ", ".join(f"{name} array<struct<{_struct(fields)}>>" for name, fields in arrays.items())
    return spark.read.schema(f"{head}, {fields}").option("multiLine", True).json(path)


def _struct(fields: str) -> str:
    return ", ".join(":".join(field.strip().split(" ", 1)) for field in _split(fields))


def _split(fields: str) -> list[str]:
    parts, depth = [""], 0
    for char in fields:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts


def unfold(document: DataFrame, array: str, position: str | None = None) -> DataFrame:
    """One row per array item, optionally with its place in the array."""
    items = document.select(F.posexplode(array).alias("_position", "_item"))
    place = [F.col("_position").alias(position)] if position else []
    return items.select("_item.*", *place)


def read_entity_master(spark: SparkSession, path: str) -> DataFrame:
    """Entities by code; of a repeated code the last one stays."""
    states = read_envelope(spark, path, {"states": MASTER_FIELDS}, "updated_at string, country string")
    return last_by_key(unfold(states, "states", "_place"), "cve_ent", "_place")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Categories and variables, each with its place in the document (``posicion``)."""
    catalog = read_envelope(
        spark, path, {"categories": CATEGORY_FIELDS, "variables": VARIABLE_FIELDS}, "updated_at string"
    )
    return unfold(catalog, "categories", "posicion"), unfold(catalog, "variables", "posicion")


def read_long(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a long document; with ``lines`` those of a folder written by ``write_long_json``,
    which is read split by split."""
    if lines:
        return spark.read.schema(LONG_FIELDS).json(f"{path}/records")
    return unfold(read_envelope(spark, path, {"records": LONG_FIELDS}), "records")


def read_wide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, metric catalog and the envelope fields of a wide document."""
    document = read_envelope(spark, path, {"metric_catalog": METRIC_FIELDS, "records": WIDE_FIELDS})
    return (
        unfold(document, "records"),
        unfold(document, "metric_catalog", "posicion"),
        document.select("updated_at", "schema_version", "dataset_id", "source"),
    )


def category_label(category: str = "categoria_id"):
    """Display name of a category; an unknown id is shown as it is."""
    return aliased(F.col(category), fixed.CATEGORY_LABELS, F.col(category))


def dashboard_metrics(catalog: DataFrame, source: str) -> DataFrame:
    """The metric catalog under the names the dashboard uses."""
    return catalog.select(
        F.col("variable_id").alias("id"),
        "label",
        F.col("unidad").alias("unit"),
        category_label().alias("category"),
        fill_in(fixed.METRIC_DESCRIPTION, label=F.col("label"), source=source).alias("description"),
        "posicion",
    )


def dashboard_records(wide: DataFrame) -> DataFrame:
    """Wide records under the names the dashboard uses."""
    return wide.select(
        F.col("estado").alias("state"),
        "region",
        F.col("state_code").alias("stateCode"),
        F.col("cve_ent").alias("cveEnt"),
        F.col("anio").alias("year"),
        "metrics",
    )
