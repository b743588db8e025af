"""The variable catalog: insert-only synchronisation, inference and metric lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.text import fill_in, strip, title_runs
from comarca.specs import ContextVariable

SPEC_FIELDS = (
    "posicion int, variable string, anio int, categoria string, label string, unidad string, "
    "fuente_sugerida string, sinonimos array<string>"
)
METADATA_FIELDS = "variable string, fuente_sugerida string, sinonimos array<string>"


def value_type(variable: Column, unit: Column) -> Column:
    """Percentage by suffix or unit, then the integer variables, then currency units, else number."""
    lowered = F.lower(unit)
    currency = F.lit(False)
    for name in fixed.CURRENCY_UNITS:
        currency = currency | lowered.contains(name)
    return (
        F.when(variable.endswith("_pct") | (strip(unit) == "%"), "percentage")
        .when(variable.isin(fixed.INTEGER_VARIABLES), "integer")
        .when(currency, "currency")
        .otherwise("number")
    )


def default_aggregation(variable: Column) -> Column:
    return F.when(variable.isin(fixed.SUMMED_VARIABLES), "sum").otherwise("avg")


def suggested_source(own: Column, metadata: Column, fallback: str) -> Column:
    """The first that is neither missing nor empty."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(metadata, F.lit("")), F.lit(fallback))


def synonyms(own: Column, metadata: Column) -> Column:
    """The first that is not missing; an empty list counts as given."""
    return F.coalesce(own, metadata, F.array().cast("array<string>"))


def spec_rows(spark: SparkSession, specs: Sequence[ContextVariable]) -> DataFrame:
    """Declared variables as the table :func:`sync_catalog` takes; metadata travels apart."""
    rows = [(i, s.variable, s.anio, s.categoria, s.label, s.unidad, None, None) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, SPEC_FIELDS)


def metadata_rows(spark: SparkSession, specs: Sequence[ContextVariable]) -> DataFrame:
    rows = [(s.variable, s.fuente_sugerida, list(s.sinonimos)) for s in specs]
    return spark.createDataFrame(rows, METADATA_FIELDS)


def category_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.CATEGORY_DEFAULTS, "categoria_id string, nombre string, descripcion string")


def _first_per(rows: DataFrame, key: str, position: str = "posicion") -> DataFrame:
    rest = [name for name in rows.columns if name not in (key, position)]
    first = rows.groupBy(key).agg(F.min(F.struct(position, *rest)).alias("_first"))
    return first.select(key, "_first.*")


def new_variables(
    variables: DataFrame, specs: DataFrame, metadata: DataFrame, source: str = fixed.CONTEXT_SOURCE
) -> DataFrame:
    """Catalog rows of the declared variables the catalog lacks; existing ids are never touched.

    ``posicion`` is the place in the declaration.
    """
    meta = metadata.select(
        F.col("variable").alias("_key"), F.col("fuente_sugerida").alias("_fuente"), F.col("sinonimos").alias("_sinonimos")
    )
    unknown = _first_per(specs, "variable").join(
        variables.select("variable_id"), F.col("variable") == F.col("variable_id"), "left_anti"
    )
    return unknown.join(meta, F.col("variable") == F.col("_key"), "left").select(
        F.col("variable").alias("variable_id"),
        F.col("categoria").alias("categoria_id"),
        F.col("label").alias("nombre"),
        fill_in(fixed.VARIABLE_DESCRIPTION, label=F.col("label"), year=F.col("anio")).alias("descripcion"),
        F.col("unidad").alias("unidad_base"),
        value_type(F.col("variable"), F.col("unidad")).alias("tipo_valor"),
        default_aggregation(F.col("variable")).alias("agregacion_default"),
        suggested_source(F.col("fuente_sugerida"), F.col("_fuente"), source).alias("fuente_sugerida"),
        synonyms(F.col("sinonimos"), F.col("_sinonimos")).alias("sinonimos"),
        "posicion",
    )


def new_categories(categories: DataFrame, specs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Categories the declarations use and the catalog lacks, named by the defaults or by their id."""
    known = categories.select("categoria_id")
    used = specs.groupBy(F.col("categoria").alias("categoria_id")).agg(F.min("posicion").alias("posicion"))
    named = defaults.select("categoria_id", F.col("nombre").alias("_nombre"), F.col("descripcion").alias("_descripcion"))
    return (
        used.join(known, "categoria_id", "left_anti")
        .join(named, "categoria_id", "left")
        .select(
            "categoria_id",
            F.coalesce("_nombre", title_runs(F.replace(F.col("categoria_id"), F.lit("_"), F.lit(" ")))).alias("nombre"),
            F.coalesce("_descripcion", F.lit(fixed.CATEGORY_FALLBACK_DESCRIPTION)).alias("descripcion"),
            "posicion",
        )
    )


def sync_catalog(
    categories: DataFrame,
    variables: DataFrame,
    specs: DataFrame,
    metadata: DataFrame,
    defaults: DataFrame,
    source: str = fixed.CONTEXT_SOURCE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Categories and variables after insert-only synchronisation, and the list of what was added.

    New rows follow the existing ones, in the order of the declarations.
    """
    extra_categories = new_categories(categories, specs, defaults)
    extra_variables = new_variables(variables, specs, metadata, source)

    def after(existing: DataFrame, extra: DataFrame) -> DataFrame:
        end = existing.agg(F.coalesce(F.max("posicion") + 1, F.lit(0)).alias("n")).scalar()
        return existing.unionByName(extra.withColumn("posicion", F.col("posicion") + end))

    added = extra_categories.select(F.lit("category").alias("kind"), F.col("categoria_id").alias("id")).unionByName(
        extra_variables.select(F.lit("variable").alias("kind"), F.col("variable_id").alias("id"))
    )
    return after(categories, extra_categories), after(variables, extra_variables), added


def metric_options(metrics: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """Choices for a selector: the listed ids the catalog knows, in list order, or the whole catalog.

    ``metrics`` has the dashboard names (``id, label, category, posicion``).
    """
    if ids is None:
        return metrics.select("id", "label", "category", "posicion")
    wanted = metrics.sparkSession.createDataFrame([(i, name) for i, name in enumerate(ids)], "_place int, _id string")
    first = _first_per(metrics.select("id", "posicion", "label", "category"), "id")
    return wanted.join(first, F.col("_id") == F.col("id"), "inner").select(
        "id", "label", "category", F.col("_place").alias("posicion")
    )


def category_metrics(metrics: DataFrame, category: str) -> DataFrame:
    """Metrics of one category, in catalog order by ``posicion``."""
    return metrics.where(F.col("category") == category).select("id", "label", "category", "posicion")


def metric_definition(metrics: DataFrame, metric: str) -> DataFrame:
    """The catalog row of a metric (the first, if repeated); running it fails for an unknown id."""
    found = metrics.where(F.col("id") == metric)
    fields = [name for name in metrics.columns if name != "posicion"]
    row = found.agg(F.min_by(F.struct(*fields), "posicion").alias("m"))
    message = fill_in(fixed.UNKNOWN_METRIC_ERROR, metric=metric)
    return row.select(
        F.when(F.col("m").isNull(), F.raise_error(message).cast(row.schema["m"].dataType)).otherwise(F.col("m")).alias("m")
    ).select("m.*")
