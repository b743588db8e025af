"""The socio-economic context dataset: poverty, product and census figures per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.numeric import number_or_null, percent, ratio, round_half_even
from comarca.functions.text import zero_fill
from comarca.operators import catalog, lookups, observations
from comarca.sinks import publish
from comarca.sources import cells
from comarca.specs import context_variables


def state_totals(census: DataFrame) -> DataFrame:
    """State rows of the census under their published names.

    The total is an integer by contract, the other counts may be marks that are no numbers.
    """
    rows = census.where((F.col("MUN") == 0) & (F.col("LOC") == 0) & (F.col("ENTIDAD") != 0))
    return rows.select(
        zero_fill(F.col("ENTIDAD")).alias("cve_ent"),
        *[number_or_null(F.col(column)).alias(name) for column, name in fixed.CENSUS_COLUMNS],
    )


def poverty(poverty_cells: DataFrame, master: DataFrame) -> DataFrame:
    """Poverty figures by entity: one sheet per entity, the national one left out."""
    wanted = cells.sheets_but(poverty_cells)
    values = cells.without_first_sheet(cells.labelled_values(wanted), wanted)
    return lookups.with_entity_code(values, master, "sheet").select("cve_ent", *[name for name, _ in fixed.POVERTY_LABELS])


def product(gdp_cells: DataFrame, master: DataFrame) -> DataFrame:
    """Gross product of the latest year by entity."""
    rows = cells.last_column_range(gdp_cells)
    named = lookups.with_entity_code(rows, master, "estado")
    return named.select("cve_ent", number_or_null(F.col("pib_total")).alias("pib_total"))


def derived(merged: DataFrame) -> DataFrame:
    """Product per head and shares of the population."""
    people = F.col("poblacion_total")
    return merged.withColumns(
        {
            "pib_per_capita": ratio(F.col("pib_total"), people),
            "poblacion_edad_laboral_pct": percent(F.col("poblacion_edad_laboral"), people),
            "poblacion_economicamente_activa_pct": percent(F.col("poblacion_economicamente_activa"), people),
            "poblacion_afiliada_imss_pct": percent(F.col("poblacion_afiliada_imss"), people),
            "total_viviendas_pct": percent(F.col("total_viviendas"), people),
        }
    )


def context_table(poverty_cells: DataFrame, gdp_cells: DataFrame, census: DataFrame, master: DataFrame) -> DataFrame:
    merged = lookups.left_merge(poverty(poverty_cells, master), [product(gdp_cells, master), state_totals(census)])
    return derived(merged)


def context_observations(table: DataFrame, master: DataFrame) -> DataFrame:
    """Long rows of the published variables, each with its own year, rounded to 4 digits."""
    specs = [(spec, spec.anio) for spec in context_variables()]
    return observations.observations(
        table, specs, master, fixed.CONTEXT_SOURCE, rounded=lambda value: round_half_even(value, 4)
    )


def context_wide(long: DataFrame, master: DataFrame) -> DataFrame:
    return observations.wide_records(long, master, [spec.variable for spec in context_variables()])


def publish_context(table: DataFrame, master: DataFrame, folder: str, updated_at: str) -> None:
    spark = master.sparkSession
    stored = f"{folder}/{fixed.CONTEXT_LONG_ID}/parquet"
    context_observations(table, master).write.mode("overwrite").parquet(stored)
    long = spark.read.parquet(stored)
    publish.write_long_json(
        long,
        f"{folder}/{fixed.CONTEXT_LONG_ID}",
        publish.envelope(long, updated_at, fixed.CONTEXT_LONG_ID, fixed.CONTEXT_SOURCE),
    )
    publish.write_wide_document(
        context_wide(long, master),
        observations.metric_catalog(spark, context_variables()),
        publish.envelope(long, updated_at, fixed.CONTEXT_WIDE_ID, fixed.CONTEXT_SOURCE),
        [f"{folder}/{fixed.CONTEXT_WIDE_ID}"],
    )


def sync_context_catalog(categories: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring the variable catalog up to the declared context variables."""
    spark = categories.sparkSession
    specs = context_variables()
    return catalog.sync_catalog(
        categories,
        variables,
        catalog.spec_rows(spark, specs),
        catalog.metadata_rows(spark, specs),
        catalog.category_defaults(spark),
    )
