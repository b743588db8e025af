"""The benchmark tables in the roles the library works with.

Nations are entities, order lines and orders are weighted microdata, customers are localities,
orders of a year are the connectivity facts, events are speed tests, parts are catalog rows.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import geometry as geo
from comarca.functions.text import zero_fill
from comarca.operators import observations
from comarca.plans.survey import Microdata, SurveyInputs, SurveyMetrics, survey_observations
from comarca.sources.documents import dashboard_metrics
from comarca.specs import Share, direct_values, locality_shares, survey_shares

YEAR = 1997
#: Entities a dashboard compares, in place of the published default.
SELECTED = ["NATION_3", "NATION_7", "NATION_11", "NATION_19"]

#: Column and positive values that stand in for the response of each survey metric.
LINE_ANSWERS = {
    "personas_usuarias_computadora_pct": ("l_returnflag", ("A",)),
    "personas_usuarias_internet_pct": ("l_returnflag", ("A", "N")),
    "personas_conexion_internet_movil_pct": ("l_linestatus", ("O",)),
    "personas_usan_redes_sociales_pct": ("l_linestatus", ("F",)),
    "personas_compras_internet_pct": ("l_returnflag", ("R",)),
    "personas_pagos_internet_pct": ("l_linenumber", ("1", "2", "3")),
    "personas_banca_electronica_pct": ("l_linenumber", ("7",)),
}
ORDER_ANSWERS = {
    "personas_con_celular_pct": ("o_orderstatus", ("O",)),
    "personas_usuarias_celular_pct": ("o_orderstatus", ("O", "F")),
    "personas_con_smartphone_pct": ("o_orderpriority", ("1-URGENT", "2-HIGH")),
    "personas_conexion_datos_celular_pct": ("o_orderpriority", ("3-MEDIUM",)),
    "personas_usan_apps_redes_sociales_pct": ("o_orderpriority", ("5-LOW",)),
    "personas_usan_banca_movil_pct": ("o_orderstatus", ("P",)),
}
LOCALITY_ANSWERS = {
    "localidades_con_cobertura_movil_pct": ("o_orderstatus", ("O",)),
    "poblacion_en_localidades_con_cobertura_movil_pct": ("o_orderstatus", ("O",)),
    "localidades_con_4g_garantizada_pct": ("o_orderpriority", ("1-URGENT",)),
    "poblacion_en_localidades_con_4g_garantizada_pct": ("o_orderpriority", ("1-URGENT",)),
    "localidades_con_5g_garantizada_pct": ("o_orderpriority", ("2-HIGH",)),
    "poblacion_en_localidades_con_5g_garantizada_pct": ("o_orderpriority", ("2-HIGH",)),
    "hogares_en_localidades_con_internet_pct": ("o_orderstatus", ("F",)),
    "poblacion_en_localidades_con_internet_pct": ("o_orderstatus", ("F",)),
}


#: Declared, so no file is opened to find out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query stores: in the shared folder the session names, or, on one
    machine only, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="comarca-tables-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _answered(specs: list[Share], answers: dict[str, tuple[str, tuple[str, ...]]]) -> tuple[Share, ...]:
    return tuple(
        replace(spec, column=answers[spec.variable][0], positive_values=answers[spec.variable][1])
        for spec in specs
        if spec.variable in answers
    )


def metrics() -> SurveyMetrics:
    return SurveyMetrics(
        shares=_answered(survey_shares(), LINE_ANSWERS | ORDER_ANSWERS),
        direct=tuple(direct_values()),
        localities=_answered(locality_shares(), LOCALITY_ANSWERS),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    code = zero_fill(F.col("n_nationkey"))
    number = F.col("n_nationkey").cast("string")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("N"), code).alias("state_code"),
        code.alias("cve_ent"),
        F.col("n_name").alias("estado"),
        F.array(F.concat(F.lit("Nación "), number), F.concat(F.lit("N."), number)).alias("aliases"),
        F.col("r_name").alias("region"),
        F.lit("").alias("capital"),
    )


def suppliers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(F.col("s_suppkey").alias("unit"), zero_fill(F.col("s_nationkey")).alias("cve_ent"))


def customers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.col("c_custkey").alias("unit"), zero_fill(F.col("c_nationkey")).alias("cve_ent"))


def in_year(orders: DataFrame, year: int = YEAR) -> DataFrame:
    """A date range, so the filter reaches the scan."""
    day = F.col("o_orderdate")
    first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    return orders.where((day >= first) & (day < after))


def lines(spark: SparkSession, sf_dir: str) -> Microdata:
    return Microdata(
        table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "decimal(8,2)", suppliers_of(spark, sf_dir)
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation and month of the year, as an authority would publish them. The range of dates
    reaches the scan, before the aggregation."""
    counted = (
        in_year(table(spark, sf_dir, "orders"))
        .groupBy("o_custkey", F.year("o_orderdate").alias("ANIO"), F.month("o_orderdate").alias("MES"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        counted.join(customers_of(spark, sf_dir), F.col("o_custkey") == F.col("unit"))
        .groupBy(F.col("cve_ent").alias("K_ENTIDAD"), "ANIO", "MES")
        .agg(F.sum("_n").cast("double").alias("T_INTMOVIL_ITE_VA"))
    )


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = in_year(table(spark, sf_dir, "orders"))
    return orders.select(
        F.col("o_custkey").cast("string").alias("CVEGEO"), F.year("o_orderdate").alias("ANIO"), "o_orderstatus", "o_orderpriority"
    )


def localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.greatest(F.col("c_acctbal").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("CVEGEO"),
        F.col("c_nationkey").cast("string").alias("ENT"),
        balance.cast("string").alias("POBLACION"),
        F.floor(balance / 100).cast("string").alias("TOTHOG"),
        F.col("c_custkey").alias("ID"),
    )


def survey_inputs(spark: SparkSession, sf_dir: str) -> SurveyInputs:
    return SurveyInputs(
        microdata={
            "usuarios": lines(spark, sf_dir),
            "usuarios2": Microdata(
                table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "decimal(18,2)", customers_of(spark, sf_dir)
            ),
        },
        published={"td_teledensidad_intmovil": published(spark, sf_dir)},
        connectivity=connectivity(spark, sf_dir),
        localities=localities(spark, sf_dir),
        master=master(spark, sf_dir),
    )


def survey_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_observations(survey_inputs(spark, sf_dir), YEAR, metrics())


def survey_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table with one column per metric."""
    wide = observations.pivot_metrics(survey_long(spark, sf_dir), metrics().variables)
    entities = master(spark, sf_dir).select("state_code", "cve_ent", "estado", "region")
    return wide.join(entities, "cve_ent", "inner")


def dashboard_catalog(spark: SparkSession) -> DataFrame:
    return dashboard_metrics(observations.metric_catalog(spark, metrics().all), fixed.SURVEY_SOURCE)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Whole texts."""
    return table(spark, sf_dir, "documents").select(*columns)


# --- places -----------------------------------------------------------------------------
# Coordinates are multiples of 1/1024 degree, so every engine computes them exactly. Speed
# tests and territories lie along a strip that grows with both tables, so a place falls into
# about as many territories at any scale.

#: The coverage box, open to the east where the strip grows.
STRIP_BOX = (fixed.COVERAGE_BOX[0], fixed.COVERAGE_BOX[1], 1e9, fixed.COVERAGE_BOX[3])
TILE_HALF = 1 / 512


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed tests with a place; some lie west, south or north of the box."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value").select(
        "event_id", "user_id", "value",
        (F.lit(-119.0) + F.col("event_id") * 15 / F.lit(1024.0)).alias("x"),
        (F.lit(13.0) + F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 131, F.lit(21504)) / F.lit(1024.0)).alias("y"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square tile of 1/256 degree around the place of each speed test."""
    west, east = F.col("x") - TILE_HALF, F.col("x") + TILE_HALF
    south, north = F.col("y") - TILE_HALF, F.col("y") + TILE_HALF
    return places(spark, sf_dir).select(
        "event_id",
        (F.col("value") * 1000).alias("avg_d_kbps"),
        F.col("user_id").alias("tests"),
        west.alias("x_min"), south.alias("y_min"), east.alias("x_max"), north.alias("y_max"),
        geo.polygon((west, south), (east, south), (east, north), (west, north)).alias("geometria"),
    )


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond per supplier, its corners between 1/1024 and 2 degrees from its centre."""
    key, x, y, r = F.col("s_suppkey"), F.col("_x"), F.col("_y"), F.col("_r")
    placed = (
        table(spark, sf_dir, "supplier")
        .withColumn("_x", F.lit(-119.0) + key * 1536 / F.lit(1024.0))
        .withColumn("_y", F.lit(14.0) + F.pmod(key * 2741, F.lit(18432)) / F.lit(1024.0))
        .withColumn("_r", (F.lit(1) + F.pmod(key * 613, F.lit(2048))) / F.lit(1024.0))
    )
    return placed.select(
        zero_fill(F.col("s_nationkey")).alias("CVE_ENT"),
        key.cast("string").alias("CVEGEO"),
        F.col("s_name").alias("NOMGEO"),
        geo.polygon((x + r, y), (x, y + r), (x - r, y), (x, y - r)).alias("geometria"),
    )
