"""Data-quality checks, profiles and the report assembled from them.

Each table is scanned once: all checks come from one aggregation of the long table and one of
the wide table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.numeric import round_half_even
from comarca.functions.text import fill_in, is_blank


def _profile_measures(rows: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    blank: Column = F.lit(False)
    for key in keys:
        blank = blank | (is_blank(F.col(key)) if key in rows.columns else F.lit(True))
    return {"rows_read": F.count(F.lit(1)), "rows_with_missing_primary_keys": F.count_if(blank)}


def source_profile(rows: DataFrame, source_id: str, file_name: str, keys: Sequence[str]) -> DataFrame:
    """Rows, columns and rows with a blank key of a raw table, in one pass over the key columns."""
    names = F.array(*[F.lit(name) for name in rows.columns])
    return rows.agg(*[c.alias(name) for name, c in _profile_measures(rows, keys).items()]).select(
        F.lit(source_id).alias("source_id"),
        F.lit(file_name).alias("file_name"),
        "rows_read",
        names.alias("columns"),
        "rows_with_missing_primary_keys",
    )


def value_measures(long: DataFrame) -> dict[str, Column]:
    """What the checks of single values count: rows, rows without a value, percentages out of range."""
    value = F.col("valor")
    outside = (F.col("unidad") == "%") & ((value < 0) | (value > 100))
    return {"records": F.count(F.lit(1)), "null_values": F.count_if(value.isNull()), "out_of_range": F.count_if(outside)}


def write_measured(rows: DataFrame, measures: Mapping[str, Column], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Writes ``rows`` by ``write`` and returns what the job that wrote them counted on the way, without another read.

    ``write`` must run one action over all rows of the table that it is given (a sort before it may take a sample,
    which is a job of its own). Counts of an empty table are 0.
    """
    observation = Observation(f"measured-{uuid.uuid4().hex}")
    write(rows.observe(observation, *[c.alias(name) for name, c in measures.items()]))
    found = observation.get
    return {name: int(found.get(name) or 0) for name in measures}


def write_profiled(
    rows: DataFrame, source_id: str, file_name: str, keys: Sequence[str], write: Callable[[DataFrame], None]
) -> DataFrame:
    """Writes a raw table and returns its :func:`source_profile`, counted by the same job."""
    found = write_measured(rows, _profile_measures(rows, keys), write)
    profile = (source_id, file_name, found["rows_read"], list(rows.columns), found["rows_with_missing_primary_keys"])
    schema = "source_id string, file_name string, rows_read bigint, columns array<string>, rows_with_missing_primary_keys bigint"
    return rows.sparkSession.createDataFrame([profile], schema)


def source_breakdown(long: DataFrame) -> DataFrame:
    """Long rows per source."""
    return long.groupBy(F.col("fuente").alias("source")).agg(F.count(F.lit(1)).alias("records"))


def pair_counts(long: DataFrame) -> DataFrame:
    """Long rows per entity and variable, with the counts the checks need."""
    percentage = F.col("unidad") == "%"
    return long.groupBy("cve_ent", "variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(percentage & ((F.col("valor") < 0) | (F.col("valor") > 100))).alias("out_of_range"),
    )


def duplicate_pairs(long: DataFrame) -> DataFrame:
    """How many rows are surplus to one per entity and variable."""
    return pair_counts(long).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def out_of_range(long: DataFrame) -> DataFrame:
    """Percentages outside 0..100; rows in other units never count."""
    wrong = (F.col("unidad") == "%") & ((F.col("valor") < 0) | (F.col("valor") > 100))
    return long.agg(F.count_if(wrong).alias("out_of_range"))


def metric_profile(wide: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count, extremes, mean and population deviation of every catalogued metric that has values."""
    values = wide.select(F.explode("metrics").alias("metric_id", "valor")).where(F.col("valor").isNotNull())
    stats = values.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("valor").alias("min"),
        F.max("valor").alias("max"),
        F.avg("valor").alias("mean"),
        F.stddev_pop("valor").alias("std_dev"),
    )
    labels = catalog.select(F.col("variable_id").alias("metric_id"), "label", F.col("unidad").alias("unit"), "posicion")
    return labels.join(stats, "metric_id", "inner").select(
        "posicion", "metric_id", "label", "unit", "count",
        *[round_half_even(F.col(name), 2).alias(name) for name in ("min", "max", "mean", "std_dev")],
    )


def _long_facts(long: DataFrame, catalog: DataFrame) -> DataFrame:
    """Numbers of the long table for each variable or metric of the catalog."""
    per_variable = pair_counts(long).groupBy("variable").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("surplus"), F.sum("out_of_range").alias("out_of_range")
    )
    metrics = catalog.select(F.col("variable_id").alias("_id"), F.col("posicion").alias("_place"))
    everything = per_variable.join(metrics, F.col("variable") == F.col("_id"), "full")
    return everything.select(
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("surplus", F.lit(0)).alias("surplus"),
        F.coalesce("out_of_range", F.lit(0)).alias("out_of_range"),
        "_id",
        "_place",
    )


def validation_facts(long: DataFrame, wide: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row with everything the checks compare. Only metrics that miss or repeat an entity are listed."""
    nulls = F.size(F.filter(F.map_values("metrics"), lambda value: value.isNull()))
    counted = wide.agg(F.struct(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls")).alias("c")).scalar()
    entities = counted.getField("entities")
    uneven = F.col("_id").isNotNull() & (F.col("rows") != F.col("entities"))
    listed = _long_facts(long, catalog).withColumn("entities", entities)
    facts = listed.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("out_of_range"), F.lit(0)).alias("out_of_range"),
        F.count("_id").cast("int").alias("metrics"),
        F.sort_array(F.collect_list(F.when(uneven, F.struct("_place", F.col("_id").alias("id"))))).alias("_uneven"),
    )
    return facts.select(
        "records", "duplicates", "out_of_range", entities.alias("entities"), counted.getField("nulls").alias("nulls"), "metrics",
        (entities * F.col("metrics")).alias("expected"),
        F.transform("_uneven", lambda m: m["id"]).alias("offenders"),
    )


def validation_checks(
    long: DataFrame, wide: DataFrame, catalog: DataFrame, expected_entities: int = fixed.EXPECTED_ENTITIES
) -> DataFrame:
    """The six checks as ``check_id, status, detail`` (and ``posicion`` for their order)."""
    return checks_of(validation_facts(long, wide, catalog), expected_entities)


def checks_of(facts: DataFrame, expected_entities: int = fixed.EXPECTED_ENTITIES) -> DataFrame:
    listed = F.concat(
        F.lit("["), F.array_join(F.transform("offenders", lambda name: F.concat(F.lit("'"), name, F.lit("'"))), ", "), F.lit("]")
    )
    offenders = F.when(F.size("offenders") == 0, F.lit(fixed.CHECK_NO_OFFENDERS)).otherwise(listed)
    passed = {
        "state_coverage": F.col("entities") == expected_entities,
        "metric_coverage": F.size("offenders") == 0,
        "expected_long_records": F.col("records") == F.col("expected"),
        "duplicate_state_variable_pairs": F.col("duplicates") == 0,
        "percentage_ranges": F.col("out_of_range") == 0,
        "null_metric_values": F.col("nulls") == 0,
    }
    values = {name: F.col(name) for name in ("entities", "records", "expected", "duplicates", "out_of_range")}
    checks = [
        F.struct(
            F.lit(i).alias("posicion"),
            F.lit(check).alias("check_id"),
            F.when(passed[check], "passed").otherwise("failed").alias("status"),
            fill_in(detail, offenders=offenders, **values).alias("detail"),
        )
        for i, (check, detail) in enumerate(fixed.CHECK_DETAILS)
    ]
    return facts.select(F.inline(F.array(*checks)))


def report_summary(long: DataFrame, wide: DataFrame, catalog: DataFrame, sources: int) -> DataFrame:
    """Size of the datasets a report covers."""
    return summary_of(validation_facts(long, wide, catalog), sources)


def summary_of(facts: DataFrame, sources: int) -> DataFrame:
    return facts.select(
        F.lit(sources).cast("long").alias("raw_files_profiled"),
        F.col("records").alias("records_long"),
        F.col("entities").alias("states_wide"),
        F.col("metrics").cast("long").alias("metrics_in_catalog"),
    )


def cleaning_logic(spark: SparkSession) -> DataFrame:
    """How the published values come about: ``posicion, key, value``; the steps in their order."""
    texts = [*fixed.CLEANING_ESTIMATORS, *[("key_steps", step) for step in fixed.CLEANING_STEPS]]
    return spark.createDataFrame([(i, *text) for i, text in enumerate(texts)], "posicion int, key string, value string")


def report_lines(
    summary: DataFrame, breakdown: DataFrame, checks: DataFrame, profile: DataFrame, raw_files: DataFrame | None = None
) -> DataFrame:
    """The report in long form: ``section, key, value``.

    A check has its status under its name and its text under ``<check>.detail``; a metric or raw file has
    one line per figure, ``<metric>.<figure>`` (two decimals, the count whole).
    """
    counts = summary.select(
        F.lit("summary").alias("section"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in summary.columns])),
    )
    by_source = breakdown.select(
        F.lit("source_breakdown").alias("section"), F.col("source").alias("key"), F.col("records").cast("string").alias("value")
    )
    by_check = _figures(checks, "validation_checks", "check_id", {"": F.col("status"), ".detail": F.col("detail")})
    statistics = {f".{name}": F.col(name).cast("decimal(38,2)").cast("string") for name in ("min", "max", "mean", "std_dev")}
    by_metric = _figures(profile, "metrics_profile", "metric_id", {"": F.col("count").cast("string"), **statistics})
    lines = counts.unionByName(by_source).unionByName(by_check).unionByName(by_metric)
    if raw_files is None:
        return lines
    figures = {
        ".file_name": F.col("file_name"), ".columns": F.array_join("columns", ","),
        **{f".{name}": F.col(name).cast("string") for name in ("rows_read", "rows_with_missing_primary_keys")},
    }
    return lines.unionByName(_figures(raw_files, "raw_files", "source_id", figures))


def _figures(rows: DataFrame, section: str, key: str, values: dict[str, Column]) -> DataFrame:
    """One line per figure of each row, under the row's key and the figure's name."""
    figures = [F.struct(F.concat(F.col(key), F.lit(name)).alias("key"), value.alias("value")) for name, value in values.items()]
    return rows.select(F.lit(section).alias("section"), F.inline(F.array(*figures)))
