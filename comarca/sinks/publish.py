"""Sinks. Tables go out as many files; only the entity-sized exports can be one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.geometry import to_geojson
from comarca.operators.observations import by_entity

_ENVELOPE = "updated_at string, schema_version string, dataset_id string, source string"


def envelope(df: DataFrame, updated_at: str, dataset_id: str, source: str) -> DataFrame:
    """The one row of run metadata that accompanies a published table."""
    row = [(updated_at, fixed.SCHEMA_VERSION, dataset_id, source)]
    return df.sparkSession.createDataFrame(row, _ENVELOPE)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one object per row; text outside ASCII stays as it is."""
    df.write.mode("overwrite").json(path)


def write_long_json(long: DataFrame, path: str, head: DataFrame) -> None:
    """The long table under ``records`` with its metadata row under ``envelope``."""
    write_json(head, f"{path}/envelope")
    write_json(long.select(*fixed.LONG_COLUMNS), f"{path}/records")


def write_long_csv(long: DataFrame, path: str) -> None:
    """The nine published columns in their order, with a header."""
    long.select(*fixed.LONG_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def document_lines(records: DataFrame, head: DataFrame, catalog: DataFrame | None = None, name: str = "records") -> DataFrame:
    """Lines of one enveloped JSON document with the array ``name``, and the keys that put them in order.

    Each record is a line of its own, so nothing is gathered into one row: sorted part files
    put one after the other are the document. The metric catalog of a wide document travels
    in the first line and is as short as the catalog.
    """
    start = F.to_json(F.struct(*head.columns))
    opening = F.expr("substring(_start, 1, length(_start) - 1)")
    if catalog is None:
        top = head.select(start.alias("_start")).select(F.concat(opening, F.lit(f',"{name}":[')).alias("value"))
    else:
        fields = [field for field in catalog.columns if field != "posicion"]
        listed = catalog.agg(
            F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("posicion", F.struct(*fields).alias("m")))), lambda i: i["m"]))
        ).scalar()
        top = head.select(start.alias("_start"), listed.alias("_catalog")).select(
            F.concat(opening, F.lit(',"metric_catalog":'), F.col("_catalog"), F.lit(f',"{name}":[')).alias("value")
        )
    first = records.agg(F.min("cve_ent").alias("k")).scalar()
    comma = F.when(F.col("cve_ent") == first, F.lit("")).otherwise(F.lit(","))
    body = records.select(
        F.lit(1).alias("_section"), F.col("cve_ent").alias("_key"), F.concat(comma, F.to_json(F.struct(*records.columns))).alias("value")
    )
    return (
        top.select(F.lit(0).alias("_section"), F.lit("").alias("_key"), "value")
        .unionByName(body)
        .unionByName(head.select(F.lit(2).alias("_section"), F.lit("").alias("_key"), F.lit("]}").alias("value")))
    )


def write_wide_document(
    wide: DataFrame, catalog: DataFrame, head: DataFrame, paths: list[str], single_file: bool = False
) -> None:
    """The enveloped wide document at every path, from one computation.

    One record per entity and unique ``cve_ent``. The sorted part files are to be read one after
    the other; ``single_file`` streams the lines through one writer instead, for datasets of
    few entities.
    """
    parts = 1 if single_file else int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _in_order(document_lines(wide, head, catalog), parts).persist()
    try:
        for path in paths:
            ordered.write.mode("overwrite").text(path)
    finally:
        ordered.unpersist()


def _in_order(lines: DataFrame, parts: int) -> DataFrame:
    return lines.repartitionByRange(parts, "_section", "_key").sortWithinPartitions("_section", "_key").select("value")


def write_entity_master(master: DataFrame, head: DataFrame, path: str) -> None:
    """The entity master as the one document that `documents.read_entity_master` reads: a line per entity, unique codes."""
    _in_order(document_lines(master, head, name="states"), 1).write.mode("overwrite").text(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per section of the quality report."""
    for section, table in tables.items():
        write_json(table, f"{path}/{section}")


def write_coverage(municipalities: DataFrame, states: DataFrame, path: str) -> None:
    write_json(municipalities, f"{path}/municipios")
    write_json(states, f"{path}/estados")


def features(tiles: DataFrame, properties: list[str], geometry: str = "geometria") -> DataFrame:
    """One GeoJSON feature per row, as text."""
    values: Column = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return tiles.select(
        F.concat(
            F.lit('{"type":"Feature","properties":'), values,
            F.lit(',"geometry":'), F.coalesce(to_geojson(F.col(geometry)), F.lit("null")), F.lit("}"),
        ).alias("value")
    )


def write_features(tiles: DataFrame, path: str, properties: tuple[str, ...] = ("tech_proxy", "avg_d_mbps")) -> None:
    """Tiles as newline-delimited GeoJSON: many files, read back split by split."""
    features(tiles, list(properties)).write.mode("overwrite").text(path)


def write_catalog(categories: DataFrame, variables: DataFrame, added: DataFrame, path: str, version: str) -> str | None:
    """A new version folder of the catalog; nothing is written when nothing was added."""
    if added.isEmpty():
        return None
    target = f"{path}/{version}"
    write_json(categories.orderBy("posicion"), f"{target}/categories")
    write_json(variables.orderBy("posicion"), f"{target}/variables")
    return target


def write_entities(df: DataFrame, path: str) -> None:
    """An entity table in entity order."""
    write_json(by_entity(df), path)
