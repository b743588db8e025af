"""Polygon layers from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.functions.geometry import from_geojson

_FEATURE = "struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"


def read_shapes(spark: SparkSession, path: str, properties: dict[str, str], lines: bool = False) -> DataFrame:
    """Features with the given properties (name -> type) and their ``geometria``.

    A feature collection is one JSON document and is parsed by one task; ``lines`` reads one
    feature per line, which splits over tasks, and is the form to use for tiles.
    """
    if lines:
        fields = _FEATURE.removeprefix("struct<").removesuffix(">")
        features = spark.read.schema(fields.replace("properties:", "properties ").replace("geometry:", "geometry ")).json(path)
    else:
        collection = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
        features = collection.select(F.explode("features").alias("f")).select("f.*")
    return shaped(features, properties)


def parsed_features(lines: DataFrame, column: str, properties: dict[str, str]) -> DataFrame:
    """Features held in a text column, one a row."""
    return shaped(lines.select(F.from_json(column, _FEATURE).alias("f")).select("f.*"), properties)


def shaped(features: DataFrame, properties: dict[str, str]) -> DataFrame:
    return features.where(F.col("geometry").isNotNull()).select(
        *[F.try_element_at("properties", F.lit(name)).cast(dtype).alias(name) for name, dtype in properties.items()],
        from_geojson(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometria"),
    )
