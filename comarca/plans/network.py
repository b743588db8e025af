"""Mobile coverage by technology: tiles to municipalities to states."""

from __future__ import annotations

from pyspark.sql import DataFrame

from comarca import fixed_values as fixed
from comarca.operators import coverage
from comarca.sinks import publish


def classified_tiles(
    tiles: DataFrame,
    municipalities: DataFrame,
    limits: tuple[float, float, float, float] = fixed.COVERAGE_BOX,
    step: float | None = None,
) -> DataFrame:
    """Tiles of the box with their municipality, speed and technology."""
    located = coverage.located_tiles(coverage.tiles_in_box(tiles, limits), municipalities, step=step)
    return coverage.with_technology(located)


def publish_coverage(tiles: DataFrame, municipalities: DataFrame, folder: str) -> None:
    """Write the tile layer once and roll up from what was written."""
    spark = tiles.sparkSession
    stored = f"{folder}/tiles"
    classified_tiles(tiles, municipalities).write.mode("overwrite").parquet(stored)
    classified = spark.read.parquet(stored)
    by_municipality = coverage.by_municipality(classified).persist()
    try:
        publish.write_coverage(by_municipality, coverage.by_state(by_municipality), folder)
    finally:
        by_municipality.unpersist()
    publish.write_features(classified, f"{folder}/geojson")
