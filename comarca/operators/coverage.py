"""Mobile coverage: tiles to technology classes, municipalities and states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import geometry as geo
from comarca.functions.numeric import technology
from comarca.operators.spatial import intersects_box, within_join

TECHNOLOGIES = [name for name, _ in fixed.TECHNOLOGY_LIMITS_MBPS] + [fixed.TECHNOLOGY_ABOVE]
#: Points of a ring, the closing one included, up to which its centroid is written out.
SMALL_RING = 5
BOX_COLUMNS = ("x_min", "y_min", "x_max", "y_max")


def tiles_in_box(
    tiles: DataFrame, limits: tuple[float, float, float, float] = fixed.COVERAGE_BOX, geometry: str = "geometria"
) -> DataFrame:
    """Tiles that touch the box. Stored box columns are used if present: they reach the scan."""
    stored = all(name in tiles.columns for name in BOX_COLUMNS)
    box = F.struct(*BOX_COLUMNS) if stored else geo.bounds(F.col(geometry))
    return tiles.where(intersects_box(box, limits))


def with_centroid(tiles: DataFrame, geometry: str = "geometria", x: str = "x", y: str = "y") -> DataFrame:
    """Add the centroid as two columns.

    Tiles are one ring of a few corners: for those the sums of `geometry.centroid` are written out, in steps that
    compile (a lambda doesn't). Corners that a ring lacks are taken as its first, which adds edges of no length. Other
    shapes, and those without area, take the general formula."""
    shape, own = F.col(geometry), [F.col(f"`{name}`") for name in tiles.columns]
    ring = F.get(F.get(shape, F.lit(0)), F.lit(0))
    small = (F.size(shape) == 1) & (F.size(F.get(shape, F.lit(0))) == 1) & F.size(ring).between(1, SMALL_RING)
    rows = tiles.select(*own, small.alias("_small"), ring.alias("_ring"))
    first = F.get("_ring", F.lit(0))
    corners = [F.coalesce(F.get("_ring", F.lit(k)), first) for k in range(1, SMALL_RING)]
    relative = [(p[axis] - first[axis]).alias(f"_{axis}{k}") for k, p in enumerate(corners, 1) for axis in "xy"]
    rows = rows.select(*own, "_small", first.alias("_first"), *relative)
    rows = rows.select(*own, "_small", "_first", *[F.expr(sql).alias(name) for name, sql in _corner_sums(SMALL_RING).items()])
    by_area = F.struct(*[(F.col("_first")[axis] + F.col(f"_m{axis}") / (F.col("_a") * 3.0)).alias(axis) for axis in "xy"])
    rows = rows.select(*own, F.when(F.col("_small") & (F.col("_a") != 0.0), by_area).otherwise(geo.centroid(shape)).alias("_centre"))
    # The generator keeps the optimizer from copying these expressions into later conditions.
    return rows.select(*own, F.inline(F.array("_centre")).alias(x, y))


def _corner_sums(corners: int) -> dict[str, str]:
    """SQL of the doubled area and its moments from corners relative to the first, which is 0, 0. Its own edges turn by 0."""
    edges = [(f"_x{k}", f"_y{k}", f"_x{k + 1}", f"_y{k + 1}") for k in range(1, corners - 1)]
    turns = [(f"({x1} * {y2} - {x2} * {y1})", x1, y1, x2, y2) for x1, y1, x2, y2 in edges]
    return {
        "_a": " + ".join(turn for turn, *_ in turns),
        "_mx": " + ".join(f"({x1} + {x2}) * {turn}" for turn, x1, _, x2, _ in turns),
        "_my": " + ".join(f"({y1} + {y2}) * {turn}" for turn, _, y1, _, y2 in turns),
    }


def located_tiles(
    tiles: DataFrame, municipalities: DataFrame, geometry: str = "geometria", step: float | None = None
) -> DataFrame:
    """Each tile with the municipality its centroid lies in; the tile keeps its own geometry."""
    centred = with_centroid(tiles, geometry, "_x", "_y")
    shapes = municipalities.withColumnRenamed("geometria", "_forma")
    return within_join(centred, shapes, "_x", "_y", geometry="_forma", step=step).drop("_x", "_y")


def with_technology(tiles: DataFrame, kbps: str = "avg_d_kbps") -> DataFrame:
    """Speed in Mbps, technology class and the class as three 100/0 columns."""
    speed = tiles.withColumn("avg_d_mbps", F.col(kbps) / 1000)
    classed = speed.withColumn("tech_proxy", technology(F.col("avg_d_mbps")))
    return classed.withColumns(
        {
            f"int_pct_{name.lower()}_coverage": F.when(F.col("tech_proxy") == name, F.lit(100)).otherwise(F.lit(0))
            for name in TECHNOLOGIES
        }
    )


def commonest(counts: Sequence[tuple[str, Column]]) -> Column:
    """The category with the highest count; of equal ones the first in the list."""
    highest = F.greatest(*[count for _, count in counts])
    result = None
    for name, count in counts:
        result = F.when(count == highest, name) if result is None else result.when(count == highest, name)
    return result


def most_frequent(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mode of an open set of values per key, the smallest on ties.

    Values are counted first, so what reaches the second grouping is one row per key and value.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value))).getField(value).alias(value))


def _share_columns() -> list[str]:
    return [f"int_pct_{name.lower()}_coverage" for name in TECHNOLOGIES]


def _class_counts() -> list[Column]:
    return [F.count_if(F.col("int_tech_predominante") == name).alias(f"_n_{name}") for name in TECHNOLOGIES]


def _dominant() -> Column:
    """Counting a closed set of classes keeps the aggregation hash-based, unlike ``mode``."""
    return commonest([(name, F.col(f"_n_{name}")) for name in TECHNOLOGIES])


def _mean(name: str) -> Column:
    """Mean that leaves out null and NaN alike."""
    return F.avg(F.when(~F.isnan(name), F.col(name)))


def by_municipality(tiles: DataFrame, geometry: str = "geometria") -> DataFrame:
    """Means, counts and dominant technology per municipality; rows without a full key are left out."""
    keys = ("CVE_ENT", "CVEGEO", "NOMGEO")
    complete = tiles.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & F.col(keys[2]).isNotNull())
    rows = complete.withColumnRenamed("tech_proxy", "int_tech_predominante")
    grouped = rows.groupBy(*keys).agg(
        _mean("avg_d_mbps").alias("int_avg_speed"),
        *_class_counts(),
        F.count(F.col(geometry)).alias("geometry"),
        F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"),
        *[F.avg(name).alias(name) for name in _share_columns()],
    )
    return grouped.select(
        "CVE_ENT", F.col("CVEGEO").alias("id_cvegeo"), F.col("NOMGEO").alias("nom_mun"), "int_avg_speed",
        _dominant().alias("int_tech_predominante"), "geometry", "tests", *_share_columns(),
    )


def by_state(municipalities: DataFrame) -> DataFrame:
    """Unweighted means over municipalities, whatever their number of tiles or tests."""
    grouped = municipalities.where(F.col("CVE_ENT").isNotNull()).groupBy("CVE_ENT").agg(
        F.avg("int_avg_speed").alias("int_avg_speed"),
        *[F.avg(name).alias(name) for name in _share_columns()],
        *_class_counts(),
    )
    return grouped.select("CVE_ENT", "int_avg_speed", *_share_columns(), _dominant().alias("int_tech_predominante"))
