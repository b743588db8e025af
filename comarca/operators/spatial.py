"""Bounding-box filter and the point-in-polygon join: on cells of several sizes, or on one grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions import geometry as geo
from comarca.operators import quadtree

#: How many grid cells an average polygon spans along each axis.
CELLS_PER_EXTENT = 4


def intersects_box(box: Column, limits: tuple[float, float, float, float]) -> Column:
    """Whether a bounding box touches another one, edges included."""
    x_min, y_min, x_max, y_max = limits
    return (box["x_max"] >= x_min) & (box["x_min"] <= x_max) & (box["y_max"] >= y_min) & (box["y_min"] <= y_max)


def cell_size(polygons: DataFrame, geometry: str = "geometria") -> Column:
    """Grid step from the polygons themselves, as a scalar subquery.

    With the step at least the mean width, the mean height and the root of the mean box area
    (each over ``CELLS_PER_EXTENT``), the number of cells all polygons cover together is at
    most a fixed multiple of the number of polygons, however uneven their sizes are. Both join
    sides evaluate it, so the means are taken over decimals: they come out the same each time.
    """
    boxes = polygons.select(geo.bounds(F.col(geometry)).alias("b")).select(
        (F.col("b.x_max") - F.col("b.x_min")).alias("w"), (F.col("b.y_max") - F.col("b.y_min")).alias("h")
    )

    def mean(value: Column) -> Column:
        return F.avg(value.cast("decimal(28,9)")).cast("double")

    extent = F.greatest(mean(F.col("w")), mean(F.col("h")), F.sqrt(mean(F.col("w") * F.col("h"))))
    step = boxes.agg((F.when(extent > 0, extent).otherwise(1.0) / CELLS_PER_EXTENT).alias("step"))
    return step.scalar()


def polygon_cells(polygons: DataFrame, step: Column, geometry: str = "geometria") -> DataFrame:
    """One row per polygon and grid cell of its box, with the edges that matter in that cell.

    A point of the cell can only lie on, or have to its right, an edge that shares its row of
    cells and does not end left of it. ``floor(v / step)`` never decreases with ``v``, so
    choosing edges by cell number loses none. Cells without such edges are outside.
    """

    def cell(value: Column) -> Column:
        return F.floor(value / F.col("_step"))

    boxed = polygons.withColumn("_step", step).withColumn("_box", geo.bounds(F.col(geometry)))
    rows = boxed.withColumn("_edges", geo.edges(F.col(geometry))).drop(geometry)
    rows = rows.withColumn("_cy", F.explode(F.sequence(cell(F.col("_box.y_min")), cell(F.col("_box.y_max")))))
    rows = rows.withColumn(
        "_edges",
        F.filter(
            "_edges",
            lambda e: (cell(F.least(e["y1"], e["y2"])) <= F.col("_cy")) & (cell(F.greatest(e["y1"], e["y2"])) >= F.col("_cy")),
        ),
    )
    rows = rows.withColumn("_cx", F.explode(F.sequence(cell(F.col("_box.x_min")), cell(F.col("_box.x_max")))))
    rows = rows.withColumn(
        "_edges", F.filter("_edges", lambda e: cell(F.greatest(e["x1"], e["x2"])) >= F.col("_cx"))
    )
    return rows.where(F.size("_edges") > 0).drop("_step", "_box")


def _bytes(cells: DataFrame) -> int:
    """Size of the cells in memory: 32 bytes and a header for an edge, and the other columns."""
    others = sum(16 for _ in cells.columns)
    return cells.agg(F.coalesce(F.sum(F.size("_edges") * 48 + others + 64), F.lit(0))).first()[0]


def within_join(
    points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", geometry: str = "geometria", step: float | None = None
) -> DataFrame:
    """Inner join of points with the polygons they lie strictly inside of: on a grid of ``step`` where one
    is given, else on cells of the polygons' own sizes (`operators.quadtree`)."""
    if step is None:
        return quadtree.within(points, polygons, x, y, geometry)
    return grid_join(points, polygons, x, y, geometry, step)


def grid_join(
    points: DataFrame,
    polygons: DataFrame,
    x: str = "x",
    y: str = "y",
    geometry: str = "geometria",
    step: float | None = None,
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Inner join of points with the polygons they lie strictly inside of.

    The equi-join is on the grid cell, the exact test is its residual condition. Points are
    never replicated. The planner can't guess how many cells and edges polygons have, so their
    size is measured, one number over the polygons. Up to ``broadcast_bytes`` the cells are broadcast
    and points aren't shuffled; beyond it both are, and AQE splits a hot cell.
    """
    size = F.lit(float(step)) if step is not None else cell_size(polygons, geometry)
    cells = polygon_cells(polygons, size, geometry)
    cells = cells.hint("broadcast" if _bytes(cells) <= broadcast_bytes else "merge")
    located = (
        points.withColumn("_step", size)
        .withColumn("_px", F.floor(F.col(x) / F.col("_step")))
        .withColumn("_py", F.floor(F.col(y) / F.col("_step")))
        .drop("_step")
    )
    matches = (
        (F.col("_px") == F.col("_cx"))
        & (F.col("_py") == F.col("_cy"))
        & geo.inside(F.col("_edges"), F.col(x), F.col(y))
    )
    return located.join(cells, matches, "inner").drop("_px", "_py", "_cx", "_cy", "_edges")
