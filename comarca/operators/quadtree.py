"""Point-in-polygon join on cells of several sizes, as in a quadtree.

Cells of level n are squares of 2**-n; cells of one level lie whole in those of a lower one. Each polygon is
covered by cells of its own size, at most a few along each side of its box, so a large polygon among small
ones costs as few rows as any other. A cell through which many edges pass is split, in rounds, and only it.
Cells wholly inside have no edges left, so their points need no test; cells wholly outside are dropped.

A point meets one cell of each level that the polygons can have. These levels come from boxes and numbers of edges
alone, as a scalar subquery: no job runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions import geometry as geo

#: Levels between a cell and the cells it is split into: 4 by 4.
DOWN = 2
#: Edges up to which a cell isn't split.
EDGES = 12
#: Rounds of splitting at most; a cell that still has more edges keeps them.
ROUNDS = 3
#: Levels of the largest and smallest cells.
LOWEST, HIGHEST = -30, 44


def _cell(value: Column, level: Column) -> Column:
    """Number of the cell along one axis. Scaling by a power of two is exact, so it never decreases with ``value``."""
    return F.floor(value * F.pow(F.lit(2.0), level))


def _levels(polygons: DataFrame, geometry: str) -> DataFrame:
    """``polygons`` with their box, edges, first level and how many rounds of splitting they may need.

    The first cells are between a quarter of the box's longer side and the whole of it. Splitting a cell leaves
    its parts about a quarter of the edges each, which bounds the rounds."""
    boxed = polygons.withColumn("_box", geo.bounds(F.col(geometry))).withColumn("_edges", geo.edges(F.col(geometry)))
    extent = F.greatest(F.col("_box.x_max") - F.col("_box.x_min"), F.col("_box.y_max") - F.col("_box.y_min"))
    first = F.when(extent > 0, F.ceil(-F.log2(extent) / DOWN) * DOWN).otherwise(F.lit(HIGHEST))
    rounds = F.ceil(F.log2(F.greatest(F.size("_edges"), F.lit(1)) / F.lit(float(EDGES))) / DOWN) + 1
    return boxed.withColumn("_level", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), first)).cast("int")).withColumn(
        "_rounds", F.when(F.size("_edges") > EDGES, F.least(rounds, F.lit(ROUNDS))).otherwise(F.lit(0)).cast("int")
    )


def _bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value`` evaluated once and called ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: The numbers of an array that occur an odd number of times (SQL, with the array to be put in).
_UNPAIRED = """aggregate(array_sort({}),
    named_struct('last', cast('-Infinity' as double), 'odd', false, 'out', cast(array() as array<double>)),
    (s, y) -> named_struct('last', y, 'odd', if(s.last = y, not s.odd, true),
                           'out', if(s.odd and s.last != y, concat(s.out, array(s.last)), s.out)),
    s -> if(s.odd, concat(s.out, array(s.last)), s.out))"""


def _clipped(cells: str) -> str:
    """SQL of the rows that an array of cells (``_level``, ``_cx``, ``_cy``) becomes: of the row's ``_edges`` each cell
    keeps those whose box touches it; cells outside are dropped.

    A ray from a point of the cell to the right crosses an edge wholly right of the cell if exactly one of its ends
    lies above the point. So of those edges only the heights of their ends count, and a height that two
    of them share counts for nothing: of a border that runs on to the right only the ends of its run are left.
    Heights above the cell turn ``_odd``, heights below do nothing, heights within stay in ``_heights``."""
    near = """filter(_edges, e -> floor(least(e.y1, e.y2) * c.s) <= c.cell._cy and floor(greatest(e.y1, e.y2) * c.s) >= c.cell._cy
              and floor(greatest(e.x1, e.x2) * c.s) >= c.cell._cx)"""
    right = "floor(least(e.x1, e.x2) * c.s) > c.cell._cx"
    ends = "concat(_heights, transform(passed, e -> e.y1), transform(passed, e -> e.y2))"
    inner = "filter(ends, y -> y * c.s > c.cell._cy and y * c.s < c.cell._cy + 1)"
    kept = f"""named_struct('_level', c.cell._level, '_cx', c.cell._cx, '_cy', c.cell._cy,
        '_edges', filter(near, e -> not ({right})),
        '_odd', cast((_odd + size(filter(ends, y -> y * c.s >= c.cell._cy + 1))) % 2 as int),
        '_heights', {_UNPAIRED.format(inner)})"""
    kept = _bound(near, "near", _bound(f"filter(near, e -> {right})", "passed", _bound(ends, "ends", kept)))
    scaled = f"transform({cells}, k -> named_struct('cell', k, 's', pow(2D, k._level)))"
    return f"filter(transform({scaled}, c -> {kept}), c -> size(c._edges) > 0 or c._odd = 1)"


def cover(polygons: DataFrame, geometry: str = "geometria") -> DataFrame:
    """One row per polygon and cell: the polygon's other columns, ``_level``, ``_cx``, ``_cy``, the edges that touch
    the cell, and what lies to the right of it: ``_odd`` (whether every ray crosses an odd number of edges there) and
    ``_heights`` (at each of which that turns)."""
    others = [f"`{c}`" for c in polygons.columns if c != geometry]
    ends = [f"cast(floor(_box.{axis}_{end} * pow(2D, _level)) as bigint)" for axis in "xy" for end in ("min", "max")]
    first = f"""flatten(transform(sequence({ends[0]}, {ends[1]}), x -> transform(sequence({ends[2]}, {ends[3]}), y ->
        named_struct('_level', _level, '_cx', x, '_cy', y))))"""
    rows = _levels(polygons, geometry).selectExpr("*", "0 as _odd", "cast(array() as array<double>) as _heights")
    rows = rows.selectExpr(*others, "_rounds", f"inline({_clipped(first)})")
    side = 1 << DOWN
    parts = f"""transform(sequence(0, {side * side - 1}), k ->
        named_struct('_level', _level + {DOWN}, '_cx', _cx * {side} + k % {side}, '_cy', _cy * {side} + k div {side}))"""
    whole = "array(named_struct('_level', _level, '_cx', _cx, '_cy', _cy, '_edges', _edges, '_odd', _odd, '_heights', _heights))"
    for round_ in range(ROUNDS):
        split = f"size(_edges) > {EDGES} and _rounds > {round_}"
        rows = rows.selectExpr(*others, "_rounds", f"inline(case when {split} then {_clipped(parts)} else {whole} end)")
        if round_ == 0:
            # A polygon of very many edges is split further by all tasks.
            rows = rows.repartition("_level", "_cx", "_cy")
    return rows.drop("_rounds")


def within(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", geometry: str = "geometria") -> DataFrame:
    """Inner join of points with the polygons they lie strictly inside of.

    The equi-join is on level and cell, the exact test its residual condition. A point is repeated once per level
    there is. Whether cells are broadcast is left to the planner; where both sides are shuffled AQE splits hot cells."""
    levels = _levels(polygons, geometry).select(
        F.explode(F.sequence(F.col("_level"), F.col("_level") + F.col("_rounds") * DOWN, F.lit(DOWN))).alias("_of")
    )
    levels = levels.agg(F.sort_array(F.collect_set("_of")).alias("levels")).scalar()
    located = points.withColumn("_pl", F.explode(levels))
    located = located.withColumn("_px", _cell(F.col(x), F.col("_pl"))).withColumn("_py", _cell(F.col(y), F.col("_pl")))
    beyond = (F.col("_odd") + F.size(F.filter("_heights", lambda v: v > F.col(y)))) % 2
    matches = (
        (F.col("_pl") == F.col("_level")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
        & geo.inside(F.col("_edges"), F.col(x), F.col(y), beyond)
    )
    return located.join(cover(polygons, geometry), matches, "inner").drop("_pl", "_px", "_py", "_level", "_cx", "_cy", "_edges", "_odd", "_heights")
