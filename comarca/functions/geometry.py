"""Planar geometry on nested arrays: parts -> rings -> points, the first ring being the outer one.

Spark ships no spatial predicates, so these are compositions of array functions. They are
meant for the polygon side; only :func:`inside` runs per candidate point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from comarca import fixed_values as fixed

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(*corners: tuple[Column, Column]) -> Column:
    """A one-ring polygon from its corners; the ring is closed here."""
    ring = [point(x, y) for x, y in corners]
    return F.array(F.array(F.array(*ring, ring[0])))


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon coordinates (as JSON text) to the nested arrays."""

    def ring_points(rings: Column) -> Column:
        return F.transform(rings, lambda ring: F.transform(ring, lambda xy: point(xy[0], xy[1])))

    single = F.array(ring_points(F.from_json(coordinates, "array<array<array<double>>>")))
    many = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), ring_points)
    return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", many)


def to_geojson(geometry: Column) -> Column:
    """The geometry member of a GeoJSON feature: a Polygon if there is one part."""

    def numbers(rings: Column) -> Column:
        return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))

    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), numbers(geometry[0]).alias("coordinates")))
    many = F.to_json(
        F.struct(F.lit("MultiPolygon").alias("type"), F.transform(geometry, numbers).alias("coordinates"))
    )
    return F.when(F.size(geometry) == 1, single).otherwise(many)


def bounds(geometry: Column) -> Column:
    points = F.flatten(F.flatten(geometry))
    return F.struct(
        F.array_min(points["x"]).alias("x_min"), F.array_min(points["y"]).alias("y_min"),
        F.array_max(points["x"]).alias("x_max"), F.array_max(points["y"]).alias("y_max"),
    )


def ring_edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def edges(geometry: Column) -> Column:
    """All edges of all rings; even-odd counting over them treats holes and parts alike."""
    return F.flatten(F.transform(F.flatten(geometry), ring_edges))


def inside(edge_list: Column, x: Column, y: Column, odd: Column | None = None) -> Column:
    """Strictly inside: an odd number of edges to the right, and on none of them.

    One pass with an integer state: 0 outside so far, 1 inside so far, 2 on the boundary. ``odd`` is the state
    to begin with, for edges to the right that aren't in the list.
    """

    def step(state: Column, e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        touches = (
            (turn == 0.0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )
        crosses = ((e["y1"] > y) != (e["y2"] > y)) & ((turn > 0.0) == (e["y2"] > e["y1"]))
        return (
            F.when((state == 2) | touches, F.lit(2))
            .when(crosses, F.lit(1) - state)
            .otherwise(state)
        )

    return F.aggregate(edge_list, F.lit(0) if odd is None else odd, step) == 1


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a variable."""
    return F.transform(F.array(value), use)[0]


def _ring_moments(ring: Column, origin: Column) -> Column:
    """Doubled signed area and its moments about ``origin`` (a vertex, which keeps digits)."""

    def step(sums: Column, e: Column) -> Column:
        x1, y1 = e["x1"] - origin["x"], e["y1"] - origin["y"]
        x2, y2 = e["x2"] - origin["x"], e["y2"] - origin["y"]
        turn = x1 * y2 - x2 * y1
        return _moments(sums["a"] + turn, sums["mx"] + (x1 + x2) * turn, sums["my"] + (y1 + y2) * turn)

    return F.aggregate(ring_edges(ring), _moments(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step)


def _moments(a: Column, mx: Column, my: Column) -> Column:
    return F.struct(a.alias("a"), mx.alias("mx"), my.alias("my"))


def _total_moments(geometry: Column, origin: Column) -> Column:
    """Moments over all rings, outer rings counting positive and holes negative."""

    def oriented(ring: Column, index: Column) -> Column:
        def signed(m: Column) -> Column:
            sign = F.signum(m["a"]) * F.when(index == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
            return _moments(m["a"] * sign, m["mx"] * sign, m["my"] * sign)

        return _bind(_ring_moments(ring, origin), signed)

    rings = F.flatten(F.transform(geometry, lambda part: F.transform(part, oriented)))
    return F.aggregate(
        rings,
        _moments(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        lambda sums, m: _moments(sums["a"] + m["a"], sums["mx"] + m["mx"], sums["my"] + m["my"]),
    )


def area(geometry: Column) -> Column:
    """Planar area, holes taken out."""
    return _bind(geometry, lambda g: _total_moments(g, g[0][0][0])["a"] / F.lit(2.0))


def _outline(geometry: Column) -> Column:
    """Length of all edges and its moments, in the fields of an area moment."""

    def step(sums: Column, e: Column) -> Column:
        length = F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
        return _moments(
            sums["a"] + length,
            sums["mx"] + length * (e["x1"] + e["x2"]) / 2.0,
            sums["my"] + length * (e["y1"] + e["y2"]) / 2.0,
        )

    return F.aggregate(edges(geometry), _moments(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step)


def centroid(geometry: Column) -> Column:
    """Area-weighted centroid; a polygon without area falls back to its length-weighted outline."""

    def of_shape(g: Column) -> Column:
        origin = g[0][0][0]

        def by_area(m: Column) -> Column:
            return point(origin["x"] + m["mx"] / (m["a"] * 3.0), origin["y"] + m["my"] / (m["a"] * 3.0))

        def by_length(m: Column) -> Column:
            return point(
                F.coalesce(F.try_divide(m["mx"], m["a"]), origin["x"]), F.coalesce(F.try_divide(m["my"], m["a"]), origin["y"])
            )

        return _bind(
            _total_moments(g, origin), lambda m: F.when(m["a"] != 0.0, by_area(m)).otherwise(_bind(_outline(g), by_length))
        )

    return _bind(geometry, of_shape)


def lambert(lon: Column, lat: Column, crs: dict[str, float] = fixed.LCC_MEXICO) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels, in closed form (Snyder 1987)."""
    flattening = 1.0 / crs["inverse_flattening"]
    e = math.sqrt(flattening * (2.0 - flattening))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1.0 - (e * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)

    first, second, zero = (math.radians(crs[k]) for k in ("latitude_1", "latitude_2", "latitude_0"))
    n = (math.log(m(first)) - math.log(m(second))) / (math.log(t(first)) - math.log(t(second)))
    reach = crs["semi_major"] * m(first) / (n * t(first) ** n)
    top = reach * t(zero) ** n

    phi = F.radians(lat)
    eccentric = F.sin(phi) * F.lit(e)
    conformal = F.tan(F.lit(math.pi / 4) - phi / 2.0) / F.pow((1.0 - eccentric) / (1.0 + eccentric), F.lit(e / 2))
    radius = F.lit(reach) * F.pow(conformal, F.lit(n))
    angle = F.lit(n) * F.radians(lon - F.lit(crs["longitude_0"]))
    return (
        F.lit(crs["false_easting"]) + radius * F.sin(angle),
        F.lit(crs["false_northing"] + top) - radius * F.cos(angle),
    )


def projected(geometry: Column) -> Column:
    """Longitude and latitude to metres."""

    def move(p: Column) -> Column:
        x, y = lambert(p["x"], p["y"])
        return point(x, y)

    return F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, move)))


def area_km2(geometry: Column) -> Column:
    return area(projected(geometry)) / 1e6
