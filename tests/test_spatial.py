import math
import random

import pytest
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import geometry as geo
from comarca.operators import coverage as cov
from comarca.operators import quadtree
from comarca.operators.spatial import cell_size, grid_join, intersects_box, polygon_cells, within_join
from comarca.plans import network
from comarca.sources.shapes import read_shapes

SQUARE = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]]
HOLED = [[SQUARE[0][0], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]]]
TWO_PARTS = [[[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 0.0)]], [[(10.0, 0.0), (12.0, 0.0), (11.0, 2.0), (10.0, 0.0)]]]
FLAT = [[[(0.0, 0.0), (2.0, 0.0), (0.0, 0.0)]]]


def shapes(spark, items, extra=()):
    rows = [
        (key, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in shape], *more)
        for (key, shape), more in zip(items, extra or [()] * len(items))
    ]
    names = ", CVE_ENT string, CVEGEO string, NOMGEO string" if extra else ""
    return spark.createDataFrame(rows, f"k int, geometria {geo.GEOMETRY}{names}")


def brute_inside(shape, x, y):
    odd = False
    for part in shape:
        for ring in part:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
                if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return False
                if (y1 > y) != (y2 > y) and ((turn > 0) == (y2 > y1)):
                    odd = not odd
    return odd


def test_area_centroid_bounds(spark):
    df = shapes(spark, [(1, SQUARE), (2, HOLED), (3, TWO_PARTS), (4, FLAT)])
    got = {
        r.k: (r.a, round(r.c.x, 9), round(r.c.y, 9), tuple(r.b))
        for r in df.select("k", geo.area(F.col("geometria")).alias("a"), geo.centroid(F.col("geometria")).alias("c"), geo.bounds(F.col("geometria")).alias("b")).collect()
    }
    assert got[1] == (16.0, 2.0, 2.0, (0.0, 0.0, 4.0, 4.0))
    assert got[2][:3] == (12.0, 2.0, 2.0)
    assert got[3][:3] == (18.0, round((6 * 16 + 11 * 2) / 18, 9), round((2 * 16 + 2 / 3 * 2) / 18, 9))
    assert got[4][:3] == (0.0, 1.0, 0.0)


def test_centroid_columns_equal_the_general_centroid(spark):
    rnd = random.Random(2)
    rings = []
    for n in (3, 4, 6, 8, 9, 14):
        ring = [(-100 + math.cos(2 * math.pi * i / n) * rnd.uniform(0.001, 0.004), 20 + math.sin(2 * math.pi * i / n) * rnd.uniform(0.001, 0.004)) for i in range(n)]
        rings += [ring + ring[:1], (ring + ring[:1])[::-1]]
    df = shapes(spark, [(k, [[ring]]) for k, ring in enumerate(rings)] + [(90, HOLED), (91, TWO_PARTS), (92, FLAT)])
    both = cov.with_centroid(df).withColumn("c", geo.centroid(F.col("geometria"))).collect()
    assert len(both) == 15 and both[0].asDict().keys() == {"k", "geometria", "x", "y", "c"}
    assert all(abs(r.x - r.c.x) < 1e-12 and abs(r.y - r.c.y) < 1e-12 for r in both)


def test_within_leaves_the_boundary_out(spark):
    polygons = [(1, SQUARE), (2, HOLED), (3, TWO_PARTS)]
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-1, 26) for y in range(-1, 10))]
    joined = within_join(spark.createDataFrame(points, "i int, x double, y double"), shapes(spark, polygons))
    got = {(r.i, r.k) for r in joined.select("i", "k").collect()}
    assert got == {(i, k) for i, x, y in points for k, shape in polygons if brute_inside(shape, x, y)}
    assert got


@pytest.mark.parametrize("step", [None, 0.3, 7.0])
def test_grid_join_equals_testing_every_pair(spark, step):
    rnd = random.Random(5)
    polygons = []
    for k in range(40):
        x, y, n = rnd.uniform(-110, -90), rnd.uniform(15, 30), rnd.randrange(3, 20)
        r = rnd.choice([0.05, 0.3, 1.0, 8.0])
        ring = [(x + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        polygons.append((k, [[ring + ring[:1]]]))
    # a third of the points crowd one spot
    points = [(i, rnd.uniform(-112, -88), rnd.uniform(13, 32)) for i in range(800)]
    points += [(1000 + i, -100 + rnd.uniform(0, 0.01), 22 + rnd.uniform(0, 0.01)) for i in range(400)]
    joined = within_join(spark.createDataFrame(points, "i int, x double, y double"), shapes(spark, polygons), step=step)
    got = sorted((r.i, r.k) for r in joined.select("i", "k").collect())
    assert got == sorted((i, k) for i, x, y in points for k, shape in polygons if brute_inside(shape, x, y))


def test_cells_stay_in_proportion(spark):
    """One polygon a thousand times wider than the rest does not blow up the number of cells."""
    polygons = [(k, [[[(k, 0.0), (k + 0.5, 0.0), (k + 0.5, 0.5), (k, 0.0)]]]) for k in range(100)]
    polygons.append((999, [[[(0.0, 0.0), (1000.0, 0.0), (1000.0, 0.25), (0.0, 0.0)]]]))
    df = shapes(spark, [(k, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in s]) for k, s in polygons])
    assert polygon_cells(df, cell_size(df)).count() <= 36 * len(polygons)


def test_box_touches(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x_min", "y_min", "x_max", "y_max"))])
    limits = (0.0, 0.0, 1.0, 1.0)
    row = spark.range(1).select(
        intersects_box(box(1, 1, 2, 2), limits), intersects_box(box(-1, -1, 2, 2), limits), intersects_box(box(1.1, 0, 2, 1), limits)
    ).first()
    assert tuple(row) == (True, True, False)


def test_projection_is_equal_to_known_values(spark):
    """On the central meridian x is the false easting; a small square has the area of the ellipsoid there."""
    x, y = geo.lambert(F.lit(-102.0), F.lit(12.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - 2500000.0) < 1e-6 and abs(row.y) < 1e-6
    d = 0.01
    corners = [(-102 - d, 17.5 - d), (-102 + d, 17.5 - d), (-102 + d, 17.5 + d), (-102 - d, 17.5 + d), (-102 - d, 17.5 - d)]
    km2 = shapes(spark, [(1, [[corners]])]).select(geo.area_km2(F.col("geometria"))).first()[0]
    e2 = 2 / 298.257222101 - 1 / 298.257222101**2
    lat = math.radians(17.5)
    w = math.sqrt(1 - e2 * math.sin(lat) ** 2)
    meridian, parallel = 6378137 * (1 - e2) / w**3, 6378137 * math.cos(lat) / w
    expected = math.radians(2 * d) ** 2 * meridian * parallel / 1e6
    assert abs(km2 / expected - 1) < 1e-4


def speed_rows(spark, rows):
    df = spark.createDataFrame(rows, "CVE_ENT string, CVEGEO string, NOMGEO string, avg_d_kbps double, tests long, geometria string")
    return cov.with_technology(df)


def test_roll_ups(spark):
    tiles = speed_rows(spark, [
        ("01", "M1", "m1", 5000.0, 3, "g"), ("01", "M1", "m1", 20000.0, 4, "g"), ("01", "M2", "m2", 50000.0, 1, None),
        ("01", None, "m3", 1.0, 1, "g"),
    ])
    towns = cov.by_municipality(tiles)
    got = {r.id_cvegeo: r for r in towns.collect()}
    assert set(got) == {"M1", "M2"}
    m1, m2 = got["M1"], got["M2"]
    assert (m1.int_avg_speed, m1.int_tech_predominante, m1.geometry, m1.tests) == (12.5, "3G", 2, 7)
    assert (m1.int_pct_3g_coverage, m1.int_pct_4g_coverage, m1.int_pct_5g_coverage) == (50.0, 50.0, 0.0)
    assert (m2.int_avg_speed, m2.int_tech_predominante, m2.geometry, m2.int_pct_5g_coverage) == (50.0, "5G", 0, 100.0)
    state = cov.by_state(towns).first()
    assert (state.int_avg_speed, state.int_tech_predominante) == (31.25, "3G")
    assert (state.int_pct_3g_coverage, state.int_pct_4g_coverage, state.int_pct_5g_coverage) == (25.0, 25.0, 50.0)


def test_missing_speed_counts_as_fastest_class(spark):
    tiles = speed_rows(spark, [("01", "M", "m", float("nan"), 1, "g"), ("01", "M", "m", None, None, "g"), ("01", "M", "m", 7000.0, 2, "g")])
    row = cov.by_municipality(tiles).first()
    assert (row.int_avg_speed, row.int_tech_predominante, row.tests) == (7.0, "5G", 3)


def test_most_frequent_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "z"), ("a", "b"), ("b", None), ("b", "q")], "k string, v string")
    assert {r.k: r.v for r in cov.most_frequent(df, ["k"], "v").collect()} == {"a": "b", "b": "q"}


def test_tiles_to_states(spark):
    towns = shapes(spark, [(1, SQUARE), (2, TWO_PARTS)], [("01", "M1", "uno"), ("02", "M2", "dos")])

    def tile(x, y, d=0.25):
        return [[[{"x": x + i * d, "y": y + j * d} for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]]

    # the third tile straddles the border: its centroid decides, and on the border it is nowhere
    tiles = spark.createDataFrame(
        [(tile(1.0, 1.0), 5000.0, 1), (tile(3.9, 2.0), 20000.0, 2), (tile(4.0, 2.0), 1.0, 5), (tile(4.1, 2.0), 45000.0, 3), (tile(50.0, 50.0), 1.0, 9)],
        f"geometria {geo.GEOMETRY}, avg_d_kbps double, tests long",
    )
    classified = network.classified_tiles(tiles, towns, (-1.0, -1.0, 20.0, 20.0))
    got = sorted((r.CVEGEO, r.tech_proxy, r.geometria[0][0][0].x) for r in classified.collect())
    assert got == [("M1", "3G", 0.75), ("M1", "4G", 3.65), ("M2", "5G", 3.8499999999999996)]


def test_publish_coverage_writes_layers_and_roll_ups(spark, tmp_path):
    west, south = -100.0, 20.0

    def square(x, y, d):
        return [[[(west + x + i * d, south + y + j * d) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]]

    towns = shapes(spark, [(1, square(1, 1, 1)), (2, square(3, 1, 1))], [("01", "M1", "uno"), ("01", "M2", "dos")])
    tiles = spark.createDataFrame(
        [([[[{"x": x, "y": y} for x, y in square(*at)[0][0]]]], kbps, n) for at, kbps, n in (
            ((1, 1, 0.25), 5000.0, 1), ((1.5, 1, 0.25), 15000.0, 2), ((3, 1, 0.25), 45000.0, 4))],
        f"geometria {geo.GEOMETRY}, avg_d_kbps double, tests long",
    )
    network.publish_coverage(tiles, towns, str(tmp_path))
    towns_out = {r.id_cvegeo: (r.int_avg_speed, r.tests, r.int_pct_5g_coverage) for r in spark.read.json(str(tmp_path / "municipios")).collect()}
    assert towns_out == {"M1": (10.0, 3, 0.0), "M2": (45.0, 4, 100.0)}
    (state,) = spark.read.json(str(tmp_path / "estados")).collect()
    assert state.int_pct_5g_coverage == 50.0
    layer = read_shapes(spark, str(tmp_path / "geojson"), {"tech_proxy": "string", "avg_d_mbps": "double"}, lines=True)
    assert sorted((r.tech_proxy, r.avg_d_mbps) for r in layer.collect()) == [("3G", 5.0), ("4G", 15.0), ("5G", 45.0)]


def test_coverage_shares_add_up(spark):
    rnd = random.Random(1)
    tiles = speed_rows(spark, [(f"{rnd.randrange(3):02d}", f"M{rnd.randrange(12)}", "x", rnd.uniform(0, 80000), 1, "g") for _ in range(500)])
    for row in cov.by_state(cov.by_municipality(tiles)).collect():
        assert abs(row.int_pct_3g_coverage + row.int_pct_4g_coverage + row.int_pct_5g_coverage - 100) < 1e-9


def test_stored_boxes_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = spark.range(10).select(
        *[F.col("id").cast("double").alias(n) for n in cov.BOX_COLUMNS], F.lit(None).cast(geo.GEOMETRY).alias("geometria")
    )
    rows.write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = cov.tiles_in_box(spark.read.parquet(path), fixed.COVERAGE_BOX)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x_max" in plan and "LessThanOrEqual(y_min" in plan


def test_cells_are_measured_before_the_join(spark):
    """Few polygons with many corners: the planner would guess small."""
    corners = 4000
    ring = [(math.cos(2 * math.pi * i / corners), math.sin(2 * math.pi * i / corners)) for i in range(corners)]
    polygons = shapes(spark, [(k, [[ring + ring[:1]]]) for k in range(3)])
    points = spark.range(2000).select("id", (F.rand(1) * 2 - 1).alias("x"), (F.rand(2) * 2 - 1).alias("y"))
    large, small = grid_join(points, polygons, broadcast_bytes=200_000), grid_join(points, polygons)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (large, small)]
    assert ["SortMergeJoin" in plan for plan in plans] == [True, False]
    assert ["BroadcastHashJoin" in plan for plan in plans] == [False, True]
    assert sorted(map(tuple, large.select("id", "k").collect())) == sorted(map(tuple, small.select("id", "k").collect()))


def _star(rnd, x, y, r, n):
    ring = [(x + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [[ring + ring[:1]]]


def test_cells_of_many_sizes_equal_testing_every_pair(spark):
    rnd = random.Random(11)
    polygons = [(k, _star(rnd, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0.01, 0.3, 2.0]), rnd.randrange(3, 30))) for k in range(40)]
    polygons += [(100, _star(rnd, 0.5, 0.25, 300.0, 900)), (101, _star(rnd, 3, 3, 40.0, 200)), (102, HOLED), (103, TWO_PARTS), (104, FLAT)]
    points = [(i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(500)] + [(1000 + i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-1, 26) for y in range(-1, 10))]
    for k, shape in polygons[:40]:
        points += [(2000 + k, *shape[0][0][0]), (3000 + k, sum(x for x, _ in shape[0][0][:-1]) / (len(shape[0][0]) - 1), sum(y for _, y in shape[0][0][:-1]) / (len(shape[0][0]) - 1))]
    joined = within_join(spark.createDataFrame(points, "i int, x double, y double"), shapes(spark, polygons))
    got = sorted((r.i, r.k) for r in joined.select("i", "k").collect())
    assert got == sorted((i, k) for i, x, y in points for k, shape in polygons if brute_inside(shape, x, y))
    assert joined.columns == ["i", "x", "y", "k"]


def test_a_large_polygon_costs_its_border(spark):
    """A thousand times the size of the others and ten thousand edges: few rows, few edges in each."""
    rnd = random.Random(3)
    small = [(k, _star(rnd, 3.0 * k, 1.0, 0.5, 6)) for k in range(100)]
    large = [(999, [[[(500 + 500 * math.cos(2 * math.pi * i / 10000), 500 * math.sin(2 * math.pi * i / 10000)) for i in range(10000)] + [(1000.0, 0.0)]]])]
    cells = {k: quadtree.cover(shapes(spark, p)).agg(F.count("*"), F.max(F.size("_edges")), F.sum(F.size("_edges"))).first() for k, p in (("small", small), ("large", large))}
    assert cells["small"][0] <= 25 * len(small)
    assert cells["large"][0] <= 10000 and cells["large"][1] <= 100 and cells["large"][2] <= 12 * 10000
    plain = quadtree.cover(shapes(spark, [(1, [[[(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0), (0.0, 0.0)]]])])).collect()
    assert len(plain) <= 25 and any(not r["_edges"] for r in plain)


def test_no_job_runs_while_the_join_is_planned(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    points = spark.createDataFrame([(1, 0.5, 0.5)], "i int, x double, y double")
    joined = within_join(points, shapes(spark, [(1, SQUARE)]))
    joined._jdf.queryExecution().optimizedPlan()
    assert list(tracker.getJobIdsForGroup("planning")) == []
    assert [r.k for r in joined.collect()] == [1]
    assert within_join(points, shapes(spark, [(1, SQUARE)]).limit(0)).count() == 0
