"""Versions, running totals, the catalog log and stored layouts."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from comarca.operators import catalog as cat
from comarca.operators import coverage as cov
from comarca.operators import estimators as est
from comarca.operators import observations, quality
from comarca.operators.running_totals import RunningTotals
from comarca.sinks import catalog_log, layouts, versions
from comarca.specs import Share, locality_shares

SPECS = [Share("v", "c", "l", "%", "t", column="a", positive_values=("1",)), Share("w", "c", "l", "%", "t", column="a", positive_values=("1", "2"))]


def test_versions_are_put_in_place_once(spark, tmp_path):
    log = versions.Versions(spark, str(tmp_path))
    assert (log.number(), log.read()) == (0, {})
    assert log.commit({"a": "ñ"}, 0) == 1 and log.read() == {"a": "ñ"}
    with pytest.raises(versions.Conflict):
        versions.Versions(spark, str(tmp_path)).commit({"a": 2}, 0)
    assert log.read() == {"a": "ñ"} and log.change(lambda content: {**content, "b": 1}) == 2
    assert log.read() == {"a": "ñ", "b": 1} and log.read(1) == {"a": "ñ"} and log.change(lambda _: None) == 2


def test_concurrent_changes_are_all_kept(spark, tmp_path):
    def add(k):
        versions.Versions(spark, str(tmp_path)).change(lambda content: {"seen": [*content.get("seen", []), k]}, tries=200)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(versions.Versions(spark, str(tmp_path)).read()["seen"]) == list(range(6))


def test_a_failed_publication_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    write = lambda n: lambda path: spark.range(n).write.parquet(path)

    def fails(path):
        raise OSError("no space")

    versions.publish_together(spark, folder, {"long": write(3), "wide": write(2)})
    before = {name: versions.published(spark, folder, name) for name in ("long", "wide")}
    with pytest.raises(OSError):
        versions.publish_together(spark, folder, {"long": write(9), "wide": fails})
    assert {name: versions.published(spark, folder, name) for name in ("long", "wide")} == before
    assert spark.read.parquet(before["long"]).count() == 3
    versions.publish_together(spark, folder, {"long": write(9), "wide": write(8)})
    assert [spark.read.parquet(versions.published(spark, folder, name)).count() for name in ("long", "wide")] == [9, 8]


def _people(spark, seed, n=200):
    draw = random.Random(seed)
    rows = [(f"{draw.randrange(4):02d}", repr(draw.random() * 10 ** draw.randint(-8, 8)), draw.choice("123"), draw.choice((2023, 2024))) for _ in range(n)]
    return spark.createDataFrame([*rows, ("", "1", "1", 2024), ("01", None, "1", 2024)], "k string, w string, a string, y int")


def test_batches_add_up_to_one_pass(spark, tmp_path):
    parts = [_people(spark, seed) for seed in range(3)]
    totals = RunningTotals(spark, str(tmp_path), SPECS)
    assert [totals.add(f"b{i}", parts[i], "k", "w", "y") for i in (0, 1, 0, 2, 1)] == [True, True, False, True, False]
    whole = parts[0].union(parts[1]).union(parts[2])
    for year in (2023, 2024):
        expected = sorted(est.weighted_shares(whole.where(F.col("y") == year), SPECS, "k", "w").collect())
        assert sorted(totals.shares(year).collect()) == expected and expected
    totals.compact()
    assert len(totals.versions.read()["folders"]) == 1 and totals.batches() == ["b0", "b1", "b2"]
    assert not totals.add("b2", parts[2], "k", "w", "y")
    assert sorted(totals.shares(2024).collect()) == expected
    units = spark.createDataFrame([("00", "x"), ("01", "x"), ("02", "y")], "unit string, cve_ent string")
    one = est.weighted_shares(whole.where("y = 2024"), SPECS, "k", "w", entity_of=units)
    assert sorted(totals.shares(2024, units).collect()) == sorted(one.collect())
    with pytest.raises(ValueError, match="other metrics"):
        RunningTotals(spark, str(tmp_path), SPECS[:1]).add("b9", parts[0], "k", "w", "y")


def test_a_batch_reads_only_its_own_persons(spark, tmp_path):
    """A batch that fails leaves nothing; sent again it counts once. Empty totals have no shares."""
    totals = RunningTotals(spark, str(tmp_path), SPECS)
    assert totals.shares(2024).count() == 0 and totals.batches() == []
    bad = spark.createDataFrame([("01", "doce", "1", 2024)], "k string, w string, a string, y int")
    with pytest.raises(Exception, match="doce"):
        totals.add("b0", bad, "k", "w", "y")
    assert totals.batches() == []
    assert totals.add("b0", bad.withColumn("w", F.lit("12")), "k", "w", "y")
    assert [tuple(r) for r in totals.shares(2024).collect()] == [("01", 100.0, 100.0)]


def _specs(spark, names, categories):
    rows = [(i, n, c, n.title(), "%", 2024, "", []) for i, (n, c) in enumerate(zip(names, categories, strict=True))]
    return spark.createDataFrame(rows, "posicion bigint, variable string, categoria string, label string, unidad string, anio int, fuente_sugerida string, sinonimos array<string>")


def _additions(spark, specs):
    meta = spark.createDataFrame([], "variable string, fuente_sugerida string, sinonimos array<string>")
    defaults = spark.createDataFrame([], "categoria_id string, nombre string, descripcion string")
    return lambda categories, variables: (cat.new_categories(categories, specs, defaults), cat.new_variables(variables, specs, meta))


def test_two_synchronisations_at_once_lose_no_row(spark, tmp_path):
    folder = str(tmp_path)
    one, two = _specs(spark, ["a", "b", "c"], ["x", "x", "y"]), _specs(spark, ["c", "d", "a"], ["y", "z", "x"])
    barrier, first = threading.Barrier(2), threading.local()

    def sync(specs, date):
        def additions(categories, variables):
            if not getattr(first, "over", False):
                first.over = True
                barrier.wait(60)  # both have read the same version
            return _additions(spark, specs)(categories, variables)

        catalog_log.append_catalog(spark, folder, additions, date)

    threads = [threading.Thread(target=sync, args=x) for x in ((one, "2026-01-01"), (two, "2026-01-02"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    categories, variables, updated = catalog_log.read_catalog_log(spark, folder)
    assert sorted(r.variable_id for r in variables.collect()) == ["a", "b", "c", "d"]
    assert sorted(r.categoria_id for r in categories.collect()) == ["x", "y", "z"] and updated in ("2026-01-01", "2026-01-02")
    assert len({r.posicion for r in variables.collect()}) == 4
    number = versions.Versions(spark, folder).number()
    assert number == 2 and catalog_log.append_catalog(spark, folder, _additions(spark, one), "2027-01-01") == 2
    assert catalog_log.read_catalog_log(spark, folder)[2] == updated


def test_stored_tables_meet_without_a_shuffle(spark, tmp_path):
    specs = [s for s in locality_shares() if s.column == "MOVIL"]
    rows = [(f" {i % 50:03d}", "2024" if i % 3 else " 2023", "Sí" if i % 4 else "No") for i in range(600)]
    facts = spark.createDataFrame(rows, "CVEGEO string, ANIO string, MOVIL string")
    places = spark.createDataFrame([(f"{i:03d}", str(i % 5), str(i * 1.1), "3", i) for i in range(60)], "CVEGEO string, ENT string, POBLACION string, TOTHOG string, ID int")
    last = est.latest_localities(places)
    stored = layouts.store_connectivity(facts, "stored_facts", f"{tmp_path}/facts", 4), layouts.store_localities(last, "stored_places", f"{tmp_path}/places", 4)
    try:
        shares = est.locality_shares(*stored, specs, 2024, "cvegeo", "anio", clean=True)
        assert sorted(shares.collect()) == sorted(est.locality_shares(facts, last, specs, 2024).collect())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = est.locality_shares(*stored, specs, 2024, "cvegeo", "anio", clean=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("stored_facts", "stored_places"):
            spark.sql(f"drop table {name}")
    join = plan[plan.index("SortMergeJoin") :]
    assert "Exchange" not in join and "PartitionFilters: [isnotnull(anio" in join and "SelectedBucketsCount: 4 out of 4" in join


def _scanned(df):
    """Rows that the scan of a plan gave."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    for _ in range(50):
        metrics = node.metrics()
        if node.nodeName().startswith("Scan") and metrics.contains("numOutputRows"):
            return metrics.apply("numOutputRows").value()
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.children().apply(0)
    raise AssertionError("no scan")


def test_a_small_box_reads_few_row_groups(spark, tmp_path):
    n = 40_000
    tiles = spark.range(n).select("id", (F.rand(1) * 30 - 118).alias("x_min"), (F.rand(2) * 20 + 14).alias("y_min"), F.lit("x" * 40).alias("filling"))
    tiles = tiles.withColumn("x_max", F.col("x_min") + 0.004).withColumn("y_max", F.col("y_min") + 0.004).withColumn("geometria", F.lit(None).cast("string")).cache()
    layouts.write_clustered_tiles(tiles.repartition(4), f"{tmp_path}/curve", row_group_bytes=1 << 16)
    tiles.repartition(4).write.option("parquet.block.size", 1 << 16).parquet(f"{tmp_path}/plain")
    box = (-103.0, 20.0, -101.0, 22.0)
    near, plain = (cov.tiles_in_box(spark.read.parquet(f"{tmp_path}/{kind}"), box).select("id") for kind in ("curve", "plain"))
    expected = sorted(r.id for r in cov.tiles_in_box(tiles, box).select("id").collect())
    assert sorted(r.id for r in near.collect()) == sorted(r.id for r in plain.collect()) == expected and expected
    assert _scanned(near) < n / 4 and _scanned(plain) == n
    tiles.unpersist()


def test_curve_keys_interleave_bits(spark):
    def plain(lon, lat):
        x, y = (max(0, min((1 << 20) - 1, int((v - low) // (span / (1 << 20))))) for v, low, span in ((lon, -180, 360), (lat, -90, 180)))
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(20))

    places = [(0.0, 0.0), (-180.0, -90.0), (180.0, 90.0), (-102.0, 23.5), (11.25, 45.0), (999.0, -999.0)]
    df = spark.createDataFrame(places, "x double, y double")
    assert [r[0] for r in df.select(layouts.curve_key(F.col("x"), F.col("y"))).collect()] == [plain(*p) for p in places]


def test_sparse_pivot_equals_the_listed_one(spark):
    draw = random.Random(5)
    rows = [(f"e{draw.randrange(4)}", f"v{draw.randrange(6)}", k // 2, draw.choice([None, 1.0, 2.5, -3.0])) for k in range(200)]
    rows += [("alone", "v1", 900, None), ("alone", None, 901, 4.0)]
    long = spark.createDataFrame(rows, "cve_ent string, variable string, secuencia bigint, valor double")
    names = [f"v{k}" for k in range(6)]
    listed = observations.pack_metrics(observations.pivot_metrics(long, names), names)
    expected = {r.cve_ent: r.metrics for r in listed.collect()}
    assert {r.cve_ent: r.metrics for r in observations.sparse_pivot(long).collect()} == expected and expected["alone"] == {}
    assert observations.sparse_pivot(long.limit(0)).count() == 0
    plain = observations.sparse_pivot(long.drop("secuencia")).first().metrics
    assert list(plain) == sorted(plain)


def test_sparse_pivot_of_thousands_of_variables_keeps_its_plan(spark):
    def pivot(n):
        return observations.sparse_pivot(spark.range(n).selectExpr("'e' as cve_ent", "concat('v', id) as variable", "cast(id as double) as valor"))

    few, many = (pivot(n) for n in (10, 5000))
    lengths = [len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) for df in (few, many)]
    assert lengths[0] == lengths[1] and len(many.first().metrics) == 5000


def test_profile_counted_while_writing_equals_the_one_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, " "), (None, "b"), (4, None)], "k bigint, name string").repartition(3)
    for n, df in enumerate((rows, rows.limit(0))):
        path = f"{tmp_path}/{n}"
        found = quality.write_profiled(df, "s", "s.csv", ("k", "name"), lambda x: x.write.parquet(path))
        assert found.collect() == quality.source_profile(spark.read.parquet(path), "s", "s.csv", ("k", "name")).collect()
    long = spark.createDataFrame([("%", 101.0), ("%", 100.0), ("km", 900.0), ("%", None)], "unidad string, valor double")
    found = quality.write_measured(long, quality.value_measures(long), lambda x: x.write.json(f"{tmp_path}/long"))
    assert found == {"records": 4, "null_values": 1, "out_of_range": 1}
