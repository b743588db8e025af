import math
import random

import pytest
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import exact
from comarca.operators import estimators as est
from comarca.operators import observations as obs
from comarca.specs import by_source_table, direct_values, locality_shares, survey_shares

INTERNET = [s for s in survey_shares() if s.variable == "personas_usuarias_internet_pct"]


def persons(spark, rows=None):
    rows = rows or [
        ("01", "100", "1"), ("01", "300", "2"), ("01", "100", ""), ("02", "50", " 1 "), ("02", "", "1"), ("", "70", "1"),
        ("99", "10", "1"), ("03", "200", "2"), (None, "5", "1"), ("03", None, "1"),
    ]
    return spark.createDataFrame(rows, "CVE_ENT string, FAC_PER string, P7_1 string")


def by_code(long):
    return {row.cve_ent: row.valor for row in long.collect()}


def test_weighted_share(spark, master):
    long = est.share_observations(est.weighted_shares(persons(spark), INTERNET), INTERNET, master, 2024, fixed.SURVEY_SOURCE)
    assert by_code(long) == {"01": 20.0, "02": 100.0, "03": 0.0}
    row = long.where("cve_ent = '01'").first()
    assert (row.state_code, row.estado, row.categoria, row.unidad, row.anio, row.fuente) == (
        "AGS", "Aguascalientes", "infraestructura_digital", "%", 2024, "INEGI ENDUTIH 2024",
    )


def test_missing_answer_column_is_all_negative(spark):
    shares = est.weighted_shares(persons(spark).drop("P7_1"), INTERNET)
    assert {r.cve_ent: r[1] for r in shares.collect()} == {"01": 0.0, "02": 0.0, "99": 0.0, "03": 0.0}


def test_zero_weight_entity_is_left_out(spark):
    shares = est.weighted_shares(persons(spark, [("01", "0", "1"), ("02", "1", "1")]), INTERNET)
    assert [r.cve_ent for r in shares.collect()] == ["02"]


def test_answers_are_stripped_and_whole(spark):
    """Longer answers are stripped before they are compared, codes of any type compare as text."""
    from comarca.specs import Share

    spec = Share("v", "c", "l", "%", "t", column="a", positive_values=("Sí", "Garantizada", "7"))
    answers = [" Sí", "Sí\t", "Garantizada  ", "Garantizad", "S", "sí", "7", "07", " 7 ", "77", "", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").orderBy("i")
    assert [r[0] for r in df.selectExpr(spec.holds(df)).collect()] == [
        (a or "").strip() in spec.positive_values for a in answers
    ]
    numbers = spark.createDataFrame([(7,), (8,), (None,)], "a int")
    assert [r[0] for r in numbers.selectExpr(spec.holds(numbers)).collect()] == [True, False, False]


def test_units_lead_to_entities(spark):
    units = spark.createDataFrame([("u1", "01"), ("u2", "01"), ("u3", "02")], "unit string, cve_ent string")
    rows = spark.createDataFrame([("u1", "1", "1"), ("u2", "3", "2"), ("u3", "5", "1"), ("u9", "5", "1")], "CVE_ENT string, FAC_PER string, P7_1 string")
    shares = est.weighted_shares(rows, INTERNET, entity_of=units)
    assert {r.cve_ent: r[1] for r in shares.collect()} == {"01": 25.0, "02": 100.0}


def localities(spark):
    return spark.createDataFrame(
        [
            ("010010001", "1", "100", "20", 1), ("010010002", "1", "", "", 2), ("010010002", "1", "300", "60", 3),
            ("020010001", "2", "0", "0", 4),
        ],
        "CVEGEO string, ENT string, POBLACION string, TOTHOG string, ID int",
    )


def facts(spark):
    return spark.createDataFrame(
        [
            ("010010001", "2024", "Sí"), ("010010002", "2024", "No"), ("020010001", " 2024", "Sí"), ("099999999", "2024", "Sí"),
            ("010010001", "2023", "Sí"), ("010010001", "2024.0", "Sí"),
        ],
        "CVEGEO string, ANIO string, MOVIL string",
    )


def test_locality_share(spark, master):
    specs = [s for s in locality_shares() if s.column == "MOVIL"]
    shares = est.locality_shares(facts(spark), est.latest_localities(localities(spark)), specs)
    long = est.share_observations(shares, specs, master, 2024, fixed.LOCALITY_SOURCE)
    got = {(r.cve_ent, r.variable): r.valor for r in long.collect()}
    assert got == {
        ("01", "localidades_con_cobertura_movil_pct"): 50.0,
        ("02", "localidades_con_cobertura_movil_pct"): 100.0,
        ("01", "poblacion_en_localidades_con_cobertura_movil_pct"): 25.0,
    }


def test_hot_locality_counts_every_fact(spark):
    """One locality with far more facts than all others: same result as counting row by row."""
    specs = [s for s in locality_shares() if s.column == "MOVIL"]
    hot = spark.range(20000).select(
        F.lit("010010001").alias("CVEGEO"), F.lit("2024").alias("ANIO"), F.when(F.col("id") < 5000, "Sí").otherwise("No").alias("MOVIL")
    )
    shares = est.locality_shares(hot.unionByName(facts(spark)), est.latest_localities(localities(spark)), specs)
    row = {r.cve_ent: r for r in shares.collect()}["01"]
    assert row.localidades_con_cobertura_movil_pct == 5001 / 20002 * 100
    assert row.poblacion_en_localidades_con_cobertura_movil_pct == 500100 / (20001 * 100 + 300) * 100


def test_direct_values(spark, master):
    (spec,) = direct_values()
    rows = spark.createDataFrame(
        [("2024", "6", "1", " 101.125"), ("2024", "12", "01", "104.5"), ("2023", "12", "1", "90"), ("2024", "12", "77", "1")],
        "ANIO string, MES string, K_ENTIDAD string, T_INTMOVIL_ITE_VA string",
    )
    long = est.direct_observations(rows, spec, master)
    assert sorted((r.cve_ent, r.valor, r.secuencia) for r in long.collect()) == [("01", 101.125, 6), ("01", 104.5, 12)]
    wide = obs.wide_records(long, master, [spec.variable], 2024).collect()
    assert [(r.cve_ent, r.region, r.anio, r.metrics) for r in wide] == [("01", "Bajio", 2024, {spec.variable: 104.5})]


def test_declared_metrics():
    assert (len(survey_shares()), len(direct_values()), len(locality_shares())) == (13, 1, 8)
    assert {table: len(specs) for table, specs in by_source_table(survey_shares()).items()} == {"usuarios": 7, "usuarios2": 6}


def test_wide_and_long_are_inverse(spark, master):
    shares = est.weighted_shares(persons(spark), INTERNET)
    long = est.share_observations(shares, INTERNET, master, 2024, "f").drop("secuencia")
    wide = obs.wide_records(long, master, [INTERNET[0].variable])
    assert "anio" not in wide.columns
    back = {(r.cve_ent, r.variable, r.valor) for r in obs.long_from_wide(wide).collect()}
    assert back == {(r.cve_ent, r.variable, r.valor) for r in long.collect()}


def test_repeated_codes_keep_the_last(spark):
    from comarca.operators.lookups import last_by_key

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "k string, o int, v string")
    assert {r.k: r.v for r in last_by_key(rows, "k", "o").collect()} == {"a": "z", "b": "w"}


def test_plan_aggregates_before_it_joins(spark):
    specs = [s for s in locality_shares()]
    shares = est.locality_shares(facts(spark), est.latest_localities(localities(spark)), specs)
    plan = shares._jdf.queryExecution().optimizedPlan().toString()
    join, below = plan.split("Join Inner", 1)
    assert below.count("Aggregate") == 2 and "CartesianProduct" not in plan


def _share_spec():
    from comarca.specs import Share

    return [Share("v", "c", "l", "%", "t", column="P7_1", positive_values=("1",))]


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e12, 1e-200, 1e200])
def test_sums_of_any_doubles_are_exact(spark, scale):
    """Weights of any size give what exactly rounded sums give, however the rows are dealt out."""
    draw = random.Random(5)
    rows = [(f"{i % 3}", draw.choice([0.1, 0.2, 0.3, draw.random(), draw.random() * 10 ** draw.randint(-12, 12)]) * scale, draw.choice("12")) for i in range(600)]
    rows += [("0", -0.25 * scale, "1"), ("1", 0.0, "1")]
    expected = {}
    for key in "012":
        whole = math.fsum(w for k, w, _ in rows if k == key)
        expected[key] = math.fsum(w for k, w, a in rows if k == key and a == "1") / whole * 100
    persons = spark.createDataFrame([(k, repr(w), a) for k, w, a in rows], "CVE_ENT string, FAC_PER string, P7_1 string")
    for parts in (1, 3, 16):
        found = est.weighted_shares(persons.repartition(parts), _share_spec())
        assert {r.cve_ent: r.v for r in found.collect()} == expected


def test_ordinary_doubles_are_weights(spark):
    rows = [("01", repr(0.1 + 0.2), "1"), ("01", "0.5", "2"), ("02", "0.00000004", "1"), ("02", "0.00000006", "2"), ("03", "4.0000004", "1"), ("03", "6", "2")]
    found = est.weighted_shares(persons(spark, rows), _share_spec())
    assert {r.cve_ent: r.v for r in found.collect()} == {
        "01": (0.1 + 0.2) / math.fsum([0.1 + 0.2, 0.5]) * 100, "02": 0.00000004 / math.fsum([0.00000004, 0.00000006]) * 100, "03": 4.0000004 / math.fsum([4.0000004, 6.0]) * 100,
    }
    with pytest.raises(Exception, match="not a finite number"):
        est.weighted_shares(persons(spark, [("01", "Infinity", "1")]), _share_spec()).collect()


def test_locality_weights_keep_all_digits(spark):
    specs = [s for s in locality_shares() if s.column == "MOVIL"]
    facts = spark.createDataFrame([("a", "2024", "Sí"), ("b", "2024", "No"), ("c", "2024", "Sí"), ("d", "2024", "No")], "CVEGEO string, ANIO string, MOVIL string")
    for weights, expected in [(("0.00000004", "0.00000006"), 40.0), (("4.0000004", "6"), 4.0000004 / 10.0000004 * 100), ((repr(0.1 + 0.2), "0.5"), (0.1 + 0.2) / 0.8 * 100)]:
        rows = [(k, "1", w, "0", i) for i, (k, w) in enumerate(zip("ab", weights, strict=True))]
        places = spark.createDataFrame(rows, "CVEGEO string, ENT string, POBLACION string, TOTHOG string, ID int")
        (row,) = est.locality_shares(facts, est.latest_localities(places), specs).collect()
        assert row.poblacion_en_localidades_con_cobertura_movil_pct == pytest.approx(expected, rel=1e-15)


def test_exact_total_rounds_like_fsum(spark):
    draw = random.Random(1)
    tiny = [1.0, 2**-53, -(2**-53), 2**-54, 2**-106, -(2**-106), 1 + 2**-52, 1e16, -1e16, 5e-324, 1e308]
    rows = [(k, [draw.choice(tiny) if k % 2 else draw.uniform(-1, 1) * 10 ** draw.randint(-30, 30) for _ in range(draw.randint(0, 12))]) for k in range(300)]
    rows = [(k, v) for k, v in rows if sum(1 for x in v if x == 1e308) < 2]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    assert {r.k: r.s for r in df.select("k", exact.exact_total(F.col("v")).alias("s")).collect()} == {k: math.fsum(v) for k, v in rows}
