import pytest
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.operators import analytics as an
from comarca.operators import insights as ins
from comarca.operators import observations as obs
from comarca.operators import quality
from comarca.operators.insights import Focus
from comarca.plans.dashboard import Dashboard
from comarca.plans.report import RawSource, publish_report, quality_report
from comarca.sources.documents import dashboard_metrics
from comarca.specs import Metric

SCORE = [name for name, _ in fixed.MARKET_WEIGHTS + fixed.WHITESPACE_WEIGHTS]


@pytest.mark.parametrize("with_map", [True, False])
def test_missing_counts_as_zero(spark, wide, with_map):
    records = wide({"m": [10, 20, None]}, with_map)
    value = an.metric(records, "m")
    row = records.agg(
        an.average(value).alias("average"), an.value_range(value).alias("r"), an.top(value).alias("top"), an.bottom(value).alias("bottom"),
        an.strict_average(value).alias("strict"), an.last_ranked(value).alias("last"),
    ).first()
    assert (row.average, row.r.lo, row.r.hi, row.top, row.bottom, row.strict, row.last) == (10.0, 0.0, 20.0, "Dos", "Tres", None, "Tres")
    assert [r.m for r in an.normalised(records, ["m"]).orderBy("cve_ent").collect()] == [0.5, 1.0, 0.0]
    assert [r.estado for r in an.ranking(records, "m").collect()] == ["Dos", "Uno", "Tres"]


def test_ties(spark, wide):
    records = wide({"m": [7, 7, 7]})
    value = an.metric(records, "m")
    row = records.agg(an.top(value).alias("t"), an.bottom(value).alias("b"), an.last_ranked(value).alias("l"), an.strict_average(value).alias("s")).first()
    assert tuple(row) == ("Uno", "Uno", "Tres", 7.0)
    assert [r.m for r in an.normalised(records, ["m"]).collect()] == [0.5] * 3
    assert [r.estado for r in an.ranking(records, "m").collect()] == ["Uno", "Dos", "Tres"]


def test_no_records(spark, wide):
    records = an.select_entities(wide({"m": [1, 2, 3]}), [])
    row = records.agg(an.average(an.metric(records, "m")).alias("a"), an.top(an.metric(records, "m")).alias("t")).first()
    assert tuple(row) == (0.0, None)
    assert an.opportunity(records).count() == 0
    assert ins.metric_insights(records, Focus("m", "M", "%")).count() == 0
    figures = ins.menu_figures(an.with_gaps(an.opportunity(records))).orderBy("posicion").collect()
    assert [f.value for f in figures] == ["N/D", "0.0%", "0.0 pp", "N/D", "N/D"]


@pytest.mark.parametrize("with_map", [True, False])
def test_opportunity_score(spark, wide, with_map):
    alone = an.opportunity(wide({name: [5] for name in SCORE}, with_map)).first()
    assert (round(alone.opportunityScore, 9), round(alone.marketAttractiveness, 9), round(alone.whitespaceScore, 9)) == (50.0, 50.0, 50.0)
    scored = an.opportunity(wide({name: [9, 1] for name in SCORE}, with_map))
    got = {r.estado: r for r in scored.collect()}
    assert [round(v, 9) for v in (got["Uno"].opportunityScore, got["Uno"].marketAttractiveness, got["Uno"].whitespaceScore)] == [65.0, 100.0, 0.0]
    assert [round(v, 9) for v in (got["Dos"].opportunityScore, got["Dos"].marketAttractiveness, got["Dos"].whitespaceScore)] == [35.0, 0.0, 100.0]
    assert an.metric(scored, "opportunityScore") is not None
    if with_map:
        assert got["Uno"].metrics["opportunityScore"] == got["Uno"].opportunityScore


def test_ranges_come_from_the_selection(spark, wide):
    records = wide({name: [0, 50, 100] for name in SCORE})
    assert {r.estado: round(r.opportunityScore, 6) for r in an.opportunity(records).collect()}["Dos"] == 50.0
    selected = an.opportunity(an.select_entities(records, ["Dos", "Tres"]))
    assert {r.estado: round(r.opportunityScore, 6) for r in selected.collect()}["Dos"] == 35.0


@pytest.mark.parametrize("with_map", [True, False])
def test_gaps(spark, wide, with_map):
    base, covered = fixed.GAP_METRICS[1][5:]
    got = an.with_gaps(wide({base: [70, None], covered: [90.5, 20]}, with_map))
    rows = got.select("estado", an.metric(got, "brecha_4g_pp").alias("g"), an.metric(got, "brecha_5g_pp").alias("h")).collect()
    assert [tuple(r) for r in rows] == [("Uno", 20.5, 0.0), ("Dos", 20.0, 0.0)]


def test_paired_ranking_clamps_positions(spark, wide):
    rows = an.paired_ranking(wide({"l": [-5, 50, None], "r": [120, 120, 10]}), "l", "r").collect()
    assert [(r.estado, r.left, r.right, r.left_position, r.right_position) for r in rows] == [
        ("Uno", -5.0, 120.0, 0.0, 100.0), ("Dos", 50.0, 120.0, 50.0, 100.0), ("Tres", 0.0, 10.0, 0.0, 10.0),
    ]


def test_pairs():
    assert an.population_pair("hogares_en_localidades_con_internet_pct")[0] == "poblacion_en_localidades_con_internet_pct"
    assert an.population_pair("x") == ("localidades_con_4g_garantizada_pct", "Localidades con 4G garantizada")
    assert an.adoption_pair("personas_con_smartphone_pct")[0] == "poblacion_en_localidades_con_5g_garantizada_pct"
    assert an.gap_pair("brecha_5g_pp")[0] == "localidades_con_5g_garantizada_pct"
    assert an.gap_pair("x") == an.gap_pair("brecha_4g_pp")


METRICS = [
    Metric("a", "cobertura_red", "Índice A", "%", "t"), Metric("b", "economia", "B", "u", "t"),
]


def metric_table(spark):
    return dashboard_metrics(obs.metric_catalog(spark, METRICS), "F")


def test_heatmap_and_radar(spark, wide):
    records = wide({"a": [0, 10, None], "b": [1, 1, 1]})
    cells = {(r.estado, r.id): (r.valor, r.intensidad, r.label, r.posicion) for r in an.heatmap(records, metric_table(spark), ["b", "a", "zz"]).collect()}
    assert cells["Dos", "a"] == (10.0, 1.0, "Índice A", 1) and cells["Tres", "a"] == (0.0, 0.0, "Índice A", 1) and cells["Uno", "b"][1] == 0.5
    assert len(cells) == 6
    radar = an.radar(records, metric_table(spark), ["a", "zz"], ["Uno", "Tres"]).orderBy("posicion").collect()
    assert [tuple(r) for r in radar] == [(0, "Índice A", 0.0, None), (1, "zz", None, None)]


def test_scatter(spark, wide):
    rows = an.scatter(wide({"a": [1, None], "b": [2, 3]}), "a", "b", "zz").collect()
    assert [(r.estado, r.x, r.y, r.z) for r in rows] == [("Uno", 1.0, 2.0, 0.0), ("Dos", 0.0, 3.0, 0.0)]


def test_metric_sentences(spark, wide):
    texts = [r.texto for r in ins.metric_insights(wide({"a": [1.25, 9.35, 1.25]}), Focus("a", "Índice A", "%")).orderBy("posicion").collect()]
    assert texts[0] == "Dos lidera en índice a con 9.3 %."
    assert texts[1].startswith("Tres presenta el menor valor en índice a,")
    assert texts[2].startswith("El promedio simple de la muestra es 3.9 %,") and len(texts) == 4


def full_records(wide):
    names = dict.fromkeys(SCORE + [n for row in fixed.GAP_METRICS for n in row[5:]] + ["hogares_en_localidades_con_internet_pct", "personas_conexion_datos_celular_pct"])
    return wide({name: [10 + i, 20 + i, 5] for i, name in enumerate(names)})


def test_sections(spark, wide):
    records = full_records(wide)
    specs = [Metric(row[0], row[1], row[2], row[3], row[4]) for row in fixed.SURVEY_SHARES + fixed.LOCALITY_SHARES]
    board = Dashboard(records, dashboard_metrics(obs.metric_catalog(spark, specs), "F"), ["Uno", "Dos"])
    focus = Focus("personas_usuarias_internet_pct", "Personas usuarias de internet", "%")
    for section in ("territorial", "population", "adoption", "opportunity"):
        assert board.insights(section, focus).count() == 3 and board.cards(section, focus).count() == 3
    gap = ins.gap_focus()
    sentences = [r.texto for r in board.insights("gap", gap).orderBy("posicion").collect()]
    assert sentences[2] == "La brecha promedio de la muestra es -7.0 pp, util para distinguir dispersion territorial frente a concentracion urbana."
    assert board.insights("executive", focus).count() == 5
    cards = [tuple(r) for r in board.cards("adoption", focus).orderBy("posicion").collect()]
    assert cards[0] == (0, "Estado lider", "20.0 %", "Dos encabeza personas usuarias de internet")
    assert cards[1][1:] == ("Promedio muestra", "15.0 %", "Referencia promedio para personas usuarias de internet")
    assert cards[2][1] == "Cobertura asociada" and cards[2][3] == "Poblacion en localidades con 4G garantizada promedio"
    assert board.cards("gap", gap).first().label == "Mayor brecha"
    assert [r.value for r in board.menu().orderBy("posicion").collect()][0] == "Dos"
    assert board.ranking("opportunity", "x").first().estado in ("Uno", "Dos")
    assert board.dumbbell("gap", "brecha_4g_pp").count() == 2 and board.scatter("opportunity", SCORE[0]).count() == 2
    assert [r.id for r in board.options("gap").orderBy("posicion").collect()] == [row[0] for row in fixed.GAP_METRICS]
    assert board.options("adoption").count() == 5 and board.heatmap().count() == 10 and board.radar(SCORE[:2]).count() == 2
    assert board.entity_names().count() == 3
    with pytest.raises(ValueError):
        board.cards("nada", focus)


# --- quality ------------------------------------------------------------------------------


def long_rows(spark, rows):
    return spark.createDataFrame([("X", c, "e", "cat", v, float(x) if x is not None else None, 2024, "f", u) for c, v, x, u in rows],
                                 ", ".join(f"{n} {'double' if n == 'valor' else 'int' if n == 'anio' else 'string'}" for n in fixed.LONG_COLUMNS))


def test_duplicates_and_ranges(spark):
    long = long_rows(spark, [("01", "x", 1, "%")] * 3 + [("02", "x", 1, "%")])
    assert quality.duplicate_pairs(long).first()[0] == 2
    assert quality.duplicate_pairs(long.where("false")).first()[0] == 0
    odd = long_rows(spark, [(str(i), "x", v, "%") for i, v in enumerate((-0.01, 0, 100, 100.01))] + [("9", "x", 500, "u")])
    assert quality.out_of_range(odd).first()[0] == 2


def stored(spark, rows):
    long = long_rows(spark, rows)
    wide = obs.pack_metrics(obs.pivot_metrics(long, ["a", "b"], ("cve_ent", "estado")), ["a", "b"])
    return long, wide, obs.metric_catalog(spark, METRICS)


def test_checks_pass(spark):
    tables = stored(spark, [("01", "a", 1, "%"), ("01", "b", 900, "u"), ("02", "a", 3, "%"), ("02", "b", 1, "u")])
    checks = quality.validation_checks(*tables, expected_entities=2).orderBy("posicion").collect()
    assert [c.status for c in checks] == ["passed"] * 6
    assert [c.detail for c in checks] == [
        "El dataset ancho contiene 2 entidades.", "Metricas con cobertura incompleta: ninguna.", "Registros largos observados: 4. Esperados: 4.",
        "Pares entidad-variable duplicados: 0.", "Registros porcentuales fuera de rango: 0.", "No se detectaron valores nulos en el dataset ancho.",
    ]


def test_checks_fail(spark):
    long, wide, catalog = stored(spark, [("01", "a", 1, "%"), ("01", "a", 101, "%"), ("02", "a", 3, "%"), ("02", "zz", 1, "u")])
    holes = wide.withColumn("metrics", F.map_concat("metrics", F.create_map(F.lit("n"), F.lit(None).cast("double"))))
    checks = {c.check_id: c for c in quality.validation_checks(long, holes, catalog).collect()}
    assert {name for name, c in checks.items() if c.status == "failed"} == {
        "state_coverage", "metric_coverage", "duplicate_state_variable_pairs", "percentage_ranges", "null_metric_values",
    }
    assert checks["metric_coverage"].detail == "Metricas con cobertura incompleta: ['a', 'b']."
    assert checks["expected_long_records"].detail == "Registros largos observados: 4. Esperados: 4."


def test_profile(spark):
    _, wide, catalog = stored(spark, [("01", "a", 1, "%"), ("02", "a", 3, "%")])
    rows = quality.metric_profile(wide, catalog).collect()
    assert [(r.metric_id, r.label, r.unit, r["count"], r.min, r.max, r.mean, r.std_dev) for r in rows] == [("a", "Índice A", "%", 2, 1.0, 3.0, 2.0, 1.0)]
    one = quality.metric_profile(wide.where("cve_ent = '01'"), catalog).first()
    assert (one["count"], one.std_dev) == (1, 0.0)


def test_report(spark, tmp_path):
    long, wide, catalog = stored(spark, [("01", "a", 1, "%"), ("01", "b", 900, "u")])
    raw = spark.createDataFrame([("01", "1"), ("", "1"), ("02", None)], "CVE_ENT string, FAC_PER string")
    sections = quality_report([RawSource("personas", "p.csv", raw, ("CVE_ENT", "FAC_PER"))], long, wide, catalog, 1)
    profile = sections["raw_files"].first()
    assert (profile.rows_read, profile.columns, profile.rows_with_missing_primary_keys) == (3, ["CVE_ENT", "FAC_PER"], 2)
    assert tuple(sections["summary"].first()) == (1, 2, 1, 2)
    assert [tuple(r) for r in sections["source_breakdown"].collect()] == [("f", 2)]
    publish_report(sections, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "validation_checks")).count() == 6
    lines = quality.report_lines(sections["summary"], sections["source_breakdown"], sections["validation_checks"], sections["metrics_profile"])
    assert lines.count() == 4 + 1 + 2 * 6 + 5 * 2
    head = spark.createDataFrame([("2026-04-19", "d")], "updated_at string, dataset_id string")
    enveloped = quality_report([], long, wide, catalog, 1, head=head)
    assert tuple(enveloped["envelope"].first()) == ("2026-04-19", "d")
    logic = [r.key for r in enveloped["cleaning_logic"].collect()]
    assert logic == ["endutih_weighted_estimator", "locality_weighted_estimator"] + ["key_steps"] * 5
    raw_lines = quality.report_lines(
        sections["summary"], sections["source_breakdown"], sections["validation_checks"], sections["metrics_profile"], sections["raw_files"]
    )
    found = {r.key: r.value for r in raw_lines.where("section = 'raw_files'").collect()}
    assert found["personas.columns"] == "CVE_ENT,FAC_PER" and found["personas.rows_with_missing_primary_keys"] == "2"


def test_facts_of_empty_tables_and_offenders(spark):
    long, wide, catalog = stored(spark, [("01", "a", 1, "%"), ("02", "a", 3, "%"), ("01", "b", 900, "u")])
    facts = quality.validation_facts(long, wide, catalog).first()
    assert (facts.records, facts.entities, facts.metrics, facts.expected, facts.offenders) == (3, 2, 2, 4, ["b"])
    none = quality.validation_facts(long.limit(0), wide.limit(0), catalog.limit(0)).first()
    assert (none.records, none.entities, none.nulls, none.metrics, none.offenders) == (0, 0, 0, 0, [])


def test_all_sections_take_one_aggregation(spark, wide):
    gaps = [name for row in fixed.GAP_METRICS for name in row[5:7]]
    names = dict.fromkeys([*SCORE, *gaps, *fixed.ADOPTION_METRICS])
    records = wide({name: [10 + i, 40 - i, 20] for i, name in enumerate(names)}, True)
    board = Dashboard(records, None, ["Uno", "Dos", "Tres"])
    focus = {
        "territorial": Focus(gaps[0], "Base", "%"),
        "population": Focus(gaps[1], "Cubierta", "%"),
        "gap": ins.gap_focus(),
        "adoption": Focus(fixed.ADOPTION_METRICS[0], "Adopcion", "%"),
        "opportunity": Focus(SCORE[0], "Potencial", "%"),
    }
    for every, one in ((board.all_insights(focus), board.insights), (board.all_cards(focus), board.cards)):
        alone = {(name, *row) for name, f in focus.items() for row in one(name, f).collect()}
        assert {(row["section"], *row[:-1]) for row in every.collect()} == alone
        plan = every._jdf.queryExecution().optimizedPlan().toString()
        # One aggregation for the facts of all sections, one for the ranges of the score.
        assert plan.count("Aggregate [") == 2
    nothing = Dashboard(records, None, [])
    assert nothing.all_insights(focus).count() == nothing.all_cards(focus).count() == 0
