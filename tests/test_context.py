from comarca import fixed_values as fixed
from comarca.operators import lookups
from comarca.plans import context
from comarca.sources import cells

#: Published figures of one entity: product, population and the values derived from them.
PRODUCT, PEOPLE, PER_HEAD = 328087.965, 1425607, 0.2301


def poverty_cells(spark):
    rows = [("Contenido", 0, 9, 2, "Rezago educativo"), ("Contenido", 0, 9, 6, "1")]
    for place, sheet, base in ((1, "Nacional", 90.0), (2, "Aguascalientes", 23.7223), (3, "Estado de México", 42.8755), (4, "Atlantis", 1.0)):
        rows += [
            (sheet, place, 3, 2, "rezago educativo"), (sheet, place, 3, 6, "-5"),  # above the header
            (sheet, place, 8, 2, "POBLACIÓN EN SITUACIÓN DE POBREZA"), (sheet, place, 8, 6, str(base)),
            (sheet, place, 9, 2, "Población en situación de pobreza extrema"), (sheet, place, 9, 6, "1.7586"),
            (sheet, place, 12, 2, "Rezago educativo"), (sheet, place, 12, 6, "n.d."),
            (sheet, place, 13, 2, "Rezago educativo (otra)"), (sheet, place, 13, 6, "7"),
            (sheet, place, 14, 2, "Carencia por acceso a los servicios de salud"), (sheet, place, 14, 6, "26.194"),
        ]
    return spark.createDataFrame(rows, cells.CELLS)


def gdp_cells(spark):
    rows = [("t", 0, 4, 0, "Concepto"), ("t", 0, 4, 1, "2023"), ("t", 0, 4, 2, "2024")]
    for i, (name, old, new) in enumerate([("Aguascalientes", "1", str(PRODUCT)), ("México", "5", None), ("N.L.", "2", "3")]):
        rows += [("t", 0, 8 + i, 0, name), ("t", 0, 8 + i, 1, old), ("t", 0, 8 + i, 2, new)]
    rows += [("t", 0, 7, 0, "Total"), ("t", 0, 7, 2, "9"), ("t", 0, 40, 0, "Nota"), ("t", 0, 40, 2, "9")]
    return spark.createDataFrame(rows, cells.CELLS)


def census(spark):
    return spark.createDataFrame(
        [
            (0, 0, 0, 99, "9", "9", "9", "9"), (1, 0, 0, PEOPLE, "941834", "*", "0", "100"), (1, 1, 0, 5, "1", "1", "1", "1"),
            (1, 0, 3, 5, "1", "1", "1", "1"), (15, 0, 0, 0, "10", "5", "2", "1"),
        ],
        "ENTIDAD int, MUN int, LOC int, POBTOT int, POB15_64 string, PEA string, PDER_IMSS string, VIVTOT string",
    )


def test_labels_take_the_first_matching_row(spark):
    values = cells.labelled_values(cells.sheets_but(poverty_cells(spark)))
    got = {r.sheet: r for r in values.collect()}
    assert set(got) == {"Nacional", "Aguascalientes", "Estado de México", "Atlantis"}
    row = got["Aguascalientes"]
    assert (row.pobreza_pct, row.pobreza_extrema_pct, row.carencia_salud_pct) == (23.7223, 1.7586, 26.194)
    assert row.rezago_educativo_pct is None and row.vulnerable_carencias_pct is None
    assert {r.sheet for r in cells.without_first_sheet(values).collect()} == {"Aguascalientes", "Estado de México", "Atlantis"}


def test_labels_are_not_shuffled(spark):
    plan = cells.labelled_values(poverty_cells(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    shuffled = plan.split("Exchange hashpartitioning(sheet", 1)[1].split("partial_max", 1)[0]
    assert "rlike" not in shuffled.lower()


def test_last_column_is_last_by_position(spark):
    got = {r.estado: r.pib_total for r in cells.last_column_range(gdp_cells(spark)).collect()}
    assert got == {"Aguascalientes": str(PRODUCT), "México": None, "N.L.": "3"}


def test_state_rows(spark):
    got = {r.cve_ent: r for r in context.state_totals(census(spark)).collect()}
    assert set(got) == {"01", "15"}
    assert (got["01"].poblacion_total, got["01"].poblacion_economicamente_activa) == (float(PEOPLE), None)


def test_names_lead_to_codes(spark, master):
    rows = spark.createDataFrame([(" Querétaro ",), ("Estado de México",), ("N.L.",), ("nadie",), (None,)], "n string")
    got = {r.n: r.cve_ent for r in lookups.with_entity_code(rows, master, "n").collect()}
    assert got == {" Querétaro ": "22", "Estado de México": "15", "N.L.": "19", "nadie": None, None: None}


def test_shared_name_belongs_to_the_later_entity(spark):
    rows = [("A", "01", "Uno", ["Común"]), ("B", "02", "Dos", ["comun"]), ("C", "03", "Tres", None)]
    master = spark.createDataFrame(rows, "state_code string, cve_ent string, estado string, aliases array<string>")
    assert {r.nombre: r.cve_ent for r in lookups.entity_names(master).collect()} == {"uno": "01", "dos": "02", "comun": "02", "tres": "03"}


def context_long(spark, master):
    table = context.context_table(poverty_cells(spark), gdp_cells(spark), census(spark), master)
    return context.context_observations(table, master)


def test_context_dataset(spark, master):
    got = {(r.cve_ent, r.variable): (r.valor, r.anio) for r in context_long(spark, master).collect()}
    assert {code for code, _ in got} == {"01", "15"}
    assert got["01", "pib_total"] == (PRODUCT, 2024)
    assert got["01", "pib_per_capita"] == (PER_HEAD, 2024) == (round(PRODUCT / PEOPLE, 4), 2024)
    assert got["01", "poblacion_total"] == (1425607.0, 2020)
    assert got["01", "poblacion_edad_laboral_pct"] == (66.0655, 2020)
    assert got["01", "poblacion_afiliada_imss_pct"] == (0.0, 2020)
    assert got["01", "pobreza_pct"] == (23.7223, 2022)
    # missing figures and a population of 0 leave gaps, not failures
    for missing in (("01", "rezago_educativo_pct"), ("01", "poblacion_economicamente_activa_pct"), ("15", "pib_total"), ("15", "pib_per_capita"), ("15", "poblacion_edad_laboral_pct")):
        assert missing not in got
    assert ("01", "total_viviendas_pct") not in got


def test_context_wide(spark, master):
    rows = {r.cve_ent: r for r in context.context_wide(context_long(spark, master), master).collect()}
    assert (rows["01"].region, rows["01"].metrics["pib_per_capita"]) == ("Bajio", PER_HEAD)
    assert "pib_total" not in rows["15"].metrics


def test_context_catalog_sync_adds_everything_once(spark):
    from tests.test_sources_sinks import catalog_tables

    categories, variables = catalog_tables(spark)
    after_c, after_v, added = context.sync_context_catalog(categories, variables)
    assert added.where("kind = 'variable'").count() == 13  # one of the 14 is known
    got = {r.variable_id: r for r in after_v.collect()}
    assert (got["pib_per_capita"].fuente_sugerida, got["pib_per_capita"].tipo_valor) == ("INEGI PIBE + ITER", "currency")
    assert got["pib_total"].agregacion_default == "sum" and got["poblacion_total"].tipo_valor == "integer"
    assert {r.categoria_id for r in after_c.collect()} == {"economia", "bienestar_social", "demografia"}


def test_publish_context(spark, master, tmp_path):
    import json

    from tests.test_sources_sinks import text_of

    table = context.context_table(poverty_cells(spark), gdp_cells(spark), census(spark), master)
    context.publish_context(table, master, str(tmp_path), "2026-04-22")
    document = json.loads(text_of(tmp_path / fixed.CONTEXT_WIDE_ID))
    assert len(document["metric_catalog"]) == 14 and document["metric_catalog"][0]["anio"] == 2022
    assert [r["cve_ent"] for r in document["records"]] == ["01", "15"] and "anio" not in document["records"][0]


def test_density(spark):
    from pyspark.sql import functions as F

    people = spark.createDataFrame([("01", 100), ("02", 5), ("03", 1)], "cve_ent string, n int")
    areas = spark.createDataFrame([("01", 50.0), ("02", 0.0)], "cve_ent string, km2 double")
    got = {r.cve_ent: r.densidad_poblacional for r in lookups.population_density(people, areas, F.col("n"), F.col("km2")).collect()}
    assert got == {"01": 2.0, "02": None}
