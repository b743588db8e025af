import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import geometry as geo
from comarca.operators import catalog as cat
from comarca.operators import observations as obs
from comarca.plans import survey
from comarca.sinks import publish
from comarca.sources import documents, shapes, tables
from comarca.specs import context_variables


def text_of(path) -> str:
    return "".join(part.read_text(encoding="utf-8") for part in sorted(Path(path).glob("part-*")))


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_microdata_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "p.csv", "CVE_ENT,FAC_PER,P7_1\n01,100,1\n02,,2\n", "utf-8-sig")
    df = tables.read_microdata(spark, path, ["CVE_ENT", "FAC_PER", "P9_9"])
    assert df.columns == ["CVE_ENT", "FAC_PER"]
    assert [tuple(r) for r in df.collect()] == [("01", "100"), ("02", None)]


def test_latin1_text_survives(spark, tmp_path):
    path = write(tmp_path / "l.csv", 'CVEGEO,MOVIL\n010010001,Sí\n010010002,"No, ""x"""\n', "latin1")
    assert [tuple(r) for r in tables.read_latin1(spark, path).collect()] == [("010010001", "Sí"), ("010010002", 'No, "x"')]


def test_census_types(spark, tmp_path):
    path = write(tmp_path / "c.csv", "ENTIDAD,MUN,LOC,NOM,POBTOT,POB15_64,PEA,PDER_IMSS,VIVTOT\n1,0,0,x,100,60,*,N/D,30\n")
    df = tables.read_census(spark, path)
    assert dict(df.dtypes) == {
        "ENTIDAD": "int", "MUN": "int", "LOC": "int", "POBTOT": "int", "POB15_64": "string", "PEA": "string", "PDER_IMSS": "string", "VIVTOT": "string",
    }
    assert df.first().POBTOT == 100


def test_only_the_wanted_columns_are_read(spark, tmp_path):
    path = write(tmp_path / "w.csv", "a,b,c\n1,2,3\n")
    plan = tables.read_delimited(spark, path, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:string>" in plan


def test_entity_master_keeps_the_last_of_a_code(spark, tmp_path):
    states = [{"state_code": "A", "cve_ent": "01", "estado": "Viejo", "aliases": [], "region": "r", "capital": "c"},
              {"state_code": "A", "cve_ent": "01", "estado": "Nuevo", "aliases": ["N"], "region": "r", "capital": "c"}]
    path = write(tmp_path / "m.json", json.dumps({"updated_at": "x", "country": "y", "states": states}, indent=2))
    assert [(r.cve_ent, r.estado, r.aliases) for r in documents.read_entity_master(spark, path).collect()] == [("01", "Nuevo", ["N"])]


WIDE = {
    "updated_at": "2026-04-19", "schema_version": "1.0.0", "dataset_id": "d", "source": "Fuente",
    "metric_catalog": [
        {"variable_id": "a_pct", "categoria_id": "cobertura_red", "label": "A", "unidad": "%", "source_table": "t"},
        {"variable_id": "b", "categoria_id": "economia", "label": "B", "unidad": "MDP", "source_table": "t"},
    ],
    "records": [{"state_code": "AGS", "cve_ent": "01", "estado": "Aguascalientes", "region": "Bajío", "anio": 2024, "metrics": {"a_pct": 1.5, "b": None}}],
}


def test_wide_document_and_dashboard_names(spark, tmp_path):
    records, catalog, head = documents.read_wide(spark, write(tmp_path / "w.json", json.dumps(WIDE, indent=2)))
    assert head.first().dataset_id == "d"
    assert records.first().metrics == {"a_pct": 1.5, "b": None}
    metrics = documents.dashboard_metrics(catalog, head.first().source).orderBy("posicion").collect()
    assert [(m.id, m.unit, m.category, m.description) for m in metrics] == [
        ("a_pct", "%", "Cobertura de red", "A derivada de Fuente."), ("b", "MDP", "economia", "B derivada de Fuente."),
    ]
    shown = documents.dashboard_records(records).first()
    assert (shown.state, shown.stateCode, shown.cveEnt, shown.year) == ("Aguascalientes", "AGS", "01", 2024)


def test_long_document(spark, tmp_path):
    record = dict(zip(fixed.LONG_COLUMNS, ["AGS", "01", "Aguascalientes", "c", "v", 1.25, 2024, "f", "%"]))
    path = write(tmp_path / "l.json", json.dumps({"updated_at": "x", "records": [record]}))
    assert documents.read_long(spark, path).first().asDict() == record


def test_long_lines_read_back(spark, tmp_path):
    record = dict(zip(fixed.LONG_COLUMNS, ["AGS", "01", "Aguascalientes", "c", "v", 1.25, 2024, "f", "%"]))
    long = spark.createDataFrame([record], documents.LONG_FIELDS)
    publish.write_long_json(long, str(tmp_path / "long"), publish.envelope(long, "u", "d", "s"))
    assert documents.read_long(spark, str(tmp_path / "long"), lines=True).first().asDict() == record


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"two\nlines"\n')
    assert [tuple(r) for r in tables.read_delimited(spark, path, multi_line=True).collect()] == [("1", "two\nlines")]


def test_shapes(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"CVE_ENT": "01", "n": 3}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"CVE_ENT": "02", "n": 4}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]
    wanted = {"CVE_ENT": "string", "n": "long"}
    whole = shapes.read_shapes(spark, write(tmp_path / "c.json", json.dumps({"type": "FeatureCollection", "features": features})), wanted)
    lines = shapes.read_shapes(spark, write(tmp_path / "l.json", "\n".join(map(json.dumps, features))), wanted, lines=True)
    for df in (whole, lines):
        got = {r.CVE_ENT: (r.n, len(r.geometria), r.geometria[0][0][1]) for r in df.collect()}
        assert got == {"01": (3, 1, (1.0, 0.0)), "02": (4, 2, (1.0, 0.0))}
        assert df.schema["geometria"].dataType.simpleString() == geo.GEOMETRY


def test_features_read_back(spark, tmp_path):
    tiles = spark.range(3).select(
        geo.polygon(*[(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.5))]).alias("geometria"),
        F.lit("4G").alias("tech_proxy"), F.when(F.col("id") > 0, F.col("id") * 1.5).alias("avg_d_mbps"),
    )
    path = str(tmp_path / "tiles")
    publish.write_features(tiles, path)
    first = json.loads(text_of(path).splitlines()[0])
    assert first["type"] == "Feature" and set(first["properties"]) == {"tech_proxy", "avg_d_mbps"}
    back = shapes.read_shapes(spark, path, {"tech_proxy": "string", "avg_d_mbps": "double"}, lines=True)
    assert sorted(map(str, back.select("tech_proxy", "avg_d_mbps", "geometria").collect())) == sorted(
        map(str, tiles.select("tech_proxy", "avg_d_mbps", "geometria").collect())
    )


def wide_table(spark):
    return spark.createDataFrame(
        [("NLE", "19", "Nuevo León", "Noreste", 2024, {"a": 2.0}), ("AGS", "01", "Aguascalientes", "Bajío", 2024, {"a": 1.0, "b": 3.5})],
        "state_code string, cve_ent string, estado string, region string, anio int, metrics map<string,double>",
    )


@pytest.mark.parametrize("single", [True, False])
def test_wide_document_is_one_envelope(spark, tmp_path, single):
    wide = wide_table(spark)
    catalog = spark.createDataFrame([("b", "c", "B", "%", "t", 1), ("a", "c", "Á", "%", "t", 0)], obs.CATALOG_SCHEMA + ", posicion int")
    head = publish.envelope(wide, "2026-04-19", "d", "Fuente")
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    publish.write_wide_document(wide, catalog, head, paths, single_file=single)
    texts = [text_of(path) for path in paths]
    assert texts[0] == texts[1]
    document = json.loads(texts[0])
    assert [m["variable_id"] for m in document["metric_catalog"]] == ["a", "b"] and "posicion" not in document["metric_catalog"][0]
    assert [r["cve_ent"] for r in document["records"]] == ["01", "19"]
    assert document["records"][0]["metrics"] == {"a": 1.0, "b": 3.5} and document["schema_version"] == "1.0.0"
    assert "Nuevo León" in texts[0]
    if single:
        assert len(list(Path(paths[0]).glob("part-*"))) == 1
        records, _, _ = documents.read_wide(spark, paths[0])
        assert records.count() == 2


def test_empty_document(spark, tmp_path):
    wide = wide_table(spark).where("false")
    lines = publish.document_lines(wide, publish.envelope(wide, "u", "d", "s")).orderBy("_section")
    assert json.loads("".join(r.value for r in lines.collect()))["records"] == []


def survey_inputs(spark, master):
    answers = ", ".join(f"{c} string" for c in ("P6_1", "P7_1", "P7_8_7", "P7_15", "P7_21", "P7_28", "P7_33"))
    persons = spark.createDataFrame([("01", "3", *["1"] * 7), ("01", "1", *["2"] * 7), ("19", "5", *["1"] * 7)], f"CVE_ENT string, FAC_PER string, {answers}")
    more = ", ".join(f"{c} string" for c in ("P8_1", "P8_3", "P8_4_2", "P8_12_2", "P8_13_6", "P8_13_7"))
    persons2 = spark.createDataFrame([("01", "4", *["1"] * 6), ("19", "5", *["2"] * 6)], f"CVE_ENT string, FAC_PER string, {more}")
    return survey.SurveyInputs(
        microdata={"usuarios": survey.Microdata(persons), "usuarios2": survey.Microdata(persons2)},
        published={"td_teledensidad_intmovil": spark.createDataFrame(
            [("2024", "12", "1", "99.5"), ("2024", "12", "19", "120")], "ANIO string, MES string, K_ENTIDAD string, T_INTMOVIL_ITE_VA string")},
        connectivity=spark.createDataFrame(
            [("a", "2024", "Sí", "Garantizada", "x", "Sí"), ("b", "2024", "Sí", "x", "x", "No")],
            "CVEGEO string, ANIO string, MOVIL string, G_4G string, G_5G string, INTERNET string"),
        localities=spark.createDataFrame([("a", "1", "10", "2", 1), ("b", "19", "30", "4", 2)], "CVEGEO string, ENT string, POBLACION string, TOTHOG string, ID int"),
        master=master,
    )


def test_publish_survey(spark, master, tmp_path):
    folder, public = str(tmp_path / "processed"), str(tmp_path / "public")
    survey.publish_survey(survey_inputs(spark, master), folder, "2026-04-19", public)
    csv = text_of(f"{folder}/{fixed.SURVEY_LONG_ID}/csv").splitlines()
    assert csv[0] == ",".join(fixed.LONG_COLUMNS)
    records = spark.read.json(f"{folder}/{fixed.SURVEY_LONG_ID}/records")
    assert records.count() == 2 * 22 and set(records.columns) == set(fixed.LONG_COLUMNS)
    wide = json.loads(text_of(f"{folder}/{fixed.SURVEY_WIDE_ID}"))
    assert len(wide["metric_catalog"]) == 22 and [r["estado"] for r in wide["records"]] == ["Aguascalientes", "Nuevo Leon"]
    metrics = wide["records"][0]["metrics"]
    assert (metrics["personas_usuarias_internet_pct"], metrics["teledensidad_internet_movil"]) == (75.0, 99.5)
    assert metrics["localidades_con_5g_garantizada_pct"] == 0.0 and len(metrics) == 22
    assert text_of(f"{public}/{fixed.SURVEY_WIDE_ID}") == text_of(f"{folder}/{fixed.SURVEY_WIDE_ID}")


def catalog_tables(spark):
    categories = spark.createDataFrame([("economia", "Economía", "d", 0)], documents.CATEGORY_FIELDS + ", posicion int")
    variables = spark.createDataFrame(
        [("pobreza_pct", "vieja", "n", "d", "u", "number", "latest", "f", ["s"], 0)], documents.VARIABLE_FIELDS + ", posicion int"
    )
    return categories, variables


def test_catalog_sync(spark, tmp_path):
    categories, variables = catalog_tables(spark)
    specs = spark.createDataFrame(
        [
            (0, "pobreza_pct", 2022, "bienestar_social", "L", "%", None, None),
            (1, "nuevo_usd", 2024, "nueva_cat", "Nuevo", "USD millones", "", None),
            (2, "poblacion_total", 2020, "nueva_cat", "Pob", "personas", "Propia", []),
            (3, "nuevo_usd", 1999, "otra_5g", "Otra vez", "%", None, None),
        ],
        cat.SPEC_FIELDS,
    )
    metadata = spark.createDataFrame([("nuevo_usd", "Meta", ["m"]), ("poblacion_total", "Meta", ["m"])], cat.METADATA_FIELDS)
    after_c, after_v, added = cat.sync_catalog(categories, variables, specs, metadata, cat.category_defaults(spark), "F")
    got = {r.variable_id: r for r in after_v.collect()}
    assert got["pobreza_pct"].categoria_id == "vieja" and len(got) == 3
    new = got["nuevo_usd"]
    assert (new.tipo_valor, new.agregacion_default, new.fuente_sugerida, new.sinonimos) == ("currency", "avg", "Meta", ["m"])
    assert new.descripcion == "Nuevo (año 2024)." and new.nombre == "Nuevo"
    total = got["poblacion_total"]
    assert (total.tipo_valor, total.agregacion_default, total.fuente_sugerida, total.sinonimos) == ("integer", "sum", "Propia", [])
    named = {r.categoria_id: (r.nombre, r.descripcion) for r in after_c.collect()}
    assert named["nueva_cat"] == ("Nueva Cat", fixed.CATEGORY_FALLBACK_DESCRIPTION) and named["otra_5g"][0] == "Otra 5G"
    assert named["bienestar_social"][0] == "Bienestar social" and named["economia"][0] == "Economía"
    assert publish.write_catalog(after_c, after_v, added, str(tmp_path), "v2") == f"{tmp_path}/v2"
    again_c, again_v, nothing = cat.sync_catalog(after_c, after_v, specs, metadata, cat.category_defaults(spark), "F")
    assert nothing.isEmpty() and again_v.count() == 3
    assert publish.write_catalog(again_c, again_v, nothing, str(tmp_path), "v3") is None and not (tmp_path / "v3").exists()


def test_value_types(spark):
    cases = [("x_pct", "u"), ("x", " % "), ("poblacion_total", "personas"), ("pib", "MDP"), ("y", "Millones USD"), ("z", "u")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, u string").orderBy("i")
    types = [r[0] for r in df.select(cat.value_type(F.col("v"), F.col("u"))).collect()]
    assert types == ["percentage", "percentage", "integer", "currency", "currency", "number"]


def dashboard_catalog(spark):
    rows = [("a", "A", "%", "Cobertura de red", "d", 0), ("b", "B", "u", "Industria", "d", 1), ("c", "C", "u", "Industria", "d", 2)]
    return spark.createDataFrame(rows, "id string, label string, unit string, category string, description string, posicion int")


def test_metric_lookups(spark):
    metrics = dashboard_catalog(spark)
    listed = cat.metric_options(metrics, ["c", "nope", "a"]).orderBy("posicion").collect()
    assert [(r.id, r.label, r.category) for r in listed] == [("c", "C", "Industria"), ("a", "A", "Cobertura de red")]
    assert [r.id for r in cat.category_metrics(metrics, "Industria").orderBy("posicion").collect()] == ["b", "c"]
    assert cat.metric_options(metrics).count() == 3
    assert cat.metric_definition(metrics, "b").first().unit == "u"
    with pytest.raises(PySparkException, match="La metrica nope no existe"):
        cat.metric_definition(metrics, "nope").collect()


def test_context_metric_catalog_has_years(spark):
    catalog = obs.metric_catalog(spark, context_variables())
    assert catalog.columns[:2] == ["variable_id", "anio"] and catalog.count() == 14
