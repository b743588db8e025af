"""One query per operator or small family of operators, over the whole benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import geometry as geo
from comarca.functions import numeric as num
from comarca.functions import text as txt
from comarca.operators import analytics as an
from comarca.operators import catalog as cat
from comarca.operators import coverage as cov
from comarca.operators import estimators as est
from comarca.operators import insights as ins
from comarca.operators import lookups, observations, quality
from comarca.operators.insights import Focus
from comarca.operators.running_totals import RunningTotals
from comarca.operators.spatial import within_join
from comarca.plans import context, network, survey
from comarca.plans.dashboard import Dashboard
from comarca.sinks import catalog_log, layouts, publish, versions
from comarca.sources import cells, shapes, tables
from comarca.sources.documents import WIDE_FIELDS, category_label, read_entity_master, read_long
from comarca.specs import Share
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- estimators -------------------------------------------------------------------------


@query
def weighted_share(spark: SparkSession, sf: str) -> DataFrame:
    """One weighted share per entity, labelled."""
    specs = [spec for spec in t.metrics().shares if spec.variable == "personas_compras_internet_pct"]
    source = t.lines(spark, sf)
    shares = est.weighted_shares(source.persons, specs, source.entity, source.weight, source.weight_type, source.entity_of)
    return est.share_observations(shares, specs, t.master(spark, sf), t.YEAR, fixed.SURVEY_SOURCE).drop("secuencia")


@query
def weighted_share_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Shares straight by a text column of the microdata, blank keys and weights left out."""
    specs = [spec for spec in t.metrics().shares if spec.column.startswith("o_")]
    return est.weighted_shares(
        t.table(spark, sf, "orders").withColumn("o_orderpriority", F.concat(F.lit(" "), "o_orderpriority")),
        specs, "o_orderpriority", "o_totalprice", "decimal(18,2)",
    ).select("cve_ent", *[num.round_half_even(F.col(s.variable), 2).alias(s.variable) for s in specs])


@query
def weighted_share_long(spark: SparkSession, sf: str) -> DataFrame:
    """All shares of the order lines in one scan, unpivoted."""
    specs = [spec for spec in t.metrics().shares if spec.source_table == "usuarios"]
    source = t.lines(spark, sf)
    shares = est.weighted_shares(source.persons, specs, source.entity, source.weight, source.weight_type, source.entity_of)
    return est.share_observations(shares, specs, t.master(spark, sf), t.YEAR, fixed.SURVEY_SOURCE).drop("secuencia")


@query
def locality_share(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of localities, people and households."""
    specs = t.metrics().localities
    shares = est.locality_shares(t.connectivity(spark, sf), est.latest_localities(t.localities(spark, sf)), specs, t.YEAR)
    return est.share_observations(shares, specs, t.master(spark, sf), t.YEAR, fixed.LOCALITY_SOURCE).drop("secuencia")


@query
def direct_value(spark: SparkSession, sf: str) -> DataFrame:
    """Published values of one year, every month a row."""
    (spec,) = t.metrics().direct
    return est.direct_observations(t.published(spark, sf), spec, t.master(spark, sf), t.YEAR)


@query
def last_row_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order of every customer."""
    orders = t.table(spark, sf, "orders").select(
        "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("_when"), "o_orderstatus", "o_totalprice"
    )
    return lookups.last_by_key(orders, "o_custkey", "_when").select(
        "o_custkey", F.col("_when.o_orderkey").alias("o_orderkey"), "o_orderstatus", "o_totalprice"
    )


@query
def weighted_share_doubles(spark: SparkSession, sf: str) -> DataFrame:
    """Shares by weights with all 17 digits of a double, from thousandths to tens of thousands."""
    lines = t.table(spark, sf, "lineitem")
    weight = F.col("l_extendedprice") / F.lit(3.0) * F.when(F.col("l_linenumber") == 1, 1e-6).otherwise(1.0) + F.lit(0.1)
    spec = Share("open_pct", "c", "open", "%", "lineitem", column="l_linestatus", positive_values=("O",))
    shares = est.weighted_shares(lines.withColumn("w", weight), [spec], "l_returnflag", "w")
    return shares.select("cve_ent", num.round_half_even(F.col("open_pct"), 6).alias("open_pct"))


@query
def locality_share_fine(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of localities by weights down to hundred-millionths."""
    rows = t.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("CVEGEO"), F.col("c_nationkey").cast("string").alias("ENT"),
        (F.abs("c_acctbal") / F.lit(7e8)).alias("POBLACION"), (F.abs("c_acctbal") / F.lit(3.0)).cast("string").alias("TOTHOG"),
        F.col("c_custkey").alias("ID"),
    )
    specs = t.metrics().localities
    shares = est.locality_shares(t.connectivity(spark, sf), est.latest_localities(rows), specs, t.YEAR)
    long = est.share_observations(shares, specs, t.master(spark, sf), t.YEAR, fixed.LOCALITY_SOURCE, digits=6)
    return long.select("cve_ent", "variable", "valor")


# --- observations -----------------------------------------------------------------------


@query
def survey_long(spark: SparkSession, sf: str) -> DataFrame:
    """The whole survey dataset, three families in one long table."""
    return t.survey_long(spark, sf).select(*fixed.LONG_COLUMNS)


@query
def survey_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide records; the map is spread into columns for comparison."""
    wide = survey.survey_wide(t.survey_long(spark, sf), t.master(spark, sf), t.YEAR, t.metrics())
    return observations.unpack_metrics(wide, t.metrics().variables)


@query
def open_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A metrics map per supplier with a variable for each part, as text; the latest order's quantity stays."""
    long = t.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("cve_ent"),
        F.concat(F.lit("part_"), F.col("l_partkey")).alias("variable"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("secuencia"),
        F.col("l_quantity").alias("valor"),
    )
    wide = observations.sparse_pivot(long)
    entries = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"])))
    return wide.select("cve_ent", F.size("metrics").cast("long").alias("n_metrics"), F.array_join(entries, " ").alias("metrics"))


@query
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    """Back from the metrics map to entity, variable and value."""
    wide = survey.survey_wide(t.survey_long(spark, sf), t.master(spark, sf), t.YEAR, t.metrics())
    return observations.long_from_wide(wide)


@query
def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every metric of the catalog with its label and how many long rows it has."""
    counts = t.survey_long(spark, sf).groupBy("variable").agg(F.count(F.lit(1)).alias("records"))
    catalog = observations.metric_catalog(spark, t.metrics().all)
    return catalog.join(counts, F.col("variable_id") == F.col("variable"), "left").select(
        "posicion", "variable_id", "categoria_id", "label", "unidad", "source_table",
        F.coalesce("records", F.lit(0)).alias("records"),
    )


# --- text and lookups -------------------------------------------------------------------


@query
def text_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Every document folded to plain ASCII."""
    folded = txt.fold(F.col("text"))
    return t.documents(spark, sf, "doc_id", "text").select("doc_id", F.md5(folded).alias("folded"), F.length(folded).alias("n"))


@query
def text_slug(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one slug."""
    slug = txt.slug(F.col("text"))
    return t.documents(spark, sf, "doc_id", "text").select("doc_id", F.md5(slug).alias("slug"), F.length(slug).alias("n"))


@query
def text_title(spark: SparkSession, sf: str) -> DataFrame:
    """Title case of blank-separated words and of letter runs, in the turns of all conversations."""
    line = F.regexp_replace(F.col("text"), r"\s+", " ")
    return t.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(txt.title_words(F.lower(line))).alias("words"), F.md5(txt.title_runs(line)).alias("runs")
    )


@query
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as canonical entity and variable names, known ones through aliases."""
    names = [("red widget", "Widget Rojo"), ("blue bolt", "Perno Azul"), ("small ring", "Anillo")]
    variables = [("red widget", "widget_rojo_pct"), ("hot gear", "engrane_indice")]
    raw = F.concat(F.lit("  "), F.upper("p_name"))
    return (
        t.table(spark, sf, "part")
        .select(txt.canonical_name(raw, names).alias("nombre"), txt.canonical_variable(raw, variables).alias("variable"))
        .groupBy("nombre", "variable")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def zero_filled_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes padded to two digits, longer ones kept, counted."""
    return (
        t.table(spark, sf, "part")
        .select(txt.zero_fill(F.col("p_size")).alias("talla"), txt.zero_fill(F.regexp_extract("p_brand", "[0-9]+", 0), 3).alias("marca"))
        .groupBy("talla", "marca")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the entity their nation's written name leads to; some names lead nowhere."""
    number = F.col("c_nationkey").cast("string")
    written = (
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("Ultramar "), number))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("  NACIÓN "), number))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("n."), number, F.lit(" ")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("Nación "), number))
        .otherwise(F.concat(F.lit("nation_"), number))
    )
    named = t.table(spark, sf, "customer").select(written.alias("nombre_escrito"))
    counted = named.groupBy("nombre_escrito").agg(F.count(F.lit(1)).alias("n"))
    return (
        lookups.with_entity_code(counted, t.master(spark, sf), "nombre_escrito")
        .groupBy("cve_ent")
        .agg(F.sum("n").alias("customers"), F.count(F.lit(1)).alias("spellings"))
    )


@query
def rounded_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts up to about 1e13 with eighths, so that exact ties occur, rounded to 2 and 4 digits and as text."""
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    eighths = (F.col("o_orderkey") % 64) / F.lit(64.0)
    sign = F.when(F.col("o_orderkey") % 3 == 0, -1.0).otherwise(1.0)
    amount = sign * (F.floor("o_totalprice") * F.lit(1e7) + eighths)
    rows = orders.select("o_orderkey", amount.alias("amount"))
    return rows.select(
        "o_orderkey",
        num.round_half_even(F.col("amount"), 2).alias("two"),
        num.round_half_even(F.col("amount"), 4).alias("four"),
        num.fixed_decimals(F.col("amount"), 1).alias("text"),
    )


@query
def weighted_share_fine(spark: SparkSession, sf: str) -> DataFrame:
    """Shares by weights with six decimals."""
    lines = t.table(spark, sf, "lineitem")
    weight = (F.col("l_orderkey") % 1000 + 1).cast("decimal(10,0)") * F.lit(Decimal("0.000001"))
    persons = lines.select("l_returnflag", "l_linestatus", weight.cast("string").alias("w"))
    spec = Share("open_pct", "c", "open", "%", "lineitem", column="l_linestatus", positive_values=("O",))
    return est.weighted_shares(persons, [spec], "l_returnflag", "w")


# --- sheets and context -----------------------------------------------------------------


@query
def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, a value of the first document whose whole text matches each pattern."""
    documents = t.documents(spark, sf, "doc_id", "text", "lang", "source", "n_chars")
    sheet = F.struct(
        F.col("source").alias("sheet"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("sheet_pos"),
        F.col("doc_id").alias("row"),
    )
    label = F.struct(F.lit(fixed.POVERTY_LABEL_COLUMN).alias("col"), F.col("text").alias("value"))
    value = F.struct(
        F.lit(fixed.POVERTY_VALUE_COLUMN).alias("col"),
        F.when(F.col("lang") == "de", F.lit("n.d.")).otherwise(F.col("n_chars").cast("string")).alias("value"),
    )
    table = documents.select(sheet.alias("s"), F.inline(F.array(label, value))).select("s.*", "col", "value")
    patterns = [("licencia", "license"), ("acentos", "É[lt]"), ("euros", "der|die|das"), ("correo", r"[a-z]+@[a-z]+\.")]
    found = cells.labelled_values(cells.sheets_but(table, "src3", -1), patterns)
    return cells.without_first_sheet(found, cells.sheets_but(documents.select(sheet.alias("s")).select("s.*"), "src3", -1))


@query
def sheet_last_column(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the latest year per nation, read off a sheet with one column per year."""
    counted = (
        t.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    )
    nation, region = t.table(spark, sf, "nation"), t.table(spark, sf, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    totals = (
        counted.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "year")
        .agg(F.sum("n").alias("n"))
        .join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    first = fixed.GDP_HEADER_ROW + 1 + fixed.GDP_FIRST_ROW
    sheet, place = F.col("r_name").alias("sheet"), F.col("r_regionkey").alias("sheet_pos")
    figures = totals.select(
        sheet, place, (F.lit(first) + F.col("n_nationkey")).alias("row"), (F.col("year") - 1994).alias("col"),
        F.col("n").cast("string").alias("value"),
    )
    labels = named.select(sheet, place, (F.lit(first) + F.col("n_nationkey")).alias("row"), F.lit(0).alias("col"), F.col("n_name").alias("value"))
    headers = region.select(
        sheet, place, F.lit(fixed.GDP_HEADER_ROW).alias("row"), F.lit(0).alias("col"), F.lit(fixed.GDP_LABEL_HEADER).alias("value")
    )
    return cells.last_column_range(_union([figures, labels, headers])).select(
        "sheet", "estado", num.number_or_null(F.col("pib_total")).alias("pib_total")
    )


@query
def census_states(spark: SparkSession, sf: str) -> DataFrame:
    """State rows picked from a census with national, state and municipal totals."""
    customer = t.table(spark, sf, "customer")
    rows = customer.rollup("c_nationkey", "c_mktsegment").agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).cast("int").alias("POBTOT"),
        F.count_if(F.col("c_acctbal") > 0).cast("string").alias("POB15_64"),
        F.count_if(F.col("c_acctbal") > 5000).cast("string").alias("PEA"),
        F.max("c_mktsegment").alias("PDER_IMSS"),
        F.count_if(F.col("c_acctbal") > 9000).cast("string").alias("VIVTOT"),
    )
    census = rows.select(
        F.when(F.col("_level") == 3, 0).otherwise(F.col("c_nationkey") + 1).alias("ENTIDAD"),
        F.when(F.col("_level") == 0, F.length("c_mktsegment")).otherwise(0).alias("MUN"),
        F.lit(0).alias("LOC"), "POBTOT", "POB15_64", "PEA", "PDER_IMSS", "VIVTOT",
    )
    return context.state_totals(census)


@query
def context_long(spark: SparkSession, sf: str) -> DataFrame:
    """Context variables of every nation: left merges, ratios, missing values left out."""
    customer = t.table(spark, sf, "customer")
    people = customer.groupBy(txt.zero_fill(F.col("c_nationkey")).alias("cve_ent")).agg(
        F.count(F.lit(1)).cast("double").alias("poblacion_total"),
        F.count_if(F.col("c_acctbal") > 0).alias("poblacion_edad_laboral"),
        F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("poblacion_economicamente_activa"),
        F.count_if(F.col("c_mktsegment") == "HOUSEHOLD").alias("poblacion_afiliada_imss"),
        F.count_if(F.col("c_acctbal") > 9000).alias("total_viviendas"),
    )
    spent = t.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("_spent"))
    product = (
        spent.join(t.customers_of(spark, sf), F.col("o_custkey") == F.col("unit"))
        .groupBy("cve_ent")
        .agg(F.sum("_spent").cast("string").alias("pib_total"))
        .withColumn("pib_total", num.number_or_null(F.when(F.col("cve_ent") == "05", F.lit("n.d.")).otherwise(F.col("pib_total"))))
    )
    poverty = t.table(spark, sf, "supplier").groupBy(txt.zero_fill(F.col("s_nationkey")).alias("cve_ent")).agg(
        *[
            F.avg(F.when(F.col("s_acctbal") < limit, 100.0).otherwise(0.0)).alias(name)
            for (name, _), limit in zip(fixed.POVERTY_LABELS, (0, 500, 1000, 2000, 3000, 4000, 5000, 6000))
        ]
    )
    merged = context.derived(lookups.left_merge(poverty, [product, people]))
    return context.context_observations(merged, t.master(spark, sf)).drop("secuencia")


# --- catalog ----------------------------------------------------------------------------


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    """A variable per part name and type, first seen at its lowest part key."""
    variable = txt.slug(F.concat_ws(" ", "p_name", "p_type"))
    named = F.when(F.col("p_type") == "PROMO", F.concat(variable, F.lit("_pct"))).otherwise(variable)
    unit = F.when(F.col("p_type") == "SMALL", " % ").when(F.col("p_type") == "LARGE", "USD millones").otherwise("piezas")
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("posicion"), named.alias("variable"), F.lit(t.YEAR).alias("anio"),
        F.concat(F.lit("cat_5"), F.lower("p_type")).alias("categoria"), F.initcap("p_name").alias("label"), unit.alias("unidad"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("fuente_sugerida"),
        F.when(F.col("p_size") > 40, F.array("p_name")).alias("sinonimos"),
    )


def _synchronised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    specs = _declared(spark, sf)
    part = t.table(spark, sf, "part")
    existing = part.where(F.col("p_size") == 1).groupBy(txt.slug(F.concat_ws(" ", "p_name", "p_type")).alias("variable_id")).agg(
        F.min("p_partkey").alias("posicion")
    )
    blank = F.lit("")
    variables = existing.select(
        "variable_id", F.lit("cat_5economy").alias("categoria_id"), F.lit("viejo").alias("nombre"), blank.alias("descripcion"),
        F.lit("u").alias("unidad_base"), F.lit("number").alias("tipo_valor"), F.lit("latest").alias("agregacion_default"),
        blank.alias("fuente_sugerida"), F.array().cast("array<string>").alias("sinonimos"), "posicion",
    )
    categories = part.where(F.col("p_type") == "ECONOMY").groupBy(F.lit("cat_5economy").alias("categoria_id")).agg(
        F.lit("Economy").alias("nombre"), F.lit("").alias("descripcion"), F.lit(0).cast("long").alias("posicion")
    )
    metadata = part.groupBy(txt.slug(F.concat_ws(" ", "p_name", "p_type")).alias("variable")).agg(
        F.max("p_brand").alias("fuente_sugerida"), F.sort_array(F.collect_set("p_type")).alias("sinonimos")
    )
    defaults = spark.createDataFrame(
        [("cat_5small", "Pequeñas", "Piezas pequeñas.")], "categoria_id string, nombre string, descripcion string"
    )
    return cat.sync_catalog(categories, variables, specs, metadata, defaults, "Fuente general")


@query
def catalog_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Variables after synchronisation: existing ids untouched, new ones with inferred fields."""
    _, variables, _ = _synchronised(spark, sf)
    return variables.withColumn("sinonimos", F.array_join("sinonimos", "|"))


@query
def catalog_categories(spark: SparkSession, sf: str) -> DataFrame:
    categories, _, _ = _synchronised(spark, sf)
    return categories


@query
def catalog_added(spark: SparkSession, sf: str) -> DataFrame:
    _, _, added = _synchronised(spark, sf)
    return added


def _part_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A metric per part name under the dashboard names."""
    named = t.table(spark, sf, "part").groupBy(txt.slug(F.col("p_name")).alias("id")).agg(
        F.min("p_name").alias("label"),
        F.min("p_partkey").alias("posicion"),
        F.min(F.when(F.col("p_size") > 48, "cobertura_red").otherwise(F.lower("p_type"))).alias("categoria_id"),
    )
    return named.select("id", "label", category_label().alias("category"), "posicion")


@query
def metric_options(spark: SparkSession, sf: str) -> DataFrame:
    """Listed choices the catalog knows, in list order; then one category; then one strict lookup."""
    metrics = _part_metrics(spark, sf)
    listed = cat.metric_options(metrics, ["red_widget", "no_such_metric", "hot_gear", "blue_bolt"])
    of_category = cat.category_metrics(metrics, "Cobertura de red")
    definition = cat.metric_definition(metrics, "small_ring").withColumn("posicion", F.lit(0).cast("long"))
    parts = {"listed": listed, "category": of_category, "definition": definition, "all": cat.metric_options(metrics)}
    return _union([
        df.select(F.lit(kind).alias("kind"), "id", "label", "category", F.col("posicion").cast("long").alias("posicion"))
        for kind, df in parts.items()
    ])


@query
def metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Base and coverage metric that goes with each variable observed."""
    ids = t.survey_long(spark, sf).groupBy(F.col("variable").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    population = an.pair_lookup(ids, fixed.POPULATION_PAIRS).withColumn("kind", F.lit("population"))
    adoption = an.pair_lookup(ids, fixed.ADOPTION_PAIRS).withColumn("kind", F.lit("adoption"))
    return population.unionByName(adoption)


# --- coverage and places ----------------------------------------------------------------


def _event_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Speed tests by user (municipality) and event type (state)."""
    events = t.table(spark, sf, "events").select(
        F.col("event_type").alias("CVE_ENT"),
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("CVEGEO"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("NOMGEO"),
        (F.col("value") * 1000).alias("avg_d_kbps"),
        F.col("user_id").alias("tests"),
        "props",
    )
    return cov.with_technology(events)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(name, digits).alias(name) if dtype == "double" else F.col(name) for name, dtype in df.dtypes]
    )


@query
def coverage_municipality(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(cov.by_municipality(_event_tiles(spark, sf), geometry="props"), 9)


@query
def coverage_state(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted means of the municipalities, mode of their modes."""
    return _rounded(cov.by_state(cov.by_municipality(_event_tiles(spark, sf), geometry="props")), 9)


@query
def commonest_event(spark: SparkSession, sf: str) -> DataFrame:
    """Mode of an open set of values per user, the smallest on ties."""
    return cov.most_frequent(t.table(spark, sf, "events"), ["user_id"], "event_type")


@query
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """Speed tests with every territory they lie strictly inside of."""
    return within_join(t.places(spark, sf), t.territories(spark, sf)).select("event_id", "CVEGEO")


@query
def tile_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of the box to territories by centroid, classified and rolled up."""
    classified = network.classified_tiles(t.tiles(spark, sf), t.territories(spark, sf), t.STRIP_BOX)
    return _rounded(cov.by_municipality(classified), 9)


@query
def tile_coverage_state(spark: SparkSession, sf: str) -> DataFrame:
    classified = network.classified_tiles(t.tiles(spark, sf), t.territories(spark, sf), t.STRIP_BOX)
    return _rounded(cov.by_state(cov.by_municipality(classified)), 9)


@query
def tile_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every tile of the box as a GeoJSON feature."""
    tiles = cov.with_technology(cov.tiles_in_box(t.tiles(spark, sf), t.STRIP_BOX))
    keyed = tiles.select("event_id", "tech_proxy", "geometria")
    return keyed.select("event_id", F.md5(geo.to_geojson(F.col("geometria"))).alias("shape"), "tech_proxy")


@query
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area, centroid and extent of every territory."""
    shape = F.col("geometria")
    return t.territories(spark, sf).select(
        "CVEGEO", geo.area(shape).alias("area"), geo.centroid(shape).alias("_c"), geo.bounds(shape).alias("_b")
    ).select(
        "CVEGEO", "area", F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"), F.col("_b.x_min").alias("x_min"), F.col("_b.y_max").alias("y_max")
    )


@query
def population_density(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per projected square kilometre of their nation's territories."""
    areas = t.territories(spark, sf).groupBy(F.col("CVE_ENT").alias("cve_ent")).agg(
        F.sum(geo.area_km2(F.col("geometria")).cast("decimal(28,12)")).alias("km2")
    )
    people = t.table(spark, sf, "customer").groupBy(txt.zero_fill(F.col("c_nationkey")).alias("cve_ent")).agg(F.count(F.lit(1)).alias("n"))
    density = lookups.population_density(people, areas, F.col("n"), F.col("km2"))
    return density.select("cve_ent", F.round("densidad_poblacional", 4).alias("densidad_poblacional"))


# --- dashboard analytics ----------------------------------------------------------------


def _dashboard(spark: SparkSession, sf: str, selected: list[str] | None = None) -> Dashboard:
    return Dashboard(t.survey_columns(spark, sf), t.dashboard_catalog(spark), t.SELECTED if selected is None else selected)


def _focus(variable: str) -> Focus:
    spec = next(s for s in t.metrics().all if s.variable == variable)
    return Focus(spec.variable, spec.label, spec.unidad)


@query
def min_max_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Every metric of the score as a position within its range over all nations."""
    names = [name for name, _ in fixed.MARKET_WEIGHTS + fixed.WHITESPACE_WEIGHTS]
    return _rounded(an.normalised(t.survey_columns(spark, sf), names))


@query
def opportunity_score(spark: SparkSession, sf: str) -> DataFrame:
    """Composite score of all nations."""
    scored = an.opportunity(t.survey_columns(spark, sf))
    return _rounded(scored.select("cve_ent", "estado", "opportunityScore", "marketAttractiveness", "whitespaceScore"))


@query
def opportunity_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Score within a selection: the ranges are those of the selection."""
    scored = _dashboard(spark, sf).scored
    return _rounded(scored.select("cve_ent", "estado", "opportunityScore", "marketAttractiveness", "whitespaceScore"))


@query
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Covered population less covered localities, in points."""
    gaps = an.with_gaps(t.survey_columns(spark, sf))
    return _rounded(gaps.select("cve_ent", "estado", *[row[0] for row in fixed.GAP_METRICS]))


@query
def metric_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return an.ranking(t.survey_columns(spark, sf), "personas_usuarias_internet_pct")


@query
def metric_dumbbell(spark: SparkSession, sf: str) -> DataFrame:
    """A population metric next to its base, values and 0..100 positions."""
    return _dashboard(spark, sf).dumbbell("population", "poblacion_en_localidades_con_5g_garantizada_pct")


@query
def metric_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the territorial, adoption and opportunity charts."""
    board = _dashboard(spark, sf)
    size = F.lit(None).cast("double")
    charts = {
        "territorial": board.scatter("territorial", "localidades_con_4g_garantizada_pct"),
        "adoption": board.scatter("adoption", "personas_usuarias_internet_pct").withColumn("z", size),
        "opportunity": board.scatter("opportunity", "personas_compras_internet_pct"),
    }
    return _rounded(_union([df.withColumn("chart", F.lit(name)) for name, df in charts.items()]))


@query
def metric_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Top, bottom and last-ranked nation, averages and range of every metric."""
    rows = an.unpivoted(t.survey_columns(spark, sf), t.metrics().variables)
    value = F.col("valor")
    return rows.groupBy(F.col("id").alias("variable")).agg(
        an.top(value).alias("top"), an.bottom(value).alias("bottom"), an.last_ranked(value).alias("last"),
        F.round(an.average(value), 6).alias("average"), F.round(an.strict_average(value), 6).alias("strict_average"),
        an.value_range(value).alias("_range"),
    ).select(
        "variable", "top", "bottom", "last", "average", "strict_average",
        F.col("_range.lo").alias("lo"), F.col("_range.hi").alias("hi"),
    )


@query
def metric_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    board = _dashboard(spark, sf)
    return _rounded(board.heatmap([*fixed.ADOPTION_METRICS, "no_such_metric"]))


@query
def metric_radar(spark: SparkSession, sf: str) -> DataFrame:
    board = _dashboard(spark, sf)
    return board.radar([*fixed.ADOPTION_METRICS, "no_such_metric"])


@query
def section_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the five sections."""
    board = _dashboard(spark, sf)
    focus = {
        "territorial": _focus("localidades_con_4g_garantizada_pct"),
        "population": _focus("poblacion_en_localidades_con_4g_garantizada_pct"),
        "gap": ins.gap_focus("brecha_4g_pp"),
        "adoption": _focus("personas_usuarias_internet_pct"),
        "opportunity": _focus("personas_compras_internet_pct"),
    }
    return board.all_insights(focus)


@query
def executive_insights(spark: SparkSession, sf: str) -> DataFrame:
    return ins.executive_insights(_dashboard(spark, sf).scored)


@query
def metric_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences about one metric over all nations."""
    return ins.metric_insights(t.survey_columns(spark, sf), _focus("personas_con_smartphone_pct"))


@query
def menu_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(spark, sf).menu()


@query
def section_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of all sections, the score's among them."""
    board = _dashboard(spark, sf)
    focus = {
        "territorial": _focus("localidades_con_4g_garantizada_pct"),
        "population": _focus("poblacion_en_localidades_con_4g_garantizada_pct"),
        "gap": ins.gap_focus("brecha_4g_pp"),
        "adoption": _focus("personas_usuarias_internet_pct"),
        "opportunity": _focus("personas_compras_internet_pct"),
    }
    return board.all_cards(focus)


# --- quality ----------------------------------------------------------------------------


def _stored_forms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    long = t.survey_long(spark, sf)
    wide = survey.survey_wide(long, t.master(spark, sf), t.YEAR, t.metrics())
    return long, wide, observations.metric_catalog(spark, t.metrics().all)


@query
def metric_profile(spark: SparkSession, sf: str) -> DataFrame:
    _, wide, catalog = _stored_forms(spark, sf)
    return quality.metric_profile(wide, catalog)


@query
def validation_checks(spark: SparkSession, sf: str) -> DataFrame:
    long, wide, catalog = _stored_forms(spark, sf)
    return quality.validation_checks(long, wide, catalog, 25)


@query
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return quality.source_breakdown(t.survey_long(spark, sf))


@query
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are surplus to one per customer and status; rows outside a range."""
    long = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cve_ent"), F.col("o_orderstatus").alias("variable"),
        (F.col("o_totalprice") / 1000).alias("valor"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "%").otherwise("u").alias("unidad"),
    )
    counted = quality.duplicate_pairs(long).select(F.lit("duplicates").alias("kind"), F.col("duplicates").alias("n"))
    return counted.unionByName(quality.out_of_range(long).select(F.lit("out_of_range").alias("kind"), F.col("out_of_range").alias("n")))


@query
def raw_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, columns and blank keys of four raw tables."""
    return _raw_profiles(spark, sf).withColumn("columns", F.array_join("columns", ","))


def _raw_profiles(spark: SparkSession, sf: str) -> DataFrame:
    sources = [
        ("lineitem", ("l_orderkey", "l_quantity")), ("orders", ("o_orderkey",)), ("events", ("event_id", "props")),
        ("documents", ("doc_id", "lang")),
    ]
    profiles = [quality.source_profile(t.table(spark, sf, name), name, f"{name}.parquet", keys) for name, keys in sources]
    return _union(profiles)


@query
def written_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, columns and blank keys of two raw tables, counted by the jobs that store them."""

    def stored(name: str, keys: tuple[str, ...]) -> DataFrame:
        folder = t.scratch(spark, name)
        return quality.write_profiled(t.table(spark, sf, name), name, f"{name}.parquet", keys, lambda rows: rows.write.parquet(folder))

    profiles = [stored("orders", ("o_orderkey",)), stored("events", ("event_id", "props"))]
    return _union(profiles).withColumn("columns", F.array_join("columns", ","))


@query
def written_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of single values of the long table, counted by the job that stores it."""
    long, folder = t.survey_long(spark, sf), t.scratch(spark, "long")
    found = quality.write_measured(long, quality.value_measures(long), lambda rows: rows.write.parquet(folder))
    return spark.createDataFrame(list(found.items()), "measure string, n bigint")


@query
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The report in long form, raw tables included."""
    long, wide, catalog = _stored_forms(spark, sf)
    facts = quality.validation_facts(long, wide, catalog)
    return quality.report_lines(
        quality.summary_of(facts, 4), quality.source_breakdown(long),
        quality.checks_of(facts, 25), quality.metric_profile(wide, catalog), _raw_profiles(spark, sf),
    )


@query
def published_records(spark: SparkSession, sf: str) -> DataFrame:
    """Content of the record lines of the wide document, parsed back: one row per entity and metric."""
    long, wide, catalog = _stored_forms(spark, sf)
    head = publish.envelope(long, "2026-04-19", fixed.SURVEY_WIDE_ID, fixed.SURVEY_SOURCE)
    lines = publish.document_lines(wide, head, catalog).where("_section = 1")
    record = F.from_json(F.ltrim("value", F.lit(",")), WIDE_FIELDS)
    return lines.select(record.alias("r")).select("r.cve_ent", "r.estado", "r.region", F.explode("r.metrics").alias("variable", "valor"))


@query
def csv_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as delimited lines with quotes in a field, parsed by the CSV source: some columns, some typed."""
    orders = t.table(spark, sf, "orders").withColumn("note", F.concat(F.lit('"a", '), "o_orderpriority"))
    names = ["o_orderkey", "o_orderstatus", "note", "o_custkey"]
    lines = orders.select(F.to_csv(F.struct(*names), tables.QUOTES).alias("line"))
    return tables.parsed_lines(lines, "line", names, ["o_orderkey", "note", "o_custkey"], {"o_orderkey": "bigint"})


@query
def feature_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles written as GeoJSON features and read back by the polygon source, properties included."""
    tiles = cov.with_technology(cov.tiles_in_box(t.tiles(spark, sf), t.STRIP_BOX))
    lines = publish.features(tiles, ["event_id", "tech_proxy", "avg_d_mbps"])
    back = shapes.parsed_features(lines, "value", {"event_id": "bigint", "tech_proxy": "string", "avg_d_mbps": "double"})
    speed = F.round("avg_d_mbps", 6).alias("avg_d_mbps")
    return back.select("event_id", F.md5(geo.to_geojson(F.col("geometria"))).alias("shape"), "tech_proxy", speed)


@query
def published_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the enveloped wide document, counted by kind."""
    long, wide, catalog = _stored_forms(spark, sf)
    head = publish.envelope(long, "2026-04-19", fixed.SURVEY_WIDE_ID, fixed.SURVEY_SOURCE)
    lines = publish.document_lines(wide, head, catalog)
    return lines.groupBy(F.col("_section").alias("section")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").startswith(",")).alias("continued")
    )


# --- stored and versioned ---------------------------------------------------------------


@query
def running_share(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of order lines that came in three batches, one of them twice, with a merge in between."""
    lines = t.table(spark, sf, "lineitem").withColumn("_of", F.lit(t.YEAR))
    specs = [spec for spec in t.metrics().shares if spec.source_table == "usuarios"]
    totals = RunningTotals(spark, t.scratch(spark, "running"), specs)
    for batch in (0, 1, 0, 2):
        totals.add(f"part-{batch}", lines.where(F.col("l_orderkey") % 3 == batch), "l_suppkey", "l_quantity", "_of")
        if batch == 1:
            totals.compact()
    shares = totals.shares(t.YEAR, t.suppliers_of(spark, sf))
    return est.share_observations(shares, specs, t.master(spark, sf), t.YEAR, fixed.SURVEY_SOURCE).drop("secuencia")


@query
def stored_locality_share(spark: SparkSession, sf: str) -> DataFrame:
    """Locality shares from tables stored by year and bucket, which meet without a shuffle."""
    folder, name = t.scratch(spark, "survey"), f"survey_{uuid.uuid4().hex}"
    orders = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("CVEGEO"), F.year("o_orderdate").alias("ANIO"), "o_orderstatus", "o_orderpriority"
    )
    facts = layouts.store_connectivity(orders, f"{name}_facts", f"{folder}/facts", 8)
    places = layouts.store_localities(est.latest_localities(t.localities(spark, sf)), f"{name}_places", f"{folder}/places", 8)
    specs = t.metrics().localities
    shares = est.locality_shares(facts, places, specs, t.YEAR, "cvegeo", "anio", clean=True)
    return est.share_observations(shares, specs, t.master(spark, sf), t.YEAR, fixed.LOCALITY_SOURCE).drop("secuencia")


#: A part of the strip, a few degrees wide.
SMALL_BOX = (-110.0, 18.0, -104.0, 24.0)


@query
def clustered_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of a small box, from a layer stored along a space-filling curve."""
    path = t.scratch(spark, "tiles")
    layouts.write_clustered_tiles(t.tiles(spark, sf), path)
    return cov.tiles_in_box(spark.read.parquet(path), SMALL_BOX).select("event_id", "tests", "x_min", "y_max")


@query
def published_together(spark: SparkSession, sf: str) -> DataFrame:
    """The long table as JSON and CSV, read from the current version after a later publication failed half way."""
    folder, stored = t.scratch(spark, "published"), t.scratch(spark, "long")
    t.survey_long(spark, sf).select(*fixed.LONG_COLUMNS).write.parquet(stored)
    long = spark.read.parquet(stored)
    head = publish.envelope(long, "2026-04-19", fixed.SURVEY_LONG_ID, fixed.SURVEY_SOURCE)

    def failing(path: str) -> None:
        raise OSError("disk full")

    writers = {"long": lambda path: publish.write_long_json(long, path, head), "csv": lambda path: publish.write_long_csv(long, path)}
    versions.publish_together(spark, folder, writers)
    try:
        versions.publish_together(spark, folder, {"long": lambda path: publish.write_long_json(long.limit(1), path, head), "csv": failing})
    except OSError:
        pass
    stored = read_long(spark, versions.published(spark, folder, "long"), lines=True)
    lines = tables.read_delimited(spark, versions.published(spark, folder, "csv"), types={"anio": "int", "valor": "double"})
    return stored.select(*fixed.LONG_COLUMNS).intersectAll(lines.select(*fixed.LONG_COLUMNS))


@query
def catalog_log_variables(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog after two synchronisations, the second of which was overtaken by the first."""
    folder, specs = t.scratch(spark, "catalog"), _declared(spark, sf)
    none = spark.createDataFrame([], "variable string, fuente_sugerida string, sinonimos array<string>")
    blank = spark.createDataFrame([], "categoria_id string, nombre string, descripcion string")

    def additions(of: DataFrame):
        return lambda categories, variables: (cat.new_categories(categories, of, blank), cat.new_variables(variables, of, none))

    first = additions(specs.where(F.col("posicion") % 2 == 0))
    overtaken = []

    def second(categories: DataFrame, variables: DataFrame):
        if not overtaken:
            overtaken.append(catalog_log.append_catalog(spark, folder, first, "2026-04-19"))
        return additions(specs)(categories, variables)

    catalog_log.append_catalog(spark, folder, second, "2026-04-20")
    _, variables, updated_at = catalog_log.read_catalog_log(spark, folder)
    return variables.select("variable_id", "categoria_id", "unidad_base", F.lit(updated_at).alias("updated_at"))


@query
def marked_microdata(spark: SparkSession, sf: str) -> DataFrame:
    """Persons from UTF-8 files that each begin with a byte order mark: some columns, codes with their zeros."""
    path, customer = t.scratch(spark, "persons"), t.table(spark, sf, "customer")
    persons = customer.select(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("\ufeffENT"), F.concat(F.lit('Año "1", '), "c_name").alias("NOMBRE"),
        F.col("c_mktsegment").alias("SECTOR"), F.col("c_custkey").alias("FOLIO"),
    )
    persons.write.option("header", True).options(**tables.QUOTES).csv(path)
    return tables.read_microdata(spark, path, ["ENT", "NOMBRE", "FOLIO", "FALTA"])


@query
def latin1_localities(spark: SparkSession, sf: str) -> DataFrame:
    """Localities from files in Latin-1."""
    path, customer = t.scratch(spark, "latin1"), t.table(spark, sf, "customer")
    places = customer.select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("CVEGEO"), F.concat(F.lit("Peñón Güémez, "), "c_name").alias("NOM_LOC"),
        F.col("c_nationkey").alias("AÑO"),
    )
    places.write.option("header", True).option("encoding", tables.LATIN1).options(**tables.QUOTES).csv(path)
    return tables.read_latin1(spark, path).withColumnRenamed("AÑO", "ANIO")


@query
def enveloped_master(spark: SparkSession, sf: str) -> DataFrame:
    """The entity master written as one enveloped document and read back, aliases one a row."""
    path, master = t.scratch(spark, "master"), t.master(spark, sf)
    head = spark.createDataFrame([("2026-04-19", "MX")], "updated_at string, country string")
    publish.write_entity_master(master, head, path)
    return read_entity_master(spark, path).select("state_code", "cve_ent", "estado", "region", "capital", F.explode("aliases").alias("alias"))


@query
def coverage_frames(spark: SparkSession, sf: str) -> DataFrame:
    """States of the published frames, where rolling up the published municipalities gives the same."""
    path, stored = t.scratch(spark, "frames"), t.scratch(spark, "municipalities")
    classified = network.classified_tiles(t.tiles(spark, sf), t.territories(spark, sf), t.STRIP_BOX)
    cov.by_municipality(classified).write.parquet(stored)
    municipalities = spark.read.parquet(stored)
    states = cov.by_state(municipalities)
    publish.write_coverage(municipalities, states, path)
    read = {name: spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in (("municipios", municipalities), ("estados", states))}
    return _rounded(read["estados"], 9).intersectAll(_rounded(cov.by_state(read["municipios"]), 9))
