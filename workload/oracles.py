"""The registered queries in SQL, written for DuckDB over the same tables.

Shared parts are common table expressions. The per-metric columns are spelled out from the same
declarations the queries use; everything else is independent of the library.
"""

from __future__ import annotations

import math

from comarca import fixed_values as fixed
from workload import tables as t

SURVEY = t.metrics()
VARIABLES = SURVEY.variables
LINE_SPECS = [s for s in SURVEY.shares if s.source_table == "usuarios"]
ORDER_SPECS = [s for s in SURVEY.shares if s.source_table == "usuarios2"]
SCORE_NAMES = [name for name, _ in fixed.MARKET_WEIGHTS + fixed.WHITESPACE_WEIGHTS]
TELEDENSITY = "teledensidad_internet_movil"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(spec) -> str:
    values = ", ".join(_text(v) for v in spec.positive_values)
    return f"CAST({spec.column} AS VARCHAR) IN ({values})"


def _sums(specs, weight: str) -> str:
    return ", ".join(f"sum(CASE WHEN {_in(s)} THEN {weight} ELSE 0 END) AS {s.variable}" for s in specs)


def _share(part: str, whole: str) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0, 2)"


def _labels(specs, source: str, year: int) -> str:
    rows = ", ".join(
        f"({_text(s.variable)}, {_text(s.categoria)}, {_text(s.unidad)}, {year}, {_text(source)})" for s in specs
    )
    return f"SELECT * FROM (VALUES {rows}) AS v(variable, categoria, unidad, anio, fuente)"


def _unpivot(table: str, specs, shares: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT cve_ent, {_text(s.variable)} AS variable, {shares[s.variable]} AS valor FROM {table}" for s in specs
    )


MASTER = """
master AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_code,
         lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS cve_ent, n_name AS estado, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

LINES = f"""
line_totals AS (
  SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS cve_ent,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS total, {_sums(LINE_SPECS, 'CAST(l_quantity AS DECIMAL(18,2))')}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
line_values AS ({_unpivot('line_totals', LINE_SPECS, {s.variable: _share(s.variable, 'total') for s in LINE_SPECS})})"""

ORDERS = f"""
order_totals AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_ent,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, {_sums(ORDER_SPECS, 'CAST(o_totalprice AS DECIMAL(18,2))')}
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
order_values AS ({_unpivot('order_totals', ORDER_SPECS, {s.variable: _share(s.variable, 'total') for s in ORDER_SPECS})})"""

PUBLISHED = f"""
published AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_ent, month(o_orderdate) AS mes, CAST(count(*) AS DOUBLE) AS valor
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = {t.YEAR} GROUP BY 1, 2)"""

_POPULATION = "greatest(CAST(c_acctbal AS DECIMAL(18,2)), 0)"
_WEIGHTS = {"poblacion": _POPULATION, "hogares": f"floor({_POPULATION} / 100)", "localidades": "1"}
_WHOLE = {s.variable: s.weight for s in SURVEY.localities}
LOCALITIES = f"""
locality_rows AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_ent, o_orderstatus, o_orderpriority,
         {', '.join(f'CAST({sql} AS DECIMAL(18,4)) AS {name}' for name, sql in _WEIGHTS.items())}
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = {t.YEAR}),
locality_totals AS (
  SELECT cve_ent, {', '.join(f'sum({name}) AS total_{name}' for name in _WEIGHTS)},
         {', '.join(f"sum(CASE WHEN {_in(s)} THEN {s.weight} ELSE 0 END) AS {s.variable}" for s in SURVEY.localities)}
  FROM locality_rows GROUP BY 1),
locality_values AS ({' UNION ALL '.join(
    f"SELECT cve_ent, {_text(s.variable)} AS variable, {_share(s.variable, 'total_' + s.weight)} AS valor "
    f"FROM locality_totals WHERE total_{s.weight} <> 0" for s in SURVEY.localities)})"""

LONG = f"""{MASTER}, {LINES}, {ORDERS}, {PUBLISHED}, {LOCALITIES},
labels AS ({_labels(SURVEY.shares, fixed.SURVEY_SOURCE, t.YEAR)}
  UNION ALL {_labels(SURVEY.direct, SURVEY.direct[0].fuente, t.YEAR)}
  UNION ALL {_labels(SURVEY.localities, fixed.LOCALITY_SOURCE, t.YEAR)}),
all_values AS (
  SELECT cve_ent, variable, valor, 0 AS mes FROM line_values
  UNION ALL SELECT cve_ent, variable, valor, 0 FROM order_values
  UNION ALL SELECT cve_ent, '{TELEDENSITY}', valor, mes FROM published
  UNION ALL SELECT cve_ent, variable, valor, 0 FROM locality_values),
long AS (
  SELECT state_code, m.cve_ent, estado, categoria, l.variable, valor, anio, fuente, unidad, mes
  FROM all_values a JOIN master m ON a.cve_ent = m.cve_ent JOIN labels l ON a.variable = l.variable)"""

WIDE = f"""{LONG},
last_values AS (
  SELECT cve_ent, variable, valor FROM (
    SELECT cve_ent, variable, valor, row_number() OVER (PARTITION BY cve_ent, variable ORDER BY mes DESC, valor DESC) AS rn FROM long)
  WHERE rn = 1),
wide AS (
  SELECT m.state_code, m.cve_ent, m.estado, m.region,
         {', '.join(f"max(CASE WHEN variable = '{v}' THEN valor END) AS {v}" for v in VARIABLES)}
  FROM last_values v JOIN master m ON v.cve_ent = m.cve_ent GROUP BY ALL)"""

ZEROED = f"""
z AS (SELECT cve_ent, estado, region, {', '.join(f'coalesce({v}, 0) AS {v}' for v in VARIABLES)} FROM wide)"""


def _selection(names: list[str] | None) -> str:
    where = f" WHERE estado IN ({', '.join(_text(n) for n in names)})" if names else ""
    return f"s AS (SELECT * FROM z{where})"


def _scored(names: list[str] | None) -> str:
    """Selected records with ranges, scaled metrics and scores."""
    spans = ", ".join(f"min({v}) AS lo_{v}, max({v}) AS hi_{v}" for v in SCORE_NAMES)
    scaled = ", ".join(
        f"CASE WHEN hi_{v} = lo_{v} THEN 0.5 ELSE ({v} - lo_{v}) / (hi_{v} - lo_{v}) END AS n_{v}" for v in SCORE_NAMES
    )
    market = " + ".join(f"n_{v} * CAST({w} AS DOUBLE)" for v, w in fixed.MARKET_WEIGHTS)
    space = " + ".join(f"(1 - n_{v}) * CAST({w} AS DOUBLE)" for v, w in fixed.WHITESPACE_WEIGHTS)
    return f"""{_selection(names)},
spans AS (SELECT {spans} FROM s),
scaled AS (SELECT s.*, {scaled} FROM s CROSS JOIN spans),
parts AS (SELECT *, {market} AS market, {space} AS space FROM scaled),
scored AS (SELECT *, (market * CAST(0.65 AS DOUBLE) + space * CAST(0.35 AS DOUBLE)) * 100 AS score,
                  market * 100 AS market_score, space * 100 AS space_score FROM parts)"""


GAPS = ", ".join(f"{row[6]} - {row[5]} AS {row[0]}" for row in fixed.GAP_METRICS)
GAPPED = f"g AS (SELECT *, {GAPS} FROM scored)"


def _top(table: str, value: str) -> str:
    return f"(SELECT estado FROM {table} ORDER BY {value} DESC, cve_ent LIMIT 1)"


def _bottom(table: str, value: str) -> str:
    return f"(SELECT estado FROM {table} ORDER BY {value}, cve_ent LIMIT 1)"


def _last(table: str, value: str) -> str:
    return f"(SELECT estado FROM {table} ORDER BY {value}, cve_ent DESC LIMIT 1)"


def _mean(table: str, value: str) -> str:
    return f"(SELECT sum({value}) / count(*) FROM {table})"


def _one_decimal(value: str) -> str:
    return f"printf('%.1f', CAST(round({value}, 1) AS DOUBLE))"


def _sentence(template: str, values: dict[str, str]) -> str:
    pieces = []
    rest = template
    while rest:
        before, brace, tail = rest.partition("{")
        if before:
            pieces.append(_text(before))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(values[name])
    return " || ".join(pieces)


def _sentences(templates: list[str], values: dict[str, str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS posicion, {_sentence(template, values)} AS texto{extra}" for i, template in enumerate(templates)
    )


def _label(variable: str) -> str:
    return next(s.label for s in SURVEY.all if s.variable == variable)


def _low(text: str) -> str:
    return _text(text.lower())


SQL: dict[str, str] = {}

_LONG_LIST = ", ".join(fixed.LONG_COLUMNS)

_FAMILY = """SELECT m.state_code, m.cve_ent, m.estado, l.categoria, l.variable, v.valor, l.anio, l.fuente, l.unidad
FROM {values} v JOIN master m ON v.cve_ent = m.cve_ent JOIN labels l ON v.variable = l.variable{where}"""

SQL["weighted_share"] = f"""WITH {MASTER}, {LINES}, labels AS ({_labels(LINE_SPECS, fixed.SURVEY_SOURCE, t.YEAR)})
{_FAMILY.format(values='line_values', where=" WHERE v.variable = 'personas_compras_internet_pct'")}"""

SQL["weighted_share_by_key"] = f"""WITH totals AS (
  SELECT o_orderpriority AS cve_ent, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
         {', '.join(f"sum(CASE WHEN {_in(s)} THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS {s.variable}" for s in ORDER_SPECS)}
  FROM orders GROUP BY 1)
SELECT cve_ent, {', '.join(f"{_share(s.variable, 'total')} AS {s.variable}" for s in ORDER_SPECS)} FROM totals"""

SQL["weighted_share_long"] = f"""WITH {MASTER}, {LINES}, labels AS ({_labels(LINE_SPECS, fixed.SURVEY_SOURCE, t.YEAR)})
{_FAMILY.format(values='line_values', where='')}"""

SQL["locality_share"] = f"""WITH {MASTER}, {LOCALITIES}, labels AS ({_labels(SURVEY.localities, fixed.LOCALITY_SOURCE, t.YEAR)})
{_FAMILY.format(values='locality_values', where='')}"""

SQL["direct_value"] = f"""WITH {MASTER}, {PUBLISHED}, labels AS ({_labels(SURVEY.direct, SURVEY.direct[0].fuente, t.YEAR)})
SELECT m.state_code, m.cve_ent, m.estado, categoria, variable, valor, anio, fuente, unidad, CAST(mes AS BIGINT) AS secuencia
FROM published p JOIN master m ON p.cve_ent = m.cve_ent CROSS JOIN labels"""

SQL["last_row_wins"] = """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""

SQL["survey_long"] = f"WITH {LONG} SELECT {_LONG_LIST} FROM long"
SQL["survey_wide"] = f"WITH {WIDE} SELECT state_code, cve_ent, estado, region, {t.YEAR} AS anio, {', '.join(VARIABLES)} FROM wide"
SQL["wide_to_long"] = f"WITH {WIDE} SELECT cve_ent, variable, valor FROM last_values"
SQL["catalog_coverage"] = f"""WITH {LONG}, catalog AS (SELECT * FROM (VALUES {', '.join(
    f"({i}, {_text(s.variable)}, {_text(s.categoria)}, {_text(s.label)}, {_text(s.unidad)}, {_text(s.source_table)})"
    for i, s in enumerate(SURVEY.all))}) AS v(posicion, variable_id, categoria_id, label, unidad, source_table))
SELECT posicion, variable_id, categoria_id, c.label, c.unidad, source_table, count(variable) AS records
FROM catalog c LEFT JOIN long ON variable = variable_id GROUP BY ALL"""

# --- text and lookups -------------------------------------------------------------------
_UNACCENTED = "strip_accents(lower({0}))"
SQL["text_fold"] = r"""WITH f AS (
  SELECT doc_id, regexp_replace(strip_accents(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(13))), '[^\x00-\x7F]', '', 'g') AS folded FROM documents)
SELECT doc_id, md5(folded) AS folded, CAST(length(folded) AS INTEGER) AS n FROM f"""
SQL["text_slug"] = """WITH f AS (
  SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents)
SELECT doc_id, md5(slug) AS slug, CAST(length(slug) AS INTEGER) AS n FROM f"""
_UP = "CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END"
SQL["text_title"] = rf"""WITH f AS (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS line FROM conversations)
SELECT conv_id, turn,
  md5(array_to_string(list_transform(list_filter(string_split(lower(line), ' '), lambda w: w <> ''), lambda w: {_UP} || w[2:]), ' ')) AS words,
  md5(array_to_string(list_transform(regexp_extract_all(line, '\p{{L}}*[^\p{{L}}]|\p{{L}}+$'), lambda w: {_UP} || lower(w[2:])), '')) AS runs FROM f"""
SQL["canonical_names"] = """SELECT
  CASE p_name WHEN 'red widget' THEN 'Widget Rojo' WHEN 'blue bolt' THEN 'Perno Azul' WHEN 'small ring' THEN 'Anillo'
    ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS nombre,
  CASE p_name WHEN 'red widget' THEN 'widget_rojo_pct' WHEN 'hot gear' THEN 'engrane_indice' ELSE replace(p_name, ' ', '_') END AS variable,
  count(*) AS n FROM part GROUP BY 1, 2"""
SQL["zero_filled_codes"] = """SELECT
  CASE WHEN length(CAST(p_size AS VARCHAR)) >= 2 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS talla,
  lpad(replace(p_brand, 'Brand#', ''), 3, '0') AS marca, count(*) AS n FROM part GROUP BY 1, 2"""
SQL["alias_lookup"] = f"""WITH {MASTER}, names AS (
  SELECT cve_ent, unnest([estado, 'Nación ' || CAST(CAST(cve_ent AS INTEGER) AS VARCHAR), 'N.' || CAST(CAST(cve_ent AS INTEGER) AS VARCHAR)]) AS name FROM master),
folded AS (SELECT DISTINCT cve_ent, strip_accents(lower(trim(name))) AS name FROM names),
written AS (SELECT CASE WHEN c_acctbal < 0 THEN 'Ultramar ' || c_nationkey WHEN c_mktsegment = 'BUILDING' THEN '  NACIÓN ' || c_nationkey
    WHEN c_mktsegment = 'FURNITURE' THEN 'n.' || c_nationkey || ' ' WHEN c_mktsegment = 'MACHINERY' THEN 'Nación ' || c_nationkey
    ELSE 'nation_' || c_nationkey END AS nombre FROM customer)
SELECT f.cve_ent, count(*) AS customers, count(DISTINCT nombre) AS spellings
FROM written w LEFT JOIN folded f ON strip_accents(lower(trim(w.nombre))) = f.name GROUP BY 1"""

# --- sheets and context -----------------------------------------------------------------
_PATTERNS = [("licencia", "license"), ("acentos", "É[lt]"), ("euros", "der|die|das"), ("correo", r"[a-z]+@[a-z]+\.")]
SQL["label_lookup"] = f"""WITH d AS (
  SELECT source AS sheet, CAST(replace(source, 'src', '') AS INTEGER) AS sheet_pos, doc_id, text,
         CASE WHEN lang = 'de' THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS v FROM documents WHERE source <> 'src3'),
hits AS (SELECT sheet, sheet_pos, {', '.join(
    f"min(doc_id) FILTER (regexp_matches(text, {_text('(?i)' + pattern)})) AS d_{name}" for name, pattern in _PATTERNS)} FROM d GROUP BY 1, 2)
SELECT h.sheet, h.sheet_pos, {', '.join(f"(SELECT v FROM d WHERE d.doc_id = h.d_{name}) AS {name}" for name, _ in _PATTERNS)}
FROM hits h WHERE sheet_pos > (SELECT min(sheet_pos) FROM d)"""
SQL["sheet_last_column"] = """WITH c AS (
  SELECT n_name, r_name, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
last AS (SELECT r_name, max(y) AS y FROM c GROUP BY 1)
SELECT r_name AS sheet, n_name AS estado, CAST(c.n AS DOUBLE) AS pib_total
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN last USING (r_name) LEFT JOIN c USING (n_name, r_name, y)"""
SQL["census_states"] = """SELECT CASE WHEN length(CAST(c_nationkey + 1 AS VARCHAR)) < 2 THEN '0' || CAST(c_nationkey + 1 AS VARCHAR) ELSE CAST(c_nationkey + 1 AS VARCHAR) END AS cve_ent,
  CAST(count(*) AS DOUBLE) AS poblacion_total, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) AS poblacion_edad_laboral,
  CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) AS poblacion_economicamente_activa, CAST(NULL AS DOUBLE) AS poblacion_afiliada_imss,
  CAST(count(*) FILTER (c_acctbal > 9000) AS DOUBLE) AS total_viviendas FROM customer GROUP BY c_nationkey"""
_CONTEXT = {v[0]: v for v in fixed.CONTEXT_VARIABLES}
_LIMITS = (0, 500, 1000, 2000, 3000, 4000, 5000, 6000)
_CONTEXT_VALUES = {name: name for name, _ in fixed.POVERTY_LABELS} | {
    "pib_total": "pib_total", "pib_per_capita": "pib_total / people", "poblacion_total": "people",
    "poblacion_edad_laboral_pct": "of_age / people * 100", "poblacion_economicamente_activa_pct": "active / people * 100",
    "poblacion_afiliada_imss_pct": "insured / people * 100",
}
SQL["context_long"] = f"""WITH {MASTER}, poverty AS (
  SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS cve_ent,
         {', '.join(f"CAST(count(*) FILTER (s_acctbal < {limit}) * 100.0 AS DOUBLE) / count(*) AS {name}" for (name, _), limit in zip(fixed.POVERTY_LABELS, _LIMITS))}
  FROM supplier GROUP BY 1),
product AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_ent,
  CASE WHEN c_nationkey = 5 THEN NULL ELSE CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS pib_total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
census AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_ent, CAST(count(*) AS DOUBLE) AS people,
  CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) AS of_age, CAST(count(*) FILTER (c_mktsegment = 'MACHINERY') AS DOUBLE) AS active,
  CAST(count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS DOUBLE) AS insured FROM customer GROUP BY 1),
merged AS (SELECT * FROM poverty LEFT JOIN product USING (cve_ent) LEFT JOIN census USING (cve_ent)),
v AS ({' UNION ALL '.join(
    f"SELECT cve_ent, {_text(_CONTEXT[name][2])} AS categoria, {_text(name)} AS variable, round_even({sql}, 4) AS valor, {_CONTEXT[name][1]} AS anio, {_text(_CONTEXT[name][4])} AS unidad FROM merged"
    for name, sql in _CONTEXT_VALUES.items())})
SELECT state_code, cve_ent, estado, categoria, variable, valor, anio, {_text(fixed.CONTEXT_SOURCE)} AS fuente, unidad
FROM v JOIN master USING (cve_ent) WHERE valor IS NOT NULL"""

# --- catalog ----------------------------------------------------------------------------
_DECLARED = """
declared AS (SELECT p_partkey AS posicion,
    replace(p_name || ' ' || lower(p_type), ' ', '_') || CASE WHEN p_type = 'PROMO' THEN '_pct' ELSE '' END AS variable,
    'cat_5' || lower(p_type) AS categoria, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
    CASE WHEN p_type = 'SMALL' THEN ' % ' WHEN p_type = 'LARGE' THEN 'USD millones' ELSE 'piezas' END AS unidad,
    CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS fuente, CASE WHEN p_size > 40 THEN p_name END AS sinonimos FROM part),
existing AS (SELECT replace(p_name || ' ' || lower(p_type), ' ', '_') AS variable_id, min(p_partkey) AS posicion FROM part WHERE p_size = 1 GROUP BY 1),
meta AS (SELECT replace(p_name || ' ' || lower(p_type), ' ', '_') AS variable, max(p_brand) AS fuente, max(p_type) AS tipo FROM part GROUP BY 1),
fresh AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY variable ORDER BY posicion) AS rn FROM declared d) d
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.variable_id = d.variable)),
existing_categories AS (SELECT 'cat_5economy' AS categoria_id WHERE EXISTS (SELECT 1 FROM part WHERE p_type = 'ECONOMY')),
fresh_categories AS (SELECT categoria, min(posicion) AS posicion FROM declared d
  WHERE NOT EXISTS (SELECT 1 FROM existing_categories e WHERE e.categoria_id = d.categoria) GROUP BY 1)"""
SQL["catalog_variables"] = f"""WITH {_DECLARED}
SELECT variable_id, 'cat_5economy' AS categoria_id, 'viejo' AS nombre, '' AS descripcion, 'u' AS unidad_base, 'number' AS tipo_valor,
  'latest' AS agregacion_default, '' AS fuente_sugerida, '' AS sinonimos, posicion FROM existing
UNION ALL SELECT f.variable, categoria, label, label || ' (año {t.YEAR}).', unidad,
  CASE WHEN f.variable LIKE '%\\_pct' ESCAPE '\\' OR trim(unidad) = '%' THEN 'percentage' WHEN unidad = 'USD millones' THEN 'currency' ELSE 'number' END,
  'avg', coalesce(nullif(f.fuente, ''), nullif(m.fuente, ''), 'Fuente general'), coalesce(f.sinonimos, m.tipo, ''),
  f.posicion + coalesce((SELECT max(posicion) + 1 FROM existing), 0)
FROM fresh f LEFT JOIN meta m ON f.variable = m.variable"""
SQL["catalog_categories"] = f"""WITH {_DECLARED}
SELECT categoria_id, 'Economy' AS nombre, '' AS descripcion, CAST(0 AS BIGINT) AS posicion FROM existing_categories
UNION ALL SELECT categoria, CASE WHEN categoria = 'cat_5small' THEN 'Pequeñas' ELSE 'Cat 5' || upper(categoria[6]) || categoria[7:] END,
  CASE WHEN categoria = 'cat_5small' THEN 'Piezas pequeñas.' ELSE {_text(fixed.CATEGORY_FALLBACK_DESCRIPTION)} END,
  posicion + (SELECT CAST(count(*) AS BIGINT) FROM existing_categories) FROM fresh_categories"""
SQL["catalog_added"] = f"""WITH {_DECLARED}
SELECT 'category' AS kind, categoria AS id FROM fresh_categories UNION ALL SELECT 'variable', variable FROM fresh"""
SQL["metric_options"] = """WITH m AS (
  SELECT replace(p_name, ' ', '_') AS id, p_name AS label, min(p_partkey) AS posicion,
         min(CASE WHEN p_size > 48 THEN 'cobertura_red' ELSE lower(p_type) END) AS c FROM part GROUP BY 1, 2),
metrics AS (SELECT id, label, posicion, CASE c WHEN 'cobertura_red' THEN 'Cobertura de red' ELSE c END AS category FROM m),
wanted AS (SELECT * FROM (VALUES (0, 'red_widget'), (1, 'no_such_metric'), (2, 'hot_gear'), (3, 'blue_bolt')) AS v(place, id))
SELECT 'listed' AS kind, id, label, category, CAST(place AS BIGINT) AS posicion FROM metrics JOIN wanted USING (id)
UNION ALL SELECT 'category', id, label, category, posicion FROM metrics WHERE category = 'Cobertura de red'
UNION ALL SELECT 'definition', id, label, category, 0 FROM metrics WHERE id = 'small_ring'
UNION ALL SELECT 'all', id, label, category, posicion FROM metrics"""


def _pairs(kind: str, pairs: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"({_text(a)}, {_text(b)}, {_text(c)})" for a, b, c in pairs)
    return f"""SELECT i.id, n, coalesce(m, {_text(pairs[-1][1])}) AS paired_metric, coalesce(l, {_text(pairs[-1][2])}) AS paired_label, '{kind}' AS kind
FROM ids i LEFT JOIN (VALUES {rows}) AS v(id, m, l) ON i.id = v.id"""


SQL["metric_pairs"] = f"""WITH {LONG}, ids AS (SELECT variable AS id, count(*) AS n FROM long GROUP BY 1)
{_pairs('population', fixed.POPULATION_PAIRS)} UNION ALL {_pairs('adoption', fixed.ADOPTION_PAIRS)}"""

# --- coverage and places ----------------------------------------------------------------
_CLASS = "CASE WHEN mbps < 10 THEN '3G' WHEN mbps < 40 THEN '4G' ELSE '5G' END"


def _rolled(rows: str, count: str = "count(*)") -> str:
    """Municipality and state roll-ups of rows(ent, geo, nom, mbps, tests)."""
    return f"""{rows},
classed AS (SELECT *, {_CLASS} AS tech FROM tiles),
modes AS (SELECT ent, geo, tech FROM (SELECT ent, geo, tech, row_number() OVER (PARTITION BY ent, geo ORDER BY count(*) DESC, tech) AS rn
  FROM classed GROUP BY ent, geo, tech) WHERE rn = 1),
mun AS (SELECT c.ent, c.geo, nom, avg(mbps) AS speed, m.tech, count(*) AS n, CAST(sum(tests) AS BIGINT) AS tests,
  avg(CASE WHEN c.tech = '3G' THEN 100 ELSE 0 END) AS p3, avg(CASE WHEN c.tech = '4G' THEN 100 ELSE 0 END) AS p4,
  avg(CASE WHEN c.tech = '5G' THEN 100 ELSE 0 END) AS p5
  FROM classed c JOIN modes m ON c.ent = m.ent AND c.geo = m.geo GROUP BY c.ent, c.geo, nom, m.tech)"""


_MUN = """SELECT ent AS CVE_ENT, geo AS id_cvegeo, nom AS nom_mun, round(speed, 9) AS int_avg_speed, tech AS int_tech_predominante,
  n AS geometry, tests, round(p3, 9) AS int_pct_3g_coverage, round(p4, 9) AS int_pct_4g_coverage, round(p5, 9) AS int_pct_5g_coverage FROM mun"""
_STATE = """, state_modes AS (SELECT ent, tech FROM (SELECT ent, tech, row_number() OVER (PARTITION BY ent ORDER BY count(*) DESC, tech) AS rn
  FROM mun GROUP BY ent, tech) WHERE rn = 1)
SELECT mun.ent AS CVE_ENT, round(avg(speed), 9) AS int_avg_speed, round(avg(p3), 9) AS int_pct_3g_coverage, round(avg(p4), 9) AS int_pct_4g_coverage,
  round(avg(p5), 9) AS int_pct_5g_coverage, s.tech AS int_tech_predominante FROM mun JOIN state_modes s ON mun.ent = s.ent GROUP BY mun.ent, s.tech"""
_EVENT_ROWS = """tiles AS (SELECT event_type AS ent, event_type || '-' || user_id AS geo, 'user ' || user_id AS nom,
  value * 1000 / 1000 AS mbps, user_id AS tests FROM events)"""
SQL["coverage_municipality"] = f"WITH {_rolled(_EVENT_ROWS)} {_MUN}"
SQL["coverage_state"] = f"WITH {_rolled(_EVENT_ROWS)} {_STATE}"
SQL["commonest_event"] = """SELECT user_id, event_type FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1"""
_PLACES = """places AS (SELECT event_id, user_id, value, -119.0::DOUBLE + event_id * 15 / 1024.0::DOUBLE AS x,
  13.0::DOUBLE + ((event_id * 7919 + user_id * 131) % 21504) / 1024.0::DOUBLE AS y FROM events),
land AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS ent, CAST(s_suppkey AS VARCHAR) AS geo, s_name AS nom,
  -119.0::DOUBLE + s_suppkey * 1536 / 1024.0::DOUBLE AS cx, 14.0::DOUBLE + ((s_suppkey * 2741) % 18432) / 1024.0::DOUBLE AS cy,
  (1 + (s_suppkey * 613) % 2048) / 1024.0::DOUBLE AS r FROM supplier)"""
_BOX = """x + 1/512.0::DOUBLE >= -118.5 AND y + 1/512.0::DOUBLE >= 14.5 AND y - 1/512.0::DOUBLE <= 32.7"""
SQL["point_in_polygon"] = f"WITH {_PLACES} SELECT event_id, geo AS CVEGEO FROM places JOIN land ON abs(x - cx) + abs(y - cy) < r"
_TILE_ROWS = f"""{_PLACES}, tiles AS (SELECT ent, geo, nom, value * 1000 / 1000 AS mbps, user_id AS tests
  FROM places JOIN land ON abs(x - cx) + abs(y - cy) < r WHERE {_BOX})"""
SQL["tile_coverage"] = f"WITH {_rolled(_TILE_ROWS)} {_MUN}"
SQL["tile_coverage_state"] = f"WITH {_rolled(_TILE_ROWS)} {_STATE}"
_H = "0.001953125::DOUBLE"
SQL["tile_features"] = f"""WITH {_PLACES}, b AS (SELECT event_id, value AS mbps, x - {_H} AS w, x + {_H} AS e, y - {_H} AS s, y + {_H} AS n FROM places WHERE {_BOX})
SELECT event_id, md5('{{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]}}') AS shape,
  {_CLASS} AS tech_proxy FROM b"""
SQL["polygon_area"] = f"WITH {_PLACES} SELECT geo AS CVEGEO, 2 * r * r AS area, cx, cy, cx - r AS x_min, cy + r AS y_max FROM land"


def _lambert() -> tuple[str, str]:
    """The projection in SQL, for columns lon and lat."""
    p = fixed.LCC_MEXICO
    f = 1 / p["inverse_flattening"]
    e = math.sqrt(2 * f - f * f)
    a1, a2, a0 = (math.radians(p[k]) for k in ("latitude_1", "latitude_2", "latitude_0"))

    def m(a):
        return math.cos(a) / math.sqrt(1 - e * e * math.sin(a) ** 2)

    def u(a):
        return math.tan(math.pi / 4 - a / 2) / ((1 - e * math.sin(a)) / (1 + e * math.sin(a))) ** (e / 2)

    n = math.log(m(a1) / m(a2)) / math.log(u(a1) / u(a2))
    big = p["semi_major"] * m(a1) / (n * u(a1) ** n)
    rho = (
        f"({big!r}::DOUBLE * pow(tan({math.pi / 4!r}::DOUBLE - radians(lat) / 2) / "
        f"pow((1 - {e!r}::DOUBLE * sin(radians(lat))) / (1 + {e!r}::DOUBLE * sin(radians(lat))), {e / 2!r}::DOUBLE), {n!r}::DOUBLE))"
    )
    angle = f"({n!r}::DOUBLE * radians(lon - ({p['longitude_0']!r}::DOUBLE)))"
    return (
        f"{p['false_easting']!r}::DOUBLE + {rho} * sin{angle}",
        f"{p['false_northing'] + big * u(a0) ** n!r}::DOUBLE - {rho} * cos{angle}",
    )


_X, _Y = _lambert()
SQL["population_density"] = f"""WITH {_PLACES},
corners AS (SELECT ent, geo, unnest([0, 1, 2, 3]) AS i, unnest([cx + r, cx, cx - r, cx]) AS lon, unnest([cy, cy + r, cy, cy - r]) AS lat FROM land),
metres AS (SELECT ent, geo, i, {_X} AS x, {_Y} AS y FROM corners),
xy AS (SELECT ent, geo, i, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y FROM metres WINDOW w AS (PARTITION BY geo ORDER BY i)),
areas AS (SELECT a.ent, a.geo, abs(sum(a.x * b.y - b.x * a.y)) / 2 / 1e6 AS km2 FROM xy a JOIN xy b ON a.geo = b.geo AND b.i = (a.i + 1) % 4 GROUP BY 1, 2),
land_areas AS (SELECT ent, sum(km2) AS km2 FROM areas GROUP BY 1),
people AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ent, count(*) AS n FROM customer GROUP BY 1)
SELECT ent AS cve_ent, round(n / km2, 4) AS densidad_poblacional FROM people JOIN land_areas USING (ent)"""

# --- dashboard analytics ----------------------------------------------------------------
_SCORES = """SELECT cve_ent, estado, round(score, 6) AS "opportunityScore", round(market_score, 6) AS "marketAttractiveness",
  round(space_score, 6) AS "whitespaceScore" FROM scored"""
SQL["min_max_normalised"] = f"""WITH {WIDE}, {ZEROED}, {_scored(None)}
SELECT cve_ent, estado, {', '.join(f'round(n_{v}, 6) AS {v}' for v in SCORE_NAMES)} FROM scored"""
SQL["opportunity_score"] = f"WITH {WIDE}, {ZEROED}, {_scored(None)} {_SCORES}"
SQL["opportunity_selected"] = f"WITH {WIDE}, {ZEROED}, {_scored(t.SELECTED)} {_SCORES}"
SQL["coverage_gaps"] = f"""WITH {WIDE}, {ZEROED}
SELECT cve_ent, estado, {', '.join(f'round({r[6]} - {r[5]}, 6) AS {r[0]}' for r in fixed.GAP_METRICS)} FROM z"""
SQL["metric_ranking"] = f"WITH {WIDE}, {ZEROED} SELECT cve_ent, estado, personas_usuarias_internet_pct AS valor FROM z"
SQL["metric_dumbbell"] = f"""WITH {WIDE}, {ZEROED}, {_selection(t.SELECTED)}, p AS (
  SELECT cve_ent, estado, localidades_con_5g_garantizada_pct AS l, poblacion_en_localidades_con_5g_garantizada_pct AS r FROM s)
SELECT cve_ent, estado, l AS "left", r AS "right", greatest(0, least(100, l)) AS left_position, greatest(0, least(100, r)) AS right_position FROM p"""
SQL["metric_scatter"] = f"""WITH {WIDE}, {ZEROED}, {_scored(t.SELECTED)}
SELECT cve_ent, estado, {TELEDENSITY} AS x, localidades_con_4g_garantizada_pct AS y, poblacion_en_localidades_con_5g_garantizada_pct AS z, 'territorial' AS chart FROM s
UNION ALL SELECT cve_ent, estado, poblacion_en_localidades_con_4g_garantizada_pct, personas_usuarias_internet_pct, NULL, 'adoption' FROM s
UNION ALL SELECT cve_ent, estado, round(score, 6), personas_compras_internet_pct, poblacion_en_localidades_con_5g_garantizada_pct, 'opportunity' FROM scored"""
SQL["metric_extremes"] = f"WITH {WIDE}, {ZEROED} " + " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, {_top('z', v)} AS top, {_bottom('z', v)} AS bottom, {_last('z', v)} AS last, round({_mean('z', v)}, 6) AS average,
    (SELECT CASE WHEN count({v}) = count(*) THEN round(avg({v}), 6) END FROM wide) AS strict_average,
    (SELECT min({v}) FROM z) AS lo, (SELECT max({v}) FROM z) AS hi"""
    for v in VARIABLES
)
SQL["metric_heatmap"] = f"WITH {WIDE}, {ZEROED}, {_selection(t.SELECTED)} " + " UNION ALL ".join(
    f"""SELECT cve_ent, estado, {i} AS posicion, '{v}' AS id, {v} AS valor,
    round(CASE WHEN (SELECT max({v}) = min({v}) FROM s) THEN 0.5 ELSE ({v} - (SELECT min({v}) FROM s)) / (SELECT max({v}) - min({v}) FROM s) END, 6) AS intensidad,
    {_text(_label(v))} AS label, '%' AS unit FROM s"""
    for i, v in enumerate(fixed.ADOPTION_METRICS)
)
SQL["metric_radar"] = f"WITH {WIDE} " + " UNION ALL ".join(
    f"""SELECT {i} AS posicion, {_text(_label(v) if v in VARIABLES else v)} AS metric,
    {', '.join(f"CAST((SELECT {v if v in VARIABLES else 'NULL'} FROM wide WHERE estado = '{n}') AS DOUBLE) AS {n}" for n in t.SELECTED)}"""
    for i, v in enumerate([*fixed.ADOPTION_METRICS, "no_such_metric"])
)

_4GP, _4GL, _5GP = (
    "poblacion_en_localidades_con_4g_garantizada_pct", "localidades_con_4g_garantizada_pct",
    "poblacion_en_localidades_con_5g_garantizada_pct",
)
_GAP4 = fixed.GAP_METRICS[1]
_BOARD = f"WITH {WIDE}, {ZEROED}, {_scored(t.SELECTED)}, {GAPPED} "
SQL["section_insights"] = _BOARD + " UNION ALL ".join([
    _sentences(fixed.TERRITORIAL_SENTENCES, {
        "leader": _top("s", _4GL), "teledensity_leader": _top("s", TELEDENSITY), "laggard": _bottom("s", _4GL), "label": _low(_label(_4GL))},
        ", 'territorial' AS section"),
    _sentences(fixed.POPULATION_SENTENCES, {
        "leader": _top("s", _4GP), "label": _low(_label(_4GP)), "unit": "'%'", "average": _one_decimal(_mean("s", _4GP)),
        "gap": _one_decimal(f"{_mean('s', _4GP)} - {_mean('s', _4GL)}")}, ", 'population' AS section"),
    _sentences(fixed.GAP_SENTENCES, {
        "leader": _top("g", _GAP4[0]), "lowest": _bottom("g", _GAP4[0]), "label": _low(_GAP4[1]), "base": _low(_label(_4GL)),
        "average": _one_decimal(_mean("g", _GAP4[0]))}, ", 'gap' AS section"),
    _sentences(fixed.ADOPTION_SENTENCES, {
        "leader": _top("s", "personas_usuarias_internet_pct"), "label": _low(_label("personas_usuarias_internet_pct")),
        "coverage_leader": _top("s", _4GP), "coverage": _low(_label(_4GP)), "average": _one_decimal(_mean("s", _4GP))},
        ", 'adoption' AS section"),
    _sentences(fixed.OPPORTUNITY_SENTENCES, {
        "leader": _top("scored", "score"), "market_leader": _top("scored", "market_score"), "whitespace_leader": _top("scored", "space_score"),
        "label": _text(_label("personas_compras_internet_pct"))}, ", 'opportunity' AS section"),
])
SQL["executive_insights"] = _BOARD + _sentences(fixed.EXECUTIVE_SENTENCES, {
    "internet_leader": _top("s", "personas_usuarias_internet_pct"), "teledensity_leader": _top("s", TELEDENSITY),
    "coverage_leader": _top("s", _4GP), "opportunity_leader": _top("scored", "score")})
_PHONE = "personas_con_smartphone_pct"
SQL["metric_insights"] = f"WITH {WIDE}, {ZEROED} " + _sentences(fixed.METRIC_SENTENCES, {
    "leader": _top("z", _PHONE), "laggard": _last("z", _PHONE), "label": _low(_label(_PHONE)), "unit": "'%'",
    "top": _one_decimal(f"(SELECT max({_PHONE}) FROM z)"), "average": _one_decimal(_mean("z", _PHONE))})
_MENU = [
    _top("s", _5GP), f"{_one_decimal(_mean('s', 'hogares_en_localidades_con_internet_pct'))} || '%'",
    f"{_one_decimal(_mean('g', 'brecha_cobertura_movil_pp'))} || ' pp'", _top("s", _PHONE), _top("scored", "score"),
]
SQL["menu_figures"] = _BOARD + " UNION ALL ".join(
    f"SELECT {i} AS posicion, {_text(section)} AS seccion, {_text(caption)} AS label, {value} AS value"
    for i, ((section, caption), value) in enumerate(zip(fixed.MENU_CAPTIONS, _MENU))
)


def _cards(section: str, table: str, variable: str, label: str, unit: str, leader: str, third: tuple[str, str, str]) -> str:
    rows = [
        (leader, f"{_one_decimal(f'(SELECT max({variable}) FROM {table})')} || ' {unit}'", f"{_top(table, variable)} || ' encabeza ' || {_low(label)}"),
        (fixed.CARD_AVERAGE, f"{_one_decimal(_mean(table, variable))} || ' {unit}'", _text("Referencia promedio para " + label.lower())),
        (third[0], f"{_one_decimal(_mean(table, third[1]))} || ' %'", _text(third[2])),
    ]
    return " UNION ALL ".join(
        f"SELECT {i} AS posicion, {_text(a)} AS label, {b} AS value, {c} AS helper, '{section}' AS section" for i, (a, b, c) in enumerate(rows)
    )


SQL["section_cards"] = _BOARD + " UNION ALL ".join([
    _cards("territorial", "s", _4GL, _label(_4GL), "%", "Estado lider", ("5G poblacional promedio", _5GP, "Referencia de cobertura avanzada sobre poblacion")),
    _cards("population", "s", _4GP, _label(_4GP), "%", "Estado lider", ("Base comparada", _4GL, "Localidades con 4G garantizada promedio")),
    _cards("gap", "g", _GAP4[0], _GAP4[1], "pp", "Mayor brecha", ("Cobertura poblacional asociada", _4GP, "Poblacion en localidades con 4G garantizada promedio")),
    _cards("adoption", "s", "personas_usuarias_internet_pct", _label("personas_usuarias_internet_pct"), "%", "Estado lider",
           ("Cobertura asociada", _4GP, "Poblacion en localidades con 4G garantizada promedio")),
    f"""SELECT 0, 'Territorio prioritario', {_top('scored', 'score')}, {_one_decimal('(SELECT max(score) FROM scored)')} || ' pts de oportunidad total', 'opportunity'""",
    f"""SELECT 1, 'Promedio del score', {_one_decimal(_mean('scored', 'score'))} || ' pts', 'Referencia ejecutiva para comparar la muestra', 'opportunity'""",
    f"""SELECT 2, 'Variable foco', {_text(_label('personas_compras_internet_pct'))}, 'Usada para contextualizar el score estrategico', 'opportunity'""",
])

# --- quality ----------------------------------------------------------------------------
_CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_text(s.variable)}, {_text(s.label)}, {_text(s.unidad)})" for i, s in enumerate(SURVEY.all)
) + ") AS v(posicion, variable_id, label, unidad))"
_PROFILE = """profile AS (SELECT c.posicion, variable_id AS metric_id, c.label, c.unidad AS unit, count(*) AS "count", round_even(min(valor), 2) AS "min",
  round_even(max(valor), 2) AS "max", round_even(avg(valor), 2) AS "mean", round_even(stddev_pop(valor), 2) AS std_dev
  FROM catalog c JOIN last_values v ON v.variable = c.variable_id GROUP BY c.posicion, variable_id, c.label, c.unidad)"""
SQL["metric_profile"] = f"WITH {WIDE}, {_CATALOG}, {_PROFILE} SELECT * FROM profile"
_FACTS = """pairs AS (SELECT cve_ent, variable, count(*) AS n FROM long GROUP BY 1, 2),
f AS (SELECT (SELECT count(*) FROM wide) AS entities, (SELECT count(*) FROM long) AS records, (SELECT coalesce(sum(n - 1), 0) FROM pairs)::BIGINT AS duplicates,
  (SELECT count(*) FROM long WHERE unidad = '%' AND (valor < 0 OR valor > 100)) AS wrong, (SELECT count(*) FROM catalog) AS metrics,
  (SELECT string_agg('''' || variable_id || '''', ', ' ORDER BY posicion) FROM catalog c
   WHERE (SELECT count(*) FROM long l WHERE l.variable = c.variable_id) <> (SELECT count(*) FROM wide)) AS uneven)"""


def _checks() -> str:
    rows = [
        ("state_coverage", "entities = 25", "'El dataset ancho contiene ' || entities || ' entidades.'"),
        ("metric_coverage", "uneven IS NULL", "'Metricas con cobertura incompleta: ' || coalesce('[' || uneven || ']', 'ninguna') || '.'"),
        ("expected_long_records", "records = entities * metrics",
         "'Registros largos observados: ' || records || '. Esperados: ' || entities * metrics || '.'"),
        ("duplicate_state_variable_pairs", "duplicates = 0", "'Pares entidad-variable duplicados: ' || duplicates || '.'"),
        ("percentage_ranges", "wrong = 0", "'Registros porcentuales fuera de rango: ' || wrong || '.'"),
        ("null_metric_values", "true", "'No se detectaron valores nulos en el dataset ancho.'"),
    ]
    return " UNION ALL ".join(
        f"SELECT {i} AS posicion, '{check}' AS check_id, CASE WHEN {passed} THEN 'passed' ELSE 'failed' END AS status, {detail} AS detail FROM f"
        for i, (check, passed, detail) in enumerate(rows)
    )


SQL["validation_checks"] = f"WITH {WIDE}, {_CATALOG}, {_FACTS} {_checks()}"
SQL["source_breakdown"] = f"WITH {LONG} SELECT fuente AS source, count(*) AS records FROM long GROUP BY 1"
SQL["duplicate_pairs"] = """SELECT 'duplicates' AS kind, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)
UNION ALL SELECT 'out_of_range', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_totalprice / 1000 < 0 OR o_totalprice / 1000 > 100)"""
_COLUMNS = {
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
}
_KEYS = {"lineitem": ("l_orderkey", "l_quantity"), "orders": ("o_orderkey",), "events": ("event_id", "props"), "documents": ("doc_id", "lang")}
SQL["raw_profile"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS source_id, '{name}.parquet' AS file_name, count(*) AS rows_read, '{_COLUMNS[name]}' AS columns,
    count(*) FILTER ({' OR '.join(f"trim(coalesce(CAST({k} AS VARCHAR), '')) = ''" for k in _KEYS[name])}) AS rows_with_missing_primary_keys FROM {name}"""
    for name in _COLUMNS
)
SQL["written_profile"] = f"SELECT * FROM ({SQL['raw_profile']}) WHERE source_id IN ('orders', 'events')"
SQL["written_checks"] = f"""WITH {LONG} SELECT 'records' AS measure, count(*) AS n FROM long
UNION ALL SELECT 'null_values', count(*) FILTER (valor IS NULL) FROM long
UNION ALL SELECT 'out_of_range', count(*) FILTER (unidad = '%' AND (valor < 0 OR valor > 100)) FROM long"""
SQL["open_wide"] = """
WITH ranked AS (
  SELECT l_suppkey, 'part_' || l_partkey AS variable, CAST(floor(l_quantity) AS BIGINT) AS valor,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS nth FROM lineitem)
SELECT CAST(l_suppkey AS VARCHAR) AS cve_ent, count(*) AS n_metrics, string_agg(variable || '=' || valor, ' ' ORDER BY variable) AS metrics
FROM ranked WHERE nth = 1 GROUP BY l_suppkey"""
SQL["report_lines"] = f"""WITH {WIDE}, {_CATALOG}, {_PROFILE}, {_FACTS}, checks AS ({_checks()}), raw AS ({SQL['raw_profile']})
SELECT 'summary' AS section, 'raw_files_profiled' AS key, '4' AS value UNION ALL SELECT 'summary', 'records_long', CAST(records AS VARCHAR) FROM f
UNION ALL SELECT 'summary', 'states_wide', CAST(entities AS VARCHAR) FROM f UNION ALL SELECT 'summary', 'metrics_in_catalog', CAST(metrics AS VARCHAR) FROM f
UNION ALL SELECT 'source_breakdown', fuente, CAST(count(*) AS VARCHAR) FROM long GROUP BY fuente
UNION ALL SELECT 'validation_checks', check_id, status FROM checks
UNION ALL SELECT 'validation_checks', check_id || '.detail', detail FROM checks
UNION ALL SELECT 'metrics_profile', metric_id, CAST("count" AS VARCHAR) FROM profile""" + "".join(
    f"""
UNION ALL SELECT 'metrics_profile', metric_id || '.{name}', CAST(CAST("{name}" AS DECIMAL(38,2)) AS VARCHAR) FROM profile"""
    for name in ("min", "max", "mean", "std_dev")
) + "".join(
    f"""
UNION ALL SELECT 'raw_files', source_id || '.{name}', CAST({name} AS VARCHAR) FROM raw"""
    for name in ("file_name", "columns", "rows_read", "rows_with_missing_primary_keys")
)
SQL["published_records"] = f"""WITH {WIDE}
SELECT l.cve_ent, m.estado, m.region, l.variable, l.valor FROM last_values l JOIN wide m USING (cve_ent)"""
SQL["csv_records"] = """SELECT o_orderkey, '"a", ' || o_orderpriority AS note, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders"""
SQL["feature_shapes"] = SQL["tile_features"].replace("AS tech_proxy FROM b", "AS tech_proxy, round(mbps, 6) AS avg_d_mbps FROM b")
SQL["published_lines"] = f"""WITH {WIDE}
SELECT 0 AS section, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS continued UNION ALL SELECT 1, count(*), count(*) - 1 FROM wide UNION ALL SELECT 2, 1, 0"""

def _half_even(digits: int) -> str:
    scaled = f"(a * {10**digits})"
    rest = f"({scaled} - floor({scaled}))"
    up = f"CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND floor({scaled})::HUGEINT % 2 = 1) THEN 1 ELSE 0 END"
    return f"(s * ((floor({scaled})::HUGEINT + {up})::DECIMAL(38,{digits}) * {10.0**-digits:.{digits}f}::DECIMAL(5,{digits})))::DOUBLE"


SQL["rounded_amounts"] = f"""WITH amounts AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS s,
    (floor(o_totalprice)::BIGINT * 10000000)::DECIMAL(24,6) + (o_orderkey % 64)::DECIMAL(24,6) * 0.015625::DECIMAL(7,6) AS a
  FROM orders)
SELECT o_orderkey, {_half_even(2)} AS two, {_half_even(4)} AS four,
  CASE WHEN s < 0 THEN '-' ELSE '' END || (floor(a * 10 + 0.5)::HUGEINT // 10)::VARCHAR || '.' || (floor(a * 10 + 0.5)::HUGEINT % 10)::VARCHAR AS text
FROM amounts"""

SQL["weighted_share_fine"] = """WITH w AS (
  SELECT l_returnflag, l_linestatus, ((l_orderkey % 1000 + 1) * 0.000001)::DECIMAL(18,6) AS w FROM lineitem)
SELECT l_returnflag AS cve_ent,
  coalesce(sum(CASE WHEN l_linestatus = 'O' THEN w END)::DOUBLE / sum(w)::DOUBLE, 0) * 100 AS open_pct
FROM w GROUP BY l_returnflag"""

SQL["weighted_share_doubles"] = """
SELECT l_returnflag AS cve_ent, round_even(fsum(CASE WHEN l_linestatus = 'O' THEN w ELSE 0 END) / fsum(w) * 100.0, 6) AS open_pct
FROM (SELECT *, l_extendedprice / CAST(3 AS DOUBLE) * CASE WHEN l_linenumber = 1 THEN CAST(1e-6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
             + CAST(0.1 AS DOUBLE) AS w FROM lineitem)
GROUP BY 1"""

_FINE = {"poblacion": "abs(c_acctbal) / CAST(7e8 AS DOUBLE)", "hogares": "abs(c_acctbal) / CAST(3 AS DOUBLE)", "localidades": "CAST(1 AS DOUBLE)"}
SQL["locality_share_fine"] = f"""
WITH facts AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_ent, o_orderstatus, o_orderpriority,
         {', '.join(f'{sql} AS {name}' for name, sql in _FINE.items())}
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = {t.YEAR})
{' UNION ALL '.join(
    f"SELECT cve_ent, {_text(s.variable)} AS variable, round_even(fsum(CASE WHEN {_in(s)} THEN {s.weight} ELSE 0 END) / fsum({s.weight}) * 100.0, 6) AS valor "
    f"FROM facts GROUP BY 1 HAVING fsum({s.weight}) <> 0" for s in SURVEY.localities)}"""

SQL["running_share"] = SQL["weighted_share_long"]
SQL["stored_locality_share"] = SQL["locality_share"]
SQL["published_together"] = SQL["survey_long"]
SQL["clustered_tiles"] = """
WITH placed AS (
  SELECT event_id, user_id AS tests, CAST(-119 AS DOUBLE) + event_id * 15 / CAST(1024 AS DOUBLE) AS x,
         CAST(13 AS DOUBLE) + ((event_id * 7919 + user_id * 131) % 21504) / CAST(1024 AS DOUBLE) AS y FROM events)
SELECT event_id, tests, x - 1 / CAST(512 AS DOUBLE) AS x_min, y + 1 / CAST(512 AS DOUBLE) AS y_max FROM placed
WHERE x + 1 / CAST(512 AS DOUBLE) >= -110 AND x - 1 / CAST(512 AS DOUBLE) <= -104
  AND y + 1 / CAST(512 AS DOUBLE) >= 18 AND y - 1 / CAST(512 AS DOUBLE) <= 24"""
SQL["catalog_log_variables"] = """
SELECT variable AS variable_id, first(categoria ORDER BY turn, p_partkey) AS categoria_id, first(unidad ORDER BY turn, p_partkey) AS unidad_base,
       '2026-04-20' AS updated_at
FROM (SELECT p_partkey, p_partkey % 2 AS turn, 'cat_5' || lower(p_type) AS categoria,
             replace(p_name, ' ', '_') || '_' || lower(p_type) || CASE WHEN p_type = 'PROMO' THEN '_pct' ELSE '' END AS variable,
             CASE p_type WHEN 'SMALL' THEN ' % ' WHEN 'LARGE' THEN 'USD millones' ELSE 'piezas' END AS unidad FROM part)
GROUP BY 1"""

SQL["marked_microdata"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS "ENT", 'Año "1", ' || c_name AS "NOMBRE", CAST(c_custkey AS VARCHAR) AS "FOLIO" FROM customer"""
SQL["latin1_localities"] = """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS "CVEGEO", 'Peñón Güémez, ' || c_name AS "NOM_LOC", CAST(c_nationkey AS VARCHAR) AS "ANIO" FROM customer"""
SQL["enveloped_master"] = """
SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_code, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS cve_ent, n_name AS estado,
       r_name AS region, '' AS capital, unnest(['Nación ' || n_nationkey, 'N.' || n_nationkey]) AS alias
FROM nation JOIN region ON n_regionkey = r_regionkey"""
SQL["coverage_frames"] = SQL["tile_coverage_state"]
