"""Names, texts, weights and thresholds that the published indicators depend on.

They are data, not logic. Everything below must keep exactly these values for results to
stay comparable with the published series.
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------
# Survey shares.
# variable | categoria | label | unidad | source table | response column | positive codes
# --------------------------------------------------------------------------------------
SURVEY_SHARES = [
    ("personas_usuarias_computadora_pct", "infraestructura_digital", "Personas usuarias de computadora", "%", "usuarios", "P6_1", "1"),
    ("personas_usuarias_internet_pct", "infraestructura_digital", "Personas usuarias de internet", "%", "usuarios", "P7_1", "1"),
    ("personas_conexion_internet_movil_pct", "cobertura_red", "Personas con uso de internet movil", "%", "usuarios", "P7_8_7", "1"),
    ("personas_usan_redes_sociales_pct", "infraestructura_digital", "Personas que usan redes sociales", "%", "usuarios", "P7_15", "1"),
    ("personas_compras_internet_pct", "infraestructura_digital", "Personas que realizan compras por internet", "%", "usuarios", "P7_21", "1"),
    ("personas_pagos_internet_pct", "infraestructura_digital", "Personas que realizan pagos por internet", "%", "usuarios", "P7_28", "1"),
    ("personas_banca_electronica_pct", "infraestructura_digital", "Personas que usan banca electronica", "%", "usuarios", "P7_33", "1"),
    ("personas_con_celular_pct", "cobertura_red", "Personas con celular", "%", "usuarios2", "P8_1", "1"),
    ("personas_usuarias_celular_pct", "cobertura_red", "Personas usuarias de celular", "%", "usuarios2", "P8_3", "1"),
    ("personas_con_smartphone_pct", "cobertura_red", "Personas con smartphone", "%", "usuarios2", "P8_4_2", "1"),
    ("personas_conexion_datos_celular_pct", "cobertura_red", "Personas que se conectan por datos celulares", "%", "usuarios2", "P8_12_2", "1"),
    ("personas_usan_apps_redes_sociales_pct", "infraestructura_digital", "Personas que usan apps de redes sociales", "%", "usuarios2", "P8_13_6", "1"),
    ("personas_usan_banca_movil_pct", "infraestructura_digital", "Personas que usan apps de banca movil", "%", "usuarios2", "P8_13_7", "1"),
]
SURVEY_ENTITY_COLUMN = "CVE_ENT"
SURVEY_WEIGHT_COLUMN = "FAC_PER"
SURVEY_SOURCE = "INEGI ENDUTIH 2024"
SURVEY_YEAR = 2024

# --------------------------------------------------------------------------------------
# Values published as they come.
# variable | categoria | label | unidad | source table | value | entity | year | month | fuente
# --------------------------------------------------------------------------------------
DIRECT_VALUES = [
    ("teledensidad_internet_movil", "cobertura_red", "Teledensidad de internet movil", "lineas por cada 100 habitantes", "td_teledensidad_intmovil", "T_INTMOVIL_ITE_VA", "K_ENTIDAD", "ANIO", "MES", "IFT TD_TELEDENSIDAD_INTMOVIL_ITE_VA"),
]

# --------------------------------------------------------------------------------------
# Locality shares.
# variable | categoria | label | unidad | weight | connectivity column | positive value
# --------------------------------------------------------------------------------------
LOCALITY_SHARES = [
    ("localidades_con_cobertura_movil_pct", "cobertura_red", "Localidades con cobertura movil", "%", "localidades", "MOVIL", "Sí"),
    ("poblacion_en_localidades_con_cobertura_movil_pct", "cobertura_red", "Poblacion en localidades con cobertura movil", "%", "poblacion", "MOVIL", "Sí"),
    ("localidades_con_4g_garantizada_pct", "cobertura_red", "Localidades con 4G garantizada", "%", "localidades", "G_4G", "Garantizada"),
    ("poblacion_en_localidades_con_4g_garantizada_pct", "cobertura_red", "Poblacion en localidades con 4G garantizada", "%", "poblacion", "G_4G", "Garantizada"),
    ("localidades_con_5g_garantizada_pct", "cobertura_red", "Localidades con 5G garantizada", "%", "localidades", "G_5G", "Garantizada"),
    ("poblacion_en_localidades_con_5g_garantizada_pct", "cobertura_red", "Poblacion en localidades con 5G garantizada", "%", "poblacion", "G_5G", "Garantizada"),
    ("hogares_en_localidades_con_internet_pct", "infraestructura_digital", "Hogares en localidades con internet", "%", "hogares", "INTERNET", "Sí"),
    ("poblacion_en_localidades_con_internet_pct", "infraestructura_digital", "Poblacion en localidades con internet", "%", "poblacion", "INTERNET", "Sí"),
]
LOCALITY_SOURCE = "BIT brechas digitales 2024"
LOCALITY_SOURCE_TABLE = "loc_tipo_conectividad + localidades_conectividad"

# --------------------------------------------------------------------------------------
# Context variables.
# variable | anio | categoria | label | unidad | fuente sugerida | sinonimos
# --------------------------------------------------------------------------------------
CONTEXT_VARIABLES = [
    ("pobreza_pct", 2022, "bienestar_social", "Población en situación de pobreza", "%", "CONEVAL", ["pobreza", "poblacion en pobreza"]),
    ("pobreza_extrema_pct", 2022, "bienestar_social", "Población en pobreza extrema", "%", "CONEVAL", ["pobreza extrema"]),
    ("vulnerable_carencias_pct", 2022, "bienestar_social", "Población vulnerable por carencias", "%", "CONEVAL", ["vulnerable por carencias"]),
    ("no_pobre_no_vulnerable_pct", 2022, "bienestar_social", "Población no pobre y no vulnerable", "%", "CONEVAL", ["no pobre y no vulnerable"]),
    ("rezago_educativo_pct", 2022, "bienestar_social", "Rezago educativo", "%", "CONEVAL", ["rezago educativo"]),
    ("carencia_salud_pct", 2022, "bienestar_social", "Carencia por acceso a salud", "%", "CONEVAL", ["carencia salud", "acceso a salud"]),
    ("carencia_servicios_basicos_pct", 2022, "bienestar_social", "Carencia por servicios básicos", "%", "CONEVAL", ["servicios basicos", "carencias de vivienda"]),
    ("ingreso_inferior_lp_pct", 2022, "bienestar_social", "Ingreso inferior a la línea de pobreza", "%", "CONEVAL", ["linea de pobreza por ingresos"]),
    ("pib_total", 2024, "economia", "PIB total", "MDP", "INEGI PIBE", ["PIBE", "producto interno bruto estatal"]),
    ("pib_per_capita", 2024, "economia", "PIB per cápita", "MDP", "INEGI PIBE + ITER", ["PIB per capita", "PIB por habitante"]),
    ("poblacion_total", 2020, "demografia", "Población total", "personas", "INEGI ITER", ["poblacion residente total", "POBTOT"]),
    ("poblacion_edad_laboral_pct", 2020, "demografia", "Población en edad laboral", "%", "INEGI ITER", ["poblacion 15 a 64", "POB15_64"]),
    ("poblacion_economicamente_activa_pct", 2020, "demografia", "Población económicamente activa", "%", "INEGI ITER", ["PEA", "poblacion economicamente activa"]),
    ("poblacion_afiliada_imss_pct", 2020, "demografia", "Población afiliada al IMSS", "%", "INEGI ITER", ["PDER_IMSS", "afiliacion IMSS"]),
]
CONTEXT_SOURCE = "CONEVAL 2022 / INEGI ITER 2020 / INEGI PIB"

# Row labels (regular expressions) of the poverty sheets, by variable.
POVERTY_LABELS = [
    ("pobreza_pct", "Población en situación de pobreza"),
    ("pobreza_extrema_pct", "pobreza extrema"),
    ("vulnerable_carencias_pct", "vulnerable por carencias"),
    ("no_pobre_no_vulnerable_pct", "no pobre y no vulnerable"),
    ("rezago_educativo_pct", "Rezago educativo"),
    ("carencia_salud_pct", "salud"),
    ("carencia_servicios_basicos_pct", "servicios básicos"),
    ("ingreso_inferior_lp_pct", "línea de pobreza por ingresos"),
]
# Layout of the poverty and GDP sheets (zero-based rows and columns).
POVERTY_SKIPPED_SHEET = "Contenido"
POVERTY_HEADER_ROW = 6
POVERTY_LABEL_COLUMN = 2
POVERTY_VALUE_COLUMN = 6
GDP_HEADER_ROW = 4
GDP_FIRST_ROW = 3
GDP_LAST_ROW = 34
GDP_LABEL_HEADER = "Concepto"

# Census columns and their published names.
CENSUS_COLUMNS = [
    ("POBTOT", "poblacion_total"),
    ("POB15_64", "poblacion_edad_laboral"),
    ("PEA", "poblacion_economicamente_activa"),
    ("PDER_IMSS", "poblacion_afiliada_imss"),
    ("VIVTOT", "total_viviendas"),
]

# --------------------------------------------------------------------------------------
# Catalog defaults and labels.
# --------------------------------------------------------------------------------------
CATEGORY_DEFAULTS = [
    ("bienestar_social", "Bienestar social", "Indicadores de pobreza, carencias y bienestar de la poblacion."),
    ("economia", "Economia", "Indicadores economicos para contextualizar el desarrollo estatal."),
    ("demografia", "Demografia", "Indicadores poblacionales y estructura demografica por entidad."),
]
CATEGORY_FALLBACK_DESCRIPTION = "Categoria agregada automaticamente desde VARIABLE_SPECS."
CATEGORY_LABELS = [
    ("infraestructura_digital", "Infraestructura digital"),
    ("cobertura_red", "Cobertura de red"),
    ("industria", "Industria"),
    ("contexto_territorial", "Contexto territorial"),
]
SUMMED_VARIABLES = ["pib_total", "poblacion_total"]
INTEGER_VARIABLES = ["poblacion_total"]
CURRENCY_UNITS = ["usd", "mdp"]

# Canonical names (keys are compared without accents, in lower case).
STATE_ALIASES = [
    ("aguascalientes", "Aguascalientes"),
    ("chihuahua", "Chihuahua"),
    ("cdmx", "Ciudad de Mexico"),
    ("ciudad de mexico", "Ciudad de Mexico"),
    ("distrito federal", "Ciudad de Mexico"),
    ("jalisco", "Jalisco"),
    ("nuevo leon", "Nuevo Leon"),
    ("n.l.", "Nuevo Leon"),
    ("queretaro", "Queretaro"),
    ("queretaro de arteaga", "Queretaro"),
    ("yucatan", "Yucatan"),
]
VARIABLE_ALIASES = [
    ("digital_connectivity", "indice_conectividad_digital"),
    ("conectividad digital", "indice_conectividad_digital"),
    ("indice de conectividad", "indice_conectividad_digital"),
    ("mobile_coverage_5g", "cobertura_5g_pct"),
    ("cobertura 5g", "cobertura_5g_pct"),
    ("5g coverage", "cobertura_5g_pct"),
    ("industrial_activity", "actividad_industrial_indice"),
    ("actividad industrial", "actividad_industrial_indice"),
    ("industrial_exports", "exportaciones_industriales_usd_millones"),
    ("exportaciones industriales", "exportaciones_industriales_usd_millones"),
    ("population", "poblacion_total"),
    ("poblacion total", "poblacion_total"),
    ("urbanization", "urbanizacion_pct"),
    ("urbanizacion rate", "urbanizacion_pct"),
    ("urbanizacion", "urbanizacion_pct"),
]

# --------------------------------------------------------------------------------------
# Mobile network coverage.
# --------------------------------------------------------------------------------------
COVERAGE_BOX = (-118.5, 14.5, -86.5, 32.7)
TECHNOLOGY_LIMITS_MBPS = [("3G", 10.0), ("4G", 40.0)]
TECHNOLOGY_ABOVE = "5G"

# Projection EPSG:6372 (Lambert conformal conic, GRS80), as registered.
LCC_MEXICO = {
    "semi_major": 6378137.0,
    "inverse_flattening": 298.257222101,
    "latitude_1": 17.5,
    "latitude_2": 29.5,
    "latitude_0": 12.0,
    "longitude_0": -102.0,
    "false_easting": 2500000.0,
    "false_northing": 0.0,
}

# --------------------------------------------------------------------------------------
# Dashboard analytics.
# --------------------------------------------------------------------------------------
DEFAULT_STATES = ["Nuevo Leon", "Jalisco", "Ciudad de Mexico", "Queretaro"]
EXPECTED_ENTITIES = 32

MARKET_WEIGHTS = [
    ("personas_usuarias_internet_pct", 0.25),
    ("personas_con_smartphone_pct", 0.15),
    ("teledensidad_internet_movil", 0.2),
    ("poblacion_en_localidades_con_4g_garantizada_pct", 0.25),
    ("poblacion_en_localidades_con_5g_garantizada_pct", 0.15),
]
WHITESPACE_WEIGHTS = [
    ("personas_compras_internet_pct", 0.4),
    ("personas_pagos_internet_pct", 0.35),
    ("personas_usan_banca_movil_pct", 0.25),
]
MARKET_SHARE_OF_SCORE = 0.65
WHITESPACE_SHARE_OF_SCORE = 0.35

TERRITORIAL_METRICS = [
    "localidades_con_cobertura_movil_pct",
    "localidades_con_4g_garantizada_pct",
    "localidades_con_5g_garantizada_pct",
    "teledensidad_internet_movil",
]
POPULATION_METRICS = [
    "poblacion_en_localidades_con_cobertura_movil_pct",
    "poblacion_en_localidades_con_4g_garantizada_pct",
    "poblacion_en_localidades_con_5g_garantizada_pct",
    "poblacion_en_localidades_con_internet_pct",
    "hogares_en_localidades_con_internet_pct",
]
ADOPTION_METRICS = [
    "personas_usuarias_internet_pct",
    "personas_con_smartphone_pct",
    "personas_conexion_datos_celular_pct",
    "personas_compras_internet_pct",
    "personas_usan_banca_movil_pct",
]
OPPORTUNITY_METRICS = ADOPTION_METRICS + [
    "teledensidad_internet_movil",
    "poblacion_en_localidades_con_4g_garantizada_pct",
    "poblacion_en_localidades_con_5g_garantizada_pct",
]

# Gap variables. id | label | unit | category | description | base | covered
GAP_METRICS = [
    ("brecha_cobertura_movil_pp", "Brecha poblacion-localidades con cobertura movil", "pp", "Cobertura de red", "Diferencia entre la poblacion cubierta y el porcentaje de localidades con cobertura movil.", "localidades_con_cobertura_movil_pct", "poblacion_en_localidades_con_cobertura_movil_pct"),
    ("brecha_4g_pp", "Brecha poblacion-localidades con 4G garantizada", "pp", "Cobertura de red", "Diferencia entre la poblacion cubierta y el porcentaje de localidades con 4G garantizada.", "localidades_con_4g_garantizada_pct", "poblacion_en_localidades_con_4g_garantizada_pct"),
    ("brecha_5g_pp", "Brecha poblacion-localidades con 5G garantizada", "pp", "Cobertura de red", "Diferencia entre la poblacion cubierta y el porcentaje de localidades con 5G garantizada.", "localidades_con_5g_garantizada_pct", "poblacion_en_localidades_con_5g_garantizada_pct"),
]
DEFAULT_GAP_METRIC = "brecha_4g_pp"
SCORE_METRIC = ("opportunityScore", "Score de oportunidad", "pts", "Cobertura de red", "Score compuesto para priorizacion ejecutiva.")

# Which base a population metric is compared with (default last).
POPULATION_PAIRS = [
    ("poblacion_en_localidades_con_cobertura_movil_pct", "localidades_con_cobertura_movil_pct", "Localidades con cobertura movil"),
    ("poblacion_en_localidades_con_5g_garantizada_pct", "localidades_con_5g_garantizada_pct", "Localidades con 5G garantizada"),
    ("poblacion_en_localidades_con_internet_pct", "hogares_en_localidades_con_internet_pct", "Hogares en localidades con internet"),
    ("hogares_en_localidades_con_internet_pct", "poblacion_en_localidades_con_internet_pct", "Poblacion en localidades con internet"),
    ("poblacion_en_localidades_con_4g_garantizada_pct", "localidades_con_4g_garantizada_pct", "Localidades con 4G garantizada"),
]
# Which coverage an adoption metric is compared with (default last).
ADOPTION_PAIRS = [
    ("personas_con_smartphone_pct", "poblacion_en_localidades_con_5g_garantizada_pct", "Poblacion en localidades con 5G garantizada"),
    ("personas_conexion_datos_celular_pct", "poblacion_en_localidades_con_cobertura_movil_pct", "Poblacion en localidades con cobertura movil"),
    ("personas_compras_internet_pct", "poblacion_en_localidades_con_cobertura_movil_pct", "Poblacion en localidades con cobertura movil"),
    ("personas_usan_banca_movil_pct", "poblacion_en_localidades_con_cobertura_movil_pct", "Poblacion en localidades con cobertura movil"),
    ("personas_usuarias_internet_pct", "poblacion_en_localidades_con_4g_garantizada_pct", "Poblacion en localidades con 4G garantizada"),
]

# --------------------------------------------------------------------------------------
# Sentences. Text in braces is filled in; labels arrive in lower case.
# --------------------------------------------------------------------------------------
TERRITORIAL_SENTENCES = [
    "{leader} lidera la muestra en {label}, por lo que marca la referencia territorial inicial.",
    "{teledensity_leader} concentra la mayor teledensidad de internet movil, una señal de intensidad comercial sobre la red.",
    "{laggard} queda al final del comparativo de {label}, lo que sugiere una revision de rezago territorial relativo.",
]
POPULATION_SENTENCES = [
    "{leader} encabeza {label}, lo que muestra el mayor alcance efectivo sobre poblacion u hogares.",
    "El promedio simple de la muestra para {label} es {average} {unit}.",
    "La diferencia promedio entre poblacion cubierta con 4G y localidades con 4G es de {gap} pp, señal de concentracion urbana de la cobertura avanzada.",
]
GAP_SENTENCES = [
    "{leader} presenta la mayor {label}, lo que apunta a una cobertura mas concentrada en zonas pobladas.",
    "{lowest} muestra la brecha mas contenida, una señal de despliegue relativamente mas distribuido en {base}.",
    "La brecha promedio de la muestra es {average} pp, util para distinguir dispersion territorial frente a concentracion urbana.",
]
ADOPTION_SENTENCES = [
    "{leader} lidera {label}, funcionando como referencia de adopcion digital para la muestra.",
    "{coverage_leader} destaca en {coverage}, por lo que combina mejor base de conectividad para esta lectura.",
    "El promedio simple de {coverage} es {average} %, util para ver si la adopcion se apoya en una base de cobertura suficiente.",
]
OPPORTUNITY_SENTENCES = [
    "{leader} aparece como prioridad inicial al combinar base digital, cobertura avanzada y espacio para profundizar uso transaccional.",
    "{market_leader} es el referente en atractivo de mercado, mientras {whitespace_leader} concentra el mayor espacio relativo para activar demanda digital.",
    "{label} se usa como variable foco para matizar el score y abrir la conversacion sobre expansion comercial o despliegue selectivo.",
]
EXECUTIVE_SENTENCES = [
    "{internet_leader} lidera la muestra en uso de internet, funcionando como referencia de adopcion digital.",
    "{teledensity_leader} presenta la mayor teledensidad de internet movil, una senal directa de intensidad de servicio en el mercado.",
    "{coverage_leader} destaca por la cobertura territorial sobre poblacion en localidades con 4G garantizada.",
    "{opportunity_leader} aparece como prioridad estrategica inicial al combinar base digital, acceso movil y espacio para profundizar transacciones y servicios.",
    "La lectura ejecutiva ya distingue entre adopcion digital, capacidad territorial de conectividad y whitespace comercial dentro del ecosistema TIC.",
]
METRIC_SENTENCES = [
    "{leader} lidera en {label} con {top} {unit}.",
    "{laggard} presenta el menor valor en {label}, lo que sugiere una oportunidad de expansion o priorizacion comercial.",
    "El promedio simple de la muestra es {average} {unit}, util como referencia para benchmark territorial.",
    "La distribucion territorial de {label} ayuda a detectar brechas de adopcion y focos de oportunidad.",
]

# Menu figures. section | caption
MENU_CAPTIONS = [
    ("cobertura-territorial", "Líder 5G"),
    ("cobertura-poblacional", "Prom. Hogares"),
    ("brecha-territorial", "Brecha Media"),
    ("adopcion-cobertura", "Líder Smartphone"),
    ("oportunidad", "Top Oportunidad"),
]
# Card captions.
CARD_LEADER = "Estado lider"
CARD_WIDEST_GAP = "Mayor brecha"
CARD_AVERAGE = "Promedio muestra"
CARD_5G = ("5G poblacional promedio", "Referencia de cobertura avanzada sobre poblacion")
CARD_BASE = "Base comparada"
CARD_GAP_COVERAGE = "Cobertura poblacional asociada"
CARD_COVERAGE = "Cobertura asociada"
CARD_PRIORITY = ("Territorio prioritario", "{value} pts de oportunidad total")
CARD_SCORE_AVERAGE = ("Promedio del score", "Referencia ejecutiva para comparar la muestra")
CARD_FOCUS = ("Variable foco", "Usada para contextualizar el score estrategico")
CARD_LEADER_HELPER = "{state} encabeza {label}"
CARD_AVERAGE_HELPER = "Referencia promedio para {label}"
CARD_PAIR_HELPER = "{label} promedio"
NOT_AVAILABLE = "N/D"
NO_DATA = "Sin datos"

# --------------------------------------------------------------------------------------
# Quality report texts.
# --------------------------------------------------------------------------------------
CHECK_DETAILS = [
    ("state_coverage", "El dataset ancho contiene {entities} entidades."),
    ("metric_coverage", "Metricas con cobertura incompleta: {offenders}."),
    ("expected_long_records", "Registros largos observados: {records}. Esperados: {expected}."),
    ("duplicate_state_variable_pairs", "Pares entidad-variable duplicados: {duplicates}."),
    ("percentage_ranges", "Registros porcentuales fuera de rango: {out_of_range}."),
    ("null_metric_values", "No se detectaron valores nulos en el dataset ancho."),
]
CHECK_NO_OFFENDERS = "ninguna"
CLEANING_ESTIMATORS = [
    ("endutih_weighted_estimator", "porcentaje = (sumatoria de FAC_PER para respuestas positivas / sumatoria total de FAC_PER por entidad) * 100"),
    (
        "locality_weighted_estimator",
        "porcentaje = (sumatoria ponderada por poblacion, hogares o localidades con condicion positiva / sumatoria total del denominador por entidad) * 100",
    ),
]
CLEANING_STEPS = [
    "se filtran registros sin CVE_ENT o sin FAC_PER en ENDUTIH",
    "se normaliza la clave estatal con dos digitos para el cruce con el maestro de estados",
    "se filtran los datos de brecha digital al anio 2024",
    "se integran solo entidades con catalogo maestro valido",
    "se redondean indicadores finales a dos decimales",
]
METRIC_DESCRIPTION = "{label} derivada de {source}."
VARIABLE_DESCRIPTION = "{label} (año {year})."
UNKNOWN_METRIC_ERROR = "La metrica {metric} no existe en el catalogo."

# Published envelopes.
SCHEMA_VERSION = "1.0.0"
SURVEY_LONG_ID = "endutih_2024_state_observations.long"
SURVEY_WIDE_ID = "endutih_2024_state_dashboard.wide"
CONTEXT_LONG_ID = "context_variables_state_observations.long"
CONTEXT_WIDE_ID = "context_variables_state_dashboard.wide"

LONG_COLUMNS = ["state_code", "cve_ent", "estado", "categoria", "variable", "valor", "anio", "fuente", "unidad"]
WIDE_ENTITY_COLUMNS = ["state_code", "cve_ent", "estado", "region"]
