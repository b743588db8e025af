import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions import numeric as num
from comarca.functions import text as txt


def values(spark, items, dtype, *columns):
    df = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, x {dtype}")
    return [tuple(row) for row in df.orderBy("i").select(*[c(F.col("x")) for c in columns]).collect()]


def one(spark, items, dtype, column):
    return [row[0] for row in values(spark, items, dtype, column)]


def test_zero_fill_never_cuts(spark):
    assert one(spark, ["9", "123", "09", "", None, "-1", "+7"], "string", txt.zero_fill) == ["09", "123", "09", "00", None, "-1", "+7"]
    assert one(spark, [7, 12], "int", txt.zero_fill) == ["07", "12"]


def test_strip_knows_all_white_space(spark):
    assert one(spark, ["\t a b \n", " x"], "string", txt.strip) == ["a b", "x"]
    assert one(spark, ["  ", "", None, "x"], "string", txt.is_blank) == [True, True, True, False]


def python_fold(text):
    return "" if text is None else unicodedata.normalize("NFKD", text.lower().strip()).encode("ascii", "ignore").decode()


def test_fold_equals_decomposition(spark):
    items = [" Querétaro ", "Estado de México", "N.L.", None, "Straße œuvre", "ﬁn ½ Ａ №5 ㎏", "İstanbul", "é", "Привет", "…x…"]
    assert one(spark, items, "string", txt.fold) == [python_fold(item) for item in items]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=15), min_size=200, max_size=200))
def test_fold_on_any_text(spark, items):
    got = one(spark, items, "string", txt.fold)
    # Lower case differs between the two runtimes for a few scripts; plain text must agree.
    for item, folded in zip(items, got):
        if all(c.lower() == c or c.isascii() for c in item):
            assert folded == python_fold(item)


def test_slug_and_titles(spark):
    assert one(spark, ["Índice de 5G!", " --a  b-- ", "ñandú/ÉL", None], "string", txt.slug) == ["indice_de_5g", "a_b", "nandu_el", None]
    assert one(spark, [" nuevo  leon ", ""], "string", txt.title_words) == ["Nuevo Leon", ""]
    assert one(spark, ["cobertura 5g d'avila", "nueva cat"], "string", txt.title_runs) == ["Cobertura 5G D'Avila", "Nueva Cat"]


def test_canonical_names(spark):
    names = one(
        spark, ["CDMX", " Querétaro ", "n.l.", "Ciudad de México", "baja  california"], "string",
        lambda c: txt.canonical_name(c, fixed.STATE_ALIASES),
    )
    assert names == ["Ciudad de Mexico", "Queretaro", "Nuevo Leon", "Ciudad de Mexico", "Baja California"]
    variables = one(
        spark, ["Cobertura 5G", "Población total", "Otro índice (%)"], "string",
        lambda c: txt.canonical_variable(c, fixed.VARIABLE_ALIASES),
    )
    assert variables == ["cobertura_5g_pct", "poblacion_total", "otro_indice"]


def test_sentences_keep_text_around_values(spark):
    assert one(spark, ["A"], "string", lambda c: txt.fill_in("{x} y {z}.", x=c, z="b")) == ["A y b."]


def test_numbers_from_text(spark):
    assert one(spark, [" 12 ", "", None], "string", num.number_or_zero) == [12.0, 0.0, 0.0]
    assert one(spark, ["1.5", "N/D", "*", None], "string", num.number_or_null) == [1.5, None, None, None]
    with pytest.raises(PySparkException):
        one(spark, ["doce"], "string", num.number_or_zero)


def test_round_half_even_is_exact(spark):
    items = [2.675, 0.125, 0.375, 1.005, -0.125, 99.995, 1e11 + 0.125, 0.0, float("inf"), 1e300, 7 / 3]
    got = values(spark, items, "double", lambda c: num.round_half_even(c, 2), lambda c: num.round_half_even(c, 4))
    assert got == [(round(x, 2), round(x, 4)) for x in items]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=300, max_size=300))
def test_round_half_even_on_any_number(spark, items):
    items = items + [round(x, 3) for x in items] + [math.floor(x) / 8 for x in items]
    assert one(spark, items, "double", lambda c: num.round_half_even(c, 2)) == [round(x, 2) for x in items]


def test_fixed_decimals_rounds_ties_away_from_zero(spark):
    items = [0.25, 0.35, -0.25, -0.04, 12.0, 99.95, 0.05]
    assert one(spark, items, "double", num.fixed_decimals) == ["0.3", "0.3", "-0.3", "-0.0", "12.0", "100.0", "0.1"]
    assert one(spark, [1.0], "double", lambda c: num.with_unit(c, "%")) == ["1.0 %"]
    assert one(spark, [1.0], "double", lambda c: num.with_unit(c, "")) == ["1.0"]


def test_ratios_do_not_fail(spark):
    assert one(spark, [2.0, 0.0, None], "double", lambda c: num.ratio(F.lit(1.0), c)) == [0.5, None, None]


def test_min_max_and_clamp(spark):
    assert one(spark, [0.0, 5.0, 10.0], "double", lambda c: num.min_max(c, F.lit(0.0), F.lit(10.0))) == [0.0, 0.5, 1.0]
    assert one(spark, [3.0], "double", lambda c: num.min_max(c, F.lit(3.0), F.lit(3.0))) == [0.5]
    assert one(spark, [-1.0, 50.0, 101.0], "double", num.clamp_percent) == [0.0, 50.0, 100.0]


def test_technology_limits(spark):
    speeds = [9.999, 10.0, 39.999, 40.0, float("nan"), None]
    assert one(spark, speeds, "double", num.technology) == ["3G", "4G", "4G", "5G", "5G", "5G"]


LARGE = [1e12, 1e13 + 0.125, 4e13 + 0.375, 1357420771768.533, 1234567890123.45, 2.0**52 - 0.5, 2.0**52, 2.0**53, 1e300,
         -1e13 - 0.125, -2.5, -0.125, 2.675, 0.5, 1.5, 2.5, 562949953421311.875]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_rounding_has_no_upper_limit(spark, digits):
    assert one(spark, LARGE, "double", lambda v: num.round_half_even(v, digits)) == [round(v, digits) for v in LARGE]


def test_fixed_decimals_of_large_values(spark):
    assert one(spark, [1234567890123.45, -4503599627370495.5, 1e13 + 0.25], "double", num.fixed_decimals) == [
        "1234567890123.4",
        "-4503599627370495.5",
        "10000000000000.3",
    ]


def test_decimals_never_lose_digits(spark):
    kind = "decimal(28,9)"
    assert one(spark, [0.00004, 0.00006, None, 123.123456789], "double", lambda v: num.exact_decimal(v, kind).cast("double")) == [
        0.00004, 0.00006, None, 123.123456789,
    ]
    with pytest.raises(PySparkException):
        one(spark, [0.0000000004], "double", lambda v: num.exact_decimal(v, kind))


def test_fold_of_long_text_in_other_scripts(spark):
    text = "".join(chr(0x4E00 + i % 6000) for i in range(30_000)) + " Été"
    assert one(spark, [text], "string", txt.fold) == [" ete"]


def test_counts_and_samples_of_fixed_values():
    assert (len(fixed.POVERTY_LABELS), len(fixed.LONG_COLUMNS)) == (len(dict(fixed.POVERTY_LABELS)), 9)
    assert fixed.SURVEY_YEAR == 2024 and fixed.COVERAGE_BOX == (-118.5, 14.5, -86.5, 32.7)
    assert [limit for _, limit in fixed.TECHNOLOGY_LIMITS_MBPS] == [10, 40]
