"""Estimators that turn microdata, locality facts and published figures into entity values.

Every estimator aggregates to one row per entity before it meets another table, so a hot
entity or locality is reduced map-side and never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.numeric import exact_decimal, number_or_zero, round_half_even
from comarca.functions.text import is_blank, strip, zero_fill
from comarca.operators import exact_sums
from comarca.operators.observations import observations
from comarca.specs import DirectValue, Metric, Share

#: Weights are doubles, whose sums are exact (`operators.exact_sums`) and so don't depend on the order of rows.
#: A decimal type may be declared where weights are known to fit it: up to precision 8 Catalyst adds them as plain
#: longs; a weight with more decimals than the type has is an error.
WEIGHT_TYPE = "double"
LOCALITY_WEIGHTS = ("poblacion", "hogares", "localidades")


def _share(part: str, whole: str) -> str:
    """The share in percent as SQL; nobody positive is 0, not missing."""
    return f"coalesce(try_divide(cast(`{part}` as double), cast(`{whole}` as double)), 0D) * 100D"


def _columns(expressions: Iterable[tuple[str, str]]) -> list[Column]:
    return [F.expr(f"{sql} as `{name}`") for sql, name in expressions]


def _is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def _present(df: DataFrame, name: str) -> Column:
    return ~is_blank(F.col(name)) if _is_text(df, name) else F.col(name).isNotNull()


def _stripped(df: DataFrame, name: str) -> Column:
    return strip(F.col(name)) if _is_text(df, name) else F.col(name)


def _of_year(df: DataFrame, name: str, year: int | str, parse: bool = False) -> Column:
    """Rows of a year. Whole-number columns are compared as they are, which the scan can use; texts
    are stripped, and read as numbers where ``parse`` is set."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name) == int(year)
    text = strip(F.col(name).cast("string"))
    return text.cast("int") == int(year) if parse else text == str(year)


def weighed_answers(
    persons: DataFrame,
    specs: Sequence[Share],
    key: str,
    weight: str,
    weight_type: str = WEIGHT_TYPE,
    carried: Sequence[Column] = (),
) -> DataFrame:
    """_key, _weight, ``carried`` and one true-or-false column per metric, of persons with key and weight.

    The weight is parsed strictly: text that is no number is an error under ANSI mode.
    """
    value = _stripped(persons, weight)
    number = value.cast("double") if weight_type == "double" else exact_decimal(value, weight_type)
    return persons.where(_present(persons, key) & _present(persons, weight)).select(
        _stripped(persons, key).alias("_key"),
        number.alias("_weight"),
        *carried,
        *_columns((spec.holds(persons), spec.variable) for spec in specs),
    )


def answer_parts(specs: Sequence[Share]) -> dict[str, str]:
    """What is added up for shares: everybody's weight, and that of each metric's positive answers."""
    return {"_total": "true", **{spec.variable: f"`{spec.variable}`" for spec in specs}}


def weighted_totals(
    persons: DataFrame,
    specs: Sequence[Share],
    key: str,
    weight: str,
    weight_type: str = WEIGHT_TYPE,
    entity_of: DataFrame | None = None,
) -> DataFrame:
    """cve_ent, the total weight and the weight of every positive answer: one scan, one shuffle.

    Everything is summed per key first; with ``entity_of`` (``unit, cve_ent``) the sums of units then
    become those of their entities, on the same partitioning.
    """
    kept = weighed_answers(persons, specs, key, weight, weight_type)
    parts = answer_parts(specs)
    if weight_type == "double":
        sums = exact_sums.partial_sums(kept, ["_key"], "_weight", parts)
    else:
        sums = kept.groupBy("_key").agg(
            *_columns((f"sum(case when {condition} then _weight end)", name) for name, condition in parts.items())
        )
    if entity_of is None:
        units = sums.withColumn("cve_ent", F.col("_key").cast("string"))
    else:
        units = sums.join(entity_of, F.col("_key") == F.col("unit"), "inner")
    if weight_type == "double":
        # Sums of a key are one row a bucket already; those of an entity's units are added up first.
        units = units if entity_of is None else exact_sums.merged(units, ["cve_ent"], list(parts))
        return exact_sums.totals(units, ["cve_ent"], list(parts))
    if entity_of is None:
        return units
    return units.groupBy("cve_ent").agg(*[F.sum(name).alias(name) for name in parts])


def shares_of_totals(totals: DataFrame, specs: Sequence[Share]) -> DataFrame:
    """Shares in percent; an entity whose weights add up to 0 is left out."""
    return totals.where(F.col("_total") != 0).select(
        "cve_ent", *_columns((_share(spec.variable, "_total"), spec.variable) for spec in specs)
    )


def weighted_shares(
    persons: DataFrame,
    specs: Sequence[Share],
    entity: str = fixed.SURVEY_ENTITY_COLUMN,
    weight: str = fixed.SURVEY_WEIGHT_COLUMN,
    weight_type: str = WEIGHT_TYPE,
    entity_of: DataFrame | None = None,
) -> DataFrame:
    """All weighted shares of one microdata table by entity.

    Everyone with entity and weight counts in the denominator, whatever the answer. An entity
    whose weights add up to 0 is left out. Where persons carry the code of a smaller unit in
    place of the entity, ``entity_of`` (``unit, cve_ent``, one row per unit) leads from one to
    the other: totals are summed per unit first and only then joined, on the same partitioning.
    """
    return shares_of_totals(weighted_totals(persons, specs, entity, weight, weight_type, entity_of), specs)


def latest_localities(
    localities: DataFrame,
    order_by: str = "ID",
    key: str = "CVEGEO",
    entity: str = "ENT",
    population: str = "POBLACION",
    households: str = "TOTHOG",
) -> DataFrame:
    """One row per locality: the last one in ``order_by`` order wins.

    ``max`` of a struct combines map-side, so a locality repeated any number of times costs
    one row per map task in the shuffle (a window would sort all copies in one task).
    """
    rows = localities.select(
        F.coalesce(strip(F.col(key).cast("string")), F.lit("")).alias("cvegeo"),
        F.struct(
            F.col(order_by).alias("_order"),
            zero_fill(strip(F.col(entity).cast("string"))).alias("cve_ent"),
            number_or_zero(F.col(population)).alias("poblacion"),
            number_or_zero(F.col(households)).alias("hogares"),
        ).alias("_row"),
    )
    last = rows.groupBy("cvegeo").agg(F.max("_row").alias("_row"))
    return last.select(
        "cvegeo", "_row.cve_ent", "_row.poblacion", "_row.hogares", F.lit(1.0).alias("localidades")
    )


def locality_shares(
    connectivity: DataFrame,
    localities: DataFrame,
    specs: Sequence[Share],
    year: int | str = fixed.SURVEY_YEAR,
    key: str = "CVEGEO",
    year_column: str = "ANIO",
    clean: bool = False,
) -> DataFrame:
    """Shares of localities, people or households by entity of the locality.

    ``localities`` comes from :func:`latest_localities`. The fact table is counted per
    locality first: a locality with a third of all facts becomes one row, both join sides
    have one row per key, and they are already partitioned by it. ``clean`` says that keys are stored
    stripped (`sinks.layouts`): tables bucketed by them then meet without a shuffle.
    """
    code = F.col(key) if clean else F.coalesce(strip(F.col(key).cast("string")), F.lit(""))
    of_year = connectivity.where(_of_year(connectivity, year_column, year)).select(
        code.alias("cvegeo"), *_columns((spec.holds(connectivity), spec.variable) for spec in specs)
    )
    counted = of_year.groupBy("cvegeo").agg(
        F.count(F.lit(1)).alias("_rows"),
        *_columns((f"count_if(`{spec.variable}`)", spec.variable) for spec in specs),
    )
    joined = counted.join(localities, "cvegeo", "inner")
    # A row per locality and weight: partial sums go by the bucket of the weight.
    weights = F.array(*[F.struct(F.lit(name).alias("_of"), F.col(name).cast("double").alias("_weight")) for name in LOCALITY_WEIGHTS])
    counts = ["_rows", *(spec.variable for spec in specs)]
    stacked = joined.select("cve_ent", *counts, F.inline(weights))
    sums = exact_sums.partial_sums(stacked, ["cve_ent", "_of"], "_weight", {name: f"`{name}`" for name in counts}, times=True)
    exact = exact_sums.totals(sums, ["cve_ent", "_of"], counts)

    def of(weight: str, name: str) -> str:
        return f"max(case when `_of` = '{weight}' then `{name}` end)"

    totals = exact.groupBy("cve_ent").agg(
        *_columns((of(weight, "_rows"), f"_{weight}") for weight in LOCALITY_WEIGHTS),
        *_columns((of(spec.weight, spec.variable), spec.variable) for spec in specs),
    )
    return totals.select(
        "cve_ent",
        *_columns(
            (f"case when `_{spec.weight}` <> 0 then {_share(spec.variable, '_' + spec.weight)} end", spec.variable)
            for spec in specs
        ),
    )


def share_observations(
    shares: DataFrame, specs: Sequence[Metric], master: DataFrame | None, anio: int, fuente: str, digits: int = 2
) -> DataFrame:
    """Long rows of a share table: known entities only, missing shares left out, rounded."""
    return observations(
        shares, [(spec, anio) for spec in specs], master, fuente, rounded=lambda v: round_half_even(v, digits)
    )


def direct_observations(
    published: DataFrame, spec: DirectValue, master: DataFrame | None, year: int = fixed.SURVEY_YEAR
) -> DataFrame:
    """Long rows of published values: parsed, not rounded, one row per source row of the year."""
    sequence = F.col(spec.sequence_column).cast("long") if spec.sequence_column in published.columns else F.lit(0).cast("long")
    rows = published.where(_of_year(published, spec.year_column, year, parse=True)).select(
        zero_fill(strip(F.col(spec.entity_column).cast("string"))).alias("cve_ent"),
        strip(F.col(spec.value_column).cast("string")).cast("double").alias(spec.variable),
        sequence.alias("secuencia"),
    )
    return observations(rows, [(spec, year)], master, spec.fuente)
