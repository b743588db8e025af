"""Sentences, cards and menu figures.

A section is a :class:`Part`; any number of parts over the same records takes one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.numeric import fixed_decimals, with_unit
from comarca.functions.text import fill_in
from comarca.operators import analytics as an

_4G_POPULATION = "poblacion_en_localidades_con_4g_garantizada_pct"
_4G_LOCALITIES = "localidades_con_4g_garantizada_pct"
_5G_POPULATION = "poblacion_en_localidades_con_5g_garantizada_pct"
_TELEDENSITY = "teledensidad_internet_movil"


@dataclass(frozen=True)
class Focus:
    """The metric a section looks at."""

    id: str
    label: str
    unit: str

    @property
    def lowered(self) -> Column:
        return F.lower(F.lit(self.label))


def gap_focus(name: str = fixed.DEFAULT_GAP_METRIC) -> Focus:
    known = {row[0]: Focus(*row[:3]) for row in fixed.GAP_METRICS}
    return known.get(name, Focus(*fixed.GAP_METRICS[0][:3]))


SCORE = Focus(*fixed.SCORE_METRIC[:3])


@dataclass(frozen=True)
class Part:
    """Aggregates of the records, by name, and the rows that are told from them.

    ``rows`` gets a function that gives an aggregate by its name and returns an array of structs.
    """

    aggregates: dict[str, Column]
    rows: Callable[[Callable[[str], Column]], Column]


def told(records: DataFrame, parts: dict[str, Part]) -> DataFrame:
    """Rows of all parts with their ``section``, from one aggregation; no records, no rows."""
    structs = [
        F.struct(*[column.alias(key) for key, column in part.aggregates.items()]).alias(f"_{name}") for name, part in parts.items()
    ]
    facts = records.agg(F.count(F.lit(1)).alias("_n"), *structs).where(F.col("_n") > 0)

    def rows(name: str, part: Part) -> Column:
        return F.transform(
            part.rows(lambda key: F.col(f"_{name}.{key}")), lambda row: F.struct(row.alias("row"), F.lit(name).alias("section"))
        )

    every = F.concat(*[rows(name, part) for name, part in parts.items()])
    return facts.select(F.inline(every)).select("row.*", "section")


def _alone(records: DataFrame, part: Part) -> DataFrame:
    return told(records, {"only": part}).drop("section")


def _sentences(templates: Sequence[str], **values: Column | str) -> Column:
    """The filled templates as structs of ``posicion`` and ``texto``."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("posicion"), fill_in(template, **values).alias("texto"))
            for i, template in enumerate(templates)
        ]
    )


def _facts(records: DataFrame, **aggregates: Column) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("_n"), *[column.alias(name) for name, column in aggregates.items()])


def territorial_part(records: DataFrame, focus: Focus) -> Part:
    value = an.metric(records, focus.id)
    aggregates = {
        "leader": an.top(value),
        "teledensity_leader": an.top(an.metric(records, _TELEDENSITY)),
        "laggard": an.bottom(value),
    }
    return Part(
        aggregates,
        lambda fact: _sentences(fixed.TERRITORIAL_SENTENCES, label=focus.lowered, **{name: fact(name) for name in aggregates}),
    )


def population_part(records: DataFrame, focus: Focus) -> Part:
    value = an.metric(records, focus.id)
    aggregates = {
        "leader": an.top(value),
        "average": an.average(value),
        "gap": an.average(an.metric(records, _4G_POPULATION)) - an.average(an.metric(records, _4G_LOCALITIES)),
    }
    return Part(
        aggregates,
        lambda fact: _sentences(
            fixed.POPULATION_SENTENCES, label=focus.lowered, unit=focus.unit, leader=fact("leader"),
            average=fixed_decimals(fact("average")), gap=fixed_decimals(fact("gap")),
        ),
    )


def gap_part(records: DataFrame, focus: Focus) -> Part:
    """``records`` come from :func:`comarca.operators.analytics.with_gaps`."""
    value = an.metric(records, focus.id)
    return Part(
        {"leader": an.top(value), "lowest": an.bottom(value), "average": an.average(value)},
        lambda fact: _sentences(
            fixed.GAP_SENTENCES, label=focus.lowered, leader=fact("leader"), lowest=fact("lowest"),
            base=F.lower(F.lit(an.gap_pair(focus.id)[2])), average=fixed_decimals(fact("average")),
        ),
    )


def adoption_part(records: DataFrame, focus: Focus) -> Part:
    coverage, label = an.adoption_pair(focus.id)
    covered = an.metric(records, coverage)
    return Part(
        {"leader": an.top(an.metric(records, focus.id)), "coverage_leader": an.top(covered), "average": an.average(covered)},
        lambda fact: _sentences(
            fixed.ADOPTION_SENTENCES, label=focus.lowered, coverage=F.lower(F.lit(label)), leader=fact("leader"),
            coverage_leader=fact("coverage_leader"), average=fixed_decimals(fact("average")),
        ),
    )


def opportunity_part(scored: DataFrame, focus: Focus) -> Part:
    """``scored`` comes from :func:`comarca.operators.analytics.opportunity`."""
    aggregates = {
        "leader": an.top(F.col("opportunityScore")),
        "market_leader": an.top(F.col("marketAttractiveness")),
        "whitespace_leader": an.top(F.col("whitespaceScore")),
    }
    return Part(
        aggregates,
        lambda fact: _sentences(fixed.OPPORTUNITY_SENTENCES, label=focus.label, **{name: fact(name) for name in aggregates}),
    )


def territorial_insights(records: DataFrame, focus: Focus) -> DataFrame:
    return _alone(records, territorial_part(records, focus))


def population_insights(records: DataFrame, focus: Focus) -> DataFrame:
    return _alone(records, population_part(records, focus))


def gap_insights(records: DataFrame, focus: Focus) -> DataFrame:
    return _alone(records, gap_part(records, focus))


def adoption_insights(records: DataFrame, focus: Focus) -> DataFrame:
    return _alone(records, adoption_part(records, focus))


def opportunity_insights(scored: DataFrame, focus: Focus) -> DataFrame:
    return _alone(scored, opportunity_part(scored, focus))


def executive_insights(scored: DataFrame) -> DataFrame:
    aggregates = {
        "internet_leader": an.top(an.metric(scored, "personas_usuarias_internet_pct")),
        "teledensity_leader": an.top(an.metric(scored, _TELEDENSITY)),
        "coverage_leader": an.top(an.metric(scored, _4G_POPULATION)),
        "opportunity_leader": an.top(F.col("opportunityScore")),
    }
    return _alone(
        scored,
        Part(aggregates, lambda fact: _sentences(fixed.EXECUTIVE_SENTENCES, **{name: fact(name) for name in aggregates})),
    )


def metric_insights(records: DataFrame, focus: Focus) -> DataFrame:
    """A missing value makes the average unknown here, and shows as ``NaN``."""
    value = an.metric(records, focus.id)

    def shown(fact: Column) -> Column:
        return F.coalesce(fixed_decimals(fact), F.lit("NaN"))

    part = Part(
        {
            "leader": an.top(value),
            "laggard": an.last_ranked(value),
            "top": an.top(value, value),
            "average": an.strict_average(value),
        },
        lambda fact: _sentences(
            fixed.METRIC_SENTENCES, label=focus.lowered, unit=focus.unit, leader=fact("leader"),
            laggard=fact("laggard"), top=shown(fact("top")), average=shown(fact("average")),
        ),
    )
    return _alone(records, part)


def menu_figures(scored_with_gaps: DataFrame) -> DataFrame:
    """The five figures of the menu, from records that carry gaps and scores."""
    records = scored_with_gaps
    facts = _facts(
        records,
        leader_5g=an.top(an.metric(records, _5G_POPULATION)),
        households=an.average(an.metric(records, "hogares_en_localidades_con_internet_pct")),
        gap=an.average(an.metric(records, "brecha_cobertura_movil_pp")),
        leader_smartphone=an.top(an.metric(records, "personas_con_smartphone_pct")),
        priority=an.top(F.col("opportunityScore")),
    )
    values = [
        F.coalesce("leader_5g", F.lit(fixed.NOT_AVAILABLE)),
        F.concat(fixed_decimals(F.col("households")), F.lit("%")),
        F.concat(fixed_decimals(F.col("gap")), F.lit(" pp")),
        F.coalesce("leader_smartphone", F.lit(fixed.NOT_AVAILABLE)),
        F.coalesce("priority", F.lit(fixed.NOT_AVAILABLE)),
    ]
    figures = [
        F.struct(F.lit(i).alias("posicion"), F.lit(section).alias("seccion"), F.lit(caption).alias("label"), value.alias("value"))
        for i, ((section, caption), value) in enumerate(zip(fixed.MENU_CAPTIONS, values))
    ]
    return facts.select(F.inline(F.array(*figures)))


def _card(position: int, label: str, value: Column, helper: Column) -> Column:
    return F.struct(
        F.lit(position).alias("posicion"), F.lit(label).alias("label"), value.alias("value"), helper.alias("helper")
    )


def _leader_card(label: str, focus: Focus, top: Column, leader: Column) -> Column:
    return _card(
        0,
        label,
        F.coalesce(with_unit(top, focus.unit), F.lit(fixed.NOT_AVAILABLE)),
        F.when(leader.isNull(), F.lit(fixed.NO_DATA)).otherwise(
            fill_in(fixed.CARD_LEADER_HELPER, state=leader, label=focus.lowered)
        ),
    )


def _average_card(focus: Focus, average: Column) -> Column:
    return _card(
        1, fixed.CARD_AVERAGE, with_unit(average, focus.unit), fill_in(fixed.CARD_AVERAGE_HELPER, label=focus.lowered)
    )


def cards_part(records: DataFrame, section: str, focus: Focus) -> Part:
    """Leader, average and the average of the associated metric of one dashboard section.

    ``section`` is ``territorial``, ``population``, ``gap`` or ``adoption``.
    """
    if section == "territorial":
        leader, other, (third, helper) = fixed.CARD_LEADER, _5G_POPULATION, fixed.CARD_5G
    elif section == "population":
        other, label = an.population_pair(focus.id)
        leader, third, helper = fixed.CARD_LEADER, fixed.CARD_BASE, fixed.CARD_PAIR_HELPER.format(label=label)
    elif section == "gap":
        _, other, _, label = an.gap_pair(focus.id)
        leader, third, helper = fixed.CARD_WIDEST_GAP, fixed.CARD_GAP_COVERAGE, fixed.CARD_PAIR_HELPER.format(label=label)
    elif section == "adoption":
        other, label = an.adoption_pair(focus.id)
        leader, third, helper = fixed.CARD_LEADER, fixed.CARD_COVERAGE, fixed.CARD_PAIR_HELPER.format(label=label)
    else:
        raise ValueError(f"unknown section: {section}")
    value = an.metric(records, focus.id)
    aggregates = {
        "leader": an.top(value),
        "top": an.top(value, value),
        "average": an.average(value),
        "other": an.average(an.metric(records, other)),
    }
    return Part(
        aggregates,
        lambda fact: F.array(
            _leader_card(leader, focus, fact("top"), fact("leader")),
            _average_card(focus, fact("average")),
            _card(2, third, with_unit(fact("other"), "%"), F.lit(helper)),
        ),
    )


def opportunity_cards_part(scored: DataFrame, focus: Focus) -> Part:
    """Priority territory, mean score and the metric in focus."""
    score = F.col("opportunityScore")
    return Part(
        {"leader": an.top(score), "best": an.top(score, score), "mean": F.avg(score)},
        lambda fact: F.array(
            _card(0, fixed.CARD_PRIORITY[0], fact("leader"), fill_in(fixed.CARD_PRIORITY[1], value=fixed_decimals(fact("best")))),
            _card(1, fixed.CARD_SCORE_AVERAGE[0], with_unit(fact("mean"), SCORE.unit), F.lit(fixed.CARD_SCORE_AVERAGE[1])),
            _card(2, fixed.CARD_FOCUS[0], F.lit(focus.label), F.lit(fixed.CARD_FOCUS[1])),
        ),
    )


def section_cards(records: DataFrame, section: str, focus: Focus) -> DataFrame:
    return _alone(records, cards_part(records, section, focus))


def opportunity_cards(scored: DataFrame, focus: Focus) -> DataFrame:
    return _alone(scored, opportunity_cards_part(scored, focus))
