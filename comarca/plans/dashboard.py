"""Everything one dashboard session asks of a wide dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.operators import analytics as an
from comarca.operators import catalog as cat
from comarca.operators import insights as ins
from comarca.operators.insights import Focus


class Dashboard:
    """Lazy tables over the records of the selected entities.

    ``records`` is a stored wide table and ``metrics`` its catalog under dashboard names. The
    lists of metrics a section offers are the fixed ones.
    """

    def __init__(self, records: DataFrame, metrics: DataFrame, selected: Sequence[str] | None = None):
        self.everything = records
        self.metrics = metrics
        self.selected = fixed.DEFAULT_STATES if selected is None else list(selected)

    @cached_property
    def records(self) -> DataFrame:
        return an.select_entities(self.everything, self.selected)

    @cached_property
    def gaps(self) -> DataFrame:
        return an.with_gaps(self.records)

    @cached_property
    def scored(self) -> DataFrame:
        return an.opportunity(self.records)

    @cached_property
    def complete(self) -> DataFrame:
        """Records with gaps and scores."""
        return an.with_gaps(self.scored)

    def entity_names(self) -> DataFrame:
        return self.everything.select("cve_ent", "estado")

    def options(self, section: str) -> DataFrame:
        if section == "gap":
            rows = [(i, row[0], row[1], row[3]) for i, row in enumerate(fixed.GAP_METRICS)]
            return self.metrics.sparkSession.createDataFrame(rows, "posicion int, id string, label string, category string")
        ids = {
            "territorial": fixed.TERRITORIAL_METRICS,
            "population": fixed.POPULATION_METRICS,
            "adoption": fixed.ADOPTION_METRICS,
            "opportunity": fixed.OPPORTUNITY_METRICS,
        }
        return cat.metric_options(self.metrics, ids[section])

    def menu(self) -> DataFrame:
        return ins.menu_figures(self.complete)

    def cards(self, section: str, focus: Focus) -> DataFrame:
        if section == "opportunity":
            return ins.opportunity_cards(self.scored, focus)
        return ins.section_cards(self.gaps if section == "gap" else self.records, section, focus)

    def insights(self, section: str, focus: Focus) -> DataFrame:
        return {
            "territorial": lambda: ins.territorial_insights(self.records, focus),
            "population": lambda: ins.population_insights(self.records, focus),
            "gap": lambda: ins.gap_insights(self.gaps, focus),
            "adoption": lambda: ins.adoption_insights(self.records, focus),
            "opportunity": lambda: ins.opportunity_insights(self.scored, focus),
            "executive": lambda: ins.executive_insights(self.scored),
            "metric": lambda: ins.metric_insights(self.records, focus),
        }[section]()

    def all_cards(self, focus: dict[str, Focus]) -> DataFrame:
        """Cards of the named sections with their ``section``, from one aggregation."""
        records = self.complete
        parts = {
            name: ins.opportunity_cards_part(records, f) if name == "opportunity" else ins.cards_part(records, name, f)
            for name, f in focus.items()
        }
        return ins.told(records, parts)

    def all_insights(self, focus: dict[str, Focus]) -> DataFrame:
        """Sentences of the named sections with their ``section``, from one aggregation."""
        made = {
            "territorial": ins.territorial_part,
            "population": ins.population_part,
            "gap": ins.gap_part,
            "adoption": ins.adoption_part,
            "opportunity": ins.opportunity_part,
        }
        return ins.told(self.complete, {name: made[name](self.complete, f) for name, f in focus.items()})

    def ranking(self, section: str, name: str) -> DataFrame:
        if section == "opportunity":
            return self.scored.select("cve_ent", "estado", F.col("opportunityScore").alias("valor")).orderBy(F.desc("valor"), "cve_ent")
        return an.ranking(self.gaps if section == "gap" else self.records, name)

    def dumbbell(self, section: str, name: str) -> DataFrame:
        if section == "gap":
            base, covered, _, _ = an.gap_pair(name)
            return an.paired_ranking(self.gaps, base, covered)
        return an.paired_ranking(self.records, an.population_pair(name)[0], name)

    def scatter(self, section: str, name: str) -> DataFrame:
        size = "poblacion_en_localidades_con_5g_garantizada_pct"
        if section == "territorial":
            return an.scatter(self.records, "teledensidad_internet_movil", name, size)
        if section == "opportunity":
            return an.scatter(self.scored, "opportunityScore", name, size)
        return an.scatter(self.records, an.adoption_pair(name)[0], name)

    def heatmap(self, names: Sequence[str] = tuple(fixed.ADOPTION_METRICS)) -> DataFrame:
        return an.heatmap(self.records, self.metrics, names)

    def radar(self, names: Sequence[str]) -> DataFrame:
        return an.radar(self.records, self.metrics, names, self.selected)
