"""The survey dataset: microdata shares, published values and locality shares, long and wide."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from comarca import fixed_values as fixed
from comarca.operators import estimators, observations
from comarca.sinks import publish
from comarca.specs import DirectValue, Metric, Share, by_source_table, direct_values, locality_shares, survey_shares


@dataclass(frozen=True)
class Microdata:
    """Persons with their entity (or unit, see ``entity_of``) and weight columns."""

    persons: DataFrame
    entity: str = fixed.SURVEY_ENTITY_COLUMN
    weight: str = fixed.SURVEY_WEIGHT_COLUMN
    weight_type: str = estimators.WEIGHT_TYPE
    entity_of: DataFrame | None = None


@dataclass(frozen=True)
class SurveyInputs:
    """Raw tables. ``microdata`` and ``published`` are keyed by the source table of the specs."""

    microdata: dict[str, Microdata]
    published: dict[str, DataFrame]
    connectivity: DataFrame
    localities: DataFrame
    master: DataFrame
    locality_order: str = "ID"


@dataclass(frozen=True)
class SurveyMetrics:
    """What to measure; the published metrics unless others are declared."""

    shares: tuple[Share, ...] = field(default_factory=lambda: tuple(survey_shares()))
    direct: tuple[DirectValue, ...] = field(default_factory=lambda: tuple(direct_values()))
    localities: tuple[Share, ...] = field(default_factory=lambda: tuple(locality_shares()))

    @property
    def all(self) -> list[Metric]:
        """Catalog order."""
        return [*self.shares, *self.direct, *self.localities]

    @property
    def variables(self) -> list[str]:
        return [spec.variable for spec in self.all]


def survey_families(
    inputs: SurveyInputs, year: int = fixed.SURVEY_YEAR, metrics: SurveyMetrics | None = None
) -> list[DataFrame]:
    """Long rows of each family, without the entities' names. Every raw table is scanned once."""
    metrics = metrics or SurveyMetrics()
    families = []
    for table, specs in by_source_table(metrics.shares).items():
        source = inputs.microdata[table]
        shares = estimators.weighted_shares(
            source.persons, specs, source.entity, source.weight, source.weight_type, source.entity_of
        )
        families.append(estimators.share_observations(shares, specs, None, year, fixed.SURVEY_SOURCE))
    for spec in metrics.direct:
        families.append(estimators.direct_observations(inputs.published[spec.source_table], spec, None, year))
    if metrics.localities:
        last = estimators.latest_localities(inputs.localities, inputs.locality_order)
        shares = estimators.locality_shares(inputs.connectivity, last, metrics.localities, year)
        families.append(
            estimators.share_observations(shares, metrics.localities, None, year, fixed.LOCALITY_SOURCE)
        )
    return families


def survey_observations(
    inputs: SurveyInputs, year: int = fixed.SURVEY_YEAR, metrics: SurveyMetrics | None = None
) -> DataFrame:
    """The long table of all families; the master is joined once, to all of them."""
    return observations.of_entities(observations.append(survey_families(inputs, year, metrics)), inputs.master)


def survey_wide(
    long: DataFrame, master: DataFrame, year: int = fixed.SURVEY_YEAR, metrics: SurveyMetrics | None = None
) -> DataFrame:
    return observations.wide_records(long, master, (metrics or SurveyMetrics()).variables, year)


def publish_survey(
    inputs: SurveyInputs, folder: str, updated_at: str, public_folder: str | None = None
) -> None:
    """Write the long table, then derive everything else from what was written.

    The written long table has one row per entity and metric, so the wide export costs
    nothing next to the scans, and nothing of it is computed twice.
    """
    spark = inputs.master.sparkSession
    long = survey_observations(inputs)
    stored = f"{folder}/{fixed.SURVEY_LONG_ID}/parquet"
    long.write.mode("overwrite").parquet(stored)
    long = spark.read.parquet(stored)

    publish.write_long_json(
        long,
        f"{folder}/{fixed.SURVEY_LONG_ID}",
        publish.envelope(long, updated_at, fixed.SURVEY_LONG_ID, fixed.SURVEY_SOURCE),
    )
    publish.write_long_csv(long, f"{folder}/{fixed.SURVEY_LONG_ID}/csv")
    copies = [f"{folder}/{fixed.SURVEY_WIDE_ID}"]
    if public_folder:
        copies.append(f"{public_folder}/{fixed.SURVEY_WIDE_ID}")
    publish.write_wide_document(
        survey_wide(long, inputs.master),
        observations.metric_catalog(spark, SurveyMetrics().all),
        publish.envelope(long, updated_at, fixed.SURVEY_WIDE_ID, fixed.SURVEY_SOURCE),
        copies,
    )
