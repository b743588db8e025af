"""The data-quality report of a published dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from comarca import fixed_values as fixed
from comarca.operators import quality
from comarca.sinks import publish


@dataclass(frozen=True)
class RawSource:
    """A raw table as the report profiles it."""

    source_id: str
    file_name: str
    rows: DataFrame
    keys: tuple[str, ...]


def quality_report(
    raw: Sequence[RawSource],
    long: DataFrame,
    wide: DataFrame,
    catalog: DataFrame,
    expected_entities: int = fixed.EXPECTED_ENTITIES,
    head: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Sections of the report. ``long`` and ``wide`` are the stored tables, not their plans.

    ``head`` is the envelope of the wide dataset; its date and id become the report's. Summary and
    checks come from the same facts.
    """
    facts = quality.validation_facts(long, wide, catalog)
    profiles = [quality.source_profile(s.rows, s.source_id, s.file_name, s.keys) for s in raw]
    sections = {
        "summary": quality.summary_of(facts, len(raw)),
        "source_breakdown": quality.source_breakdown(long).orderBy("source"),
        "validation_checks": quality.checks_of(facts, expected_entities).orderBy("posicion"),
        "metrics_profile": quality.metric_profile(wide, catalog).orderBy("posicion"),
        "cleaning_logic": quality.cleaning_logic(long.sparkSession).orderBy("posicion"),
    }
    if head is not None:
        sections["envelope"] = head.select("updated_at", "dataset_id")
    if profiles:
        sections["raw_files"] = reduce(lambda a, b: a.unionByName(b), profiles)
    return sections


def publish_report(sections: dict[str, DataFrame], path: str) -> None:
    publish.write_report(sections, path)
