"""Metric declarations: what to count, what to weigh it with and how to label it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from comarca import fixed_values as fixed
from comarca.functions.text import quoted, strip_sql


@dataclass(frozen=True)
class Metric:
    """Labels every metric carries into the long table and the metric catalog."""

    variable: str
    categoria: str
    label: str
    unidad: str
    source_table: str = ""


@dataclass(frozen=True)
class Share(Metric):
    """A weighted share: rows whose trimmed ``column`` is one of ``positive_values``."""

    column: str = ""
    positive_values: tuple[str, ...] = ()
    weight: str = ""

    def holds(self, df: DataFrame) -> str:
        """The condition as SQL; never null. A column the table lacks makes every answer negative."""
        kind = dict(df.dtypes).get(self.column)
        if kind is None:
            return "false"
        if kind in ("tinyint", "smallint", "int", "bigint"):
            codes = [value for value in self.positive_values if value.removeprefix("-").isdecimal() and str(int(value)) == value]
            return f"coalesce(`{self.column}` in ({', '.join(codes)}), false)" if codes else "false"
        listed = f"in ({', '.join(map(quoted, self.positive_values))})"
        if kind != "string":
            return f"coalesce(cast(`{self.column}` as string) {listed}, false)"
        # Stripping only shortens, so an answer no longer than the shortest value needs none.
        shortest = min(len(value.encode()) for value in self.positive_values)
        stripped = f"(octet_length(`{self.column}`) > {shortest} and {strip_sql(f'`{self.column}`')} {listed})"
        return f"coalesce(`{self.column}` {listed} or {stripped}, false)"


@dataclass(frozen=True)
class DirectValue(Metric):
    """A value some authority already aggregated per entity."""

    value_column: str = ""
    entity_column: str = ""
    year_column: str = ""
    sequence_column: str = ""
    fuente: str = ""


@dataclass(frozen=True)
class ContextVariable(Metric):
    anio: int = 0
    fuente_sugerida: str = ""
    sinonimos: tuple[str, ...] = ()


def survey_shares() -> list[Share]:
    return [
        Share(variable, categoria, label, unidad, table, column=column, positive_values=(code,))
        for variable, categoria, label, unidad, table, column, code in fixed.SURVEY_SHARES
    ]


def locality_shares() -> list[Share]:
    return [
        Share(
            variable, categoria, label, unidad, fixed.LOCALITY_SOURCE_TABLE,
            column=column, positive_values=(value,), weight=weight,
        )
        for variable, categoria, label, unidad, weight, column, value in fixed.LOCALITY_SHARES
    ]


def direct_values() -> list[DirectValue]:
    return [
        DirectValue(
            variable, categoria, label, unidad, table,
            value_column=value, entity_column=entity, year_column=year, sequence_column=month, fuente=fuente,
        )
        for variable, categoria, label, unidad, table, value, entity, year, month, fuente in fixed.DIRECT_VALUES
    ]


def context_variables() -> list[ContextVariable]:
    return [
        ContextVariable(variable, categoria, label, unidad, "", anio=anio, fuente_sugerida=fuente, sinonimos=tuple(names))
        for variable, anio, categoria, label, unidad, fuente, names in fixed.CONTEXT_VARIABLES
    ]


def by_source_table(specs: Iterable[Share]) -> dict[str, list[Share]]:
    groups: dict[str, list[Share]] = {}
    for spec in specs:
        groups.setdefault(spec.source_table, []).append(spec)
    return groups
