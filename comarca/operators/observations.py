"""The long observation table, its wide form and the metric catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.text import quoted
from comarca.specs import ContextVariable, Metric

CATALOG_SCHEMA = "variable_id string, categoria_id string, label string, unidad string, source_table string"


def observations(
    values: DataFrame,
    specs: Sequence[tuple[Metric, int]],
    master: DataFrame | None,
    fuente: str,
    rounded: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Unpivot one value column per metric into long rows of the entities the master knows.

    Without ``master`` the rows still lack the entity's names; :func:`of_entities` adds them to
    families that were appended to each other.

    The labels travel as literals of the unpivot, so no metadata join is needed. The column
    ``secuencia`` (0 unless the input has it) orders rows of the same entity and variable;
    it is not part of the published table.
    """
    sequence = F.col("secuencia") if "secuencia" in values.columns else F.lit(0).cast("long")
    items = ", ".join(
        f"named_struct('categoria', {quoted(spec.categoria)}, 'variable', {quoted(spec.variable)}, "
        f"'valor', cast(`{spec.variable}` as double), 'anio', {int(anio)}, 'unidad', {quoted(spec.unidad)})"
        for spec, anio in specs
    )
    unpivoted = values.select("cve_ent", sequence.alias("secuencia"), F.expr(f"inline(array({items}))"))
    rows = unpivoted.where(F.col("valor").isNotNull() & ~F.isnan("valor"))
    if rounded is not None:
        rows = rows.withColumn("valor", rounded(F.col("valor")))
    rows = rows.withColumn("fuente", F.lit(fuente))
    return rows if master is None else of_entities(rows, master)


def of_entities(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Rows of the entities the master knows, with their names."""
    entities = master.select("cve_ent", "state_code", "estado")
    return rows.join(entities, "cve_ent", "inner").select(*fixed.LONG_COLUMNS, "secuencia")


def append(families: Sequence[DataFrame]) -> DataFrame:
    """All metric families in one long table; nothing is removed."""
    return reduce(lambda left, right: left.unionByName(right), families)


def pivot_metrics(long: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("cve_ent",)) -> DataFrame:
    """One column per variable, in one aggregation; of repeated pairs the last one stays.

    Last means the highest ``secuencia``, then the highest value, so the result does not
    depend on how the rows are spread over files and tasks.
    """
    wanted, value = ("struct(secuencia, valor)", ".valor") if "secuencia" in long.columns else ("valor", "")
    return long.groupBy(*keys).agg(
        *[F.expr(f"max(case when variable = {quoted(name)} then {wanted} end){value} as `{name}`") for name in variables]
    )


def sparse_pivot(long: DataFrame, keys: Sequence[str] = ("cve_ent",)) -> DataFrame:
    """A ``metrics`` map per key of whatever variables there are, in their order; of repeated pairs the last one stays.

    What :func:`pivot_metrics` and :func:`pack_metrics` give for a list of variables, but without the list and with
    a plan of the same size for any number of them. Pairs are combined before the second shuffle, so a key with a third
    of all rows arrives as one row per variable. Null values, and rows without a variable, leave no entry; a key
    that has no other rows keeps an empty map.
    """
    order = F.struct("secuencia", "valor") if "secuencia" in long.columns else F.struct("valor")
    last = long.groupBy(*keys, "variable").agg(F.max(order).alias("_last"))
    entry = F.struct("variable", F.col("_last.valor").alias("valor"))
    known = F.when(F.col("variable").isNotNull() & F.col("_last.valor").isNotNull(), entry)
    entries = last.groupBy(*keys).agg(F.array_sort(F.collect_list(known)).alias("_entries"))
    return entries.select(*keys, F.map_from_entries("_entries").alias("metrics"))


def pack_metrics(wide: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Fold one column per variable into a ``metrics`` map that holds no nulls."""
    pairs = ", ".join(f"{quoted(name)}, `{name}`" for name in variables)
    others = [name for name in wide.columns if name not in set(variables)]
    return wide.select(*others, F.expr(f"map_filter(map({pairs}), (k, v) -> v is not null) as metrics"))


def unpack_metrics(wide: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The opposite of :func:`pack_metrics`; metrics an entity lacks become null."""
    others = [name for name in wide.columns if name != "metrics"]
    return wide.selectExpr(*others, *[f"try_element_at(metrics, {quoted(name)}) as `{name}`" for name in variables])


def wide_records(
    long: DataFrame, master: DataFrame, variables: Sequence[str] | None, anio: int | None = None
) -> DataFrame:
    """One record per entity with its metrics map; ``anio`` only where the dataset has one year. Where
    ``variables`` is None the map holds all there are."""
    metrics = sparse_pivot(long) if variables is None else pack_metrics(pivot_metrics(long, variables), variables)
    entities = master.select(*fixed.WIDE_ENTITY_COLUMNS)
    year = [F.lit(anio).cast("int").alias("anio")] if anio is not None else []
    return metrics.join(entities, "cve_ent", "inner").select(*fixed.WIDE_ENTITY_COLUMNS, *year, "metrics")


def long_from_wide(wide: DataFrame) -> DataFrame:
    """Entity, variable and value of every metric in the map."""
    return wide.select("cve_ent", F.explode("metrics").alias("variable", "valor"))


def metric_catalog(spark: SparkSession, specs: Sequence[Metric]) -> DataFrame:
    """The catalog published next to the wide table, in declaration order (``posicion``).

    Context variables carry their year in place of a source table.
    """
    if specs and all(isinstance(spec, ContextVariable) for spec in specs):
        rows = [(s.variable, s.anio, s.categoria, s.label, s.unidad, i) for i, s in enumerate(specs)]
        schema = "variable_id string, anio int, categoria_id string, label string, unidad string, posicion int"
    else:
        rows = [(s.variable, s.categoria, s.label, s.unidad, s.source_table, i) for i, s in enumerate(specs)]
        schema = CATALOG_SCHEMA + ", posicion int"
    return spark.createDataFrame(rows, schema)


def by_entity(df: DataFrame) -> DataFrame:
    """Entity order for publishing; a range sort, used at sinks only."""
    return df.orderBy("cve_ent")
