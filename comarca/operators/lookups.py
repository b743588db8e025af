"""Lookups: entity master by code or by any of its names, and left merges on entity code.

No join carries a broadcast hint. The lookup tables are small when they describe states, but
nothing proves it, so Spark decides from file sizes and AQE from measured shuffle sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions.text import fold


def last_by_key(rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """One row per key, the last in order; combines map-side, so repeated keys are no hot spot."""
    rest = [F.col(name) for name in rows.columns if name not in (key, order_by)]
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(order_by), *rest)).alias("_row"))
    return last.select(key, "_row.*")


def entity_names(master: DataFrame) -> DataFrame:
    """Folded name or alias -> entity code; a name two entities share belongs to the later one."""
    names = F.concat(F.array("estado"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    listed = master.select("cve_ent", F.explode(names).alias("_name"))
    return listed.groupBy(fold(F.col("_name")).alias("nombre")).agg(F.max("cve_ent").alias("cve_ent"))


def with_entity_code(rows: DataFrame, master: DataFrame, name: str) -> DataFrame:
    """Add ``cve_ent`` by folded name; unknown names get null."""
    names = entity_names(master)
    keyed = rows.withColumn("_folded", fold(F.col(name)))
    return keyed.join(names, keyed["_folded"] == names["nombre"], "left").drop("_folded", "nombre")


def left_merge(first: DataFrame, others: Sequence[DataFrame], key: str = "cve_ent") -> DataFrame:
    return reduce(lambda left, right: left.join(right, key, "left"), others, first)


def population_density(population: DataFrame, areas: DataFrame, people: Column, km2: Column) -> DataFrame:
    """Inhabitants per square kilometre of the entities both tables know."""
    joined = population.join(areas, "cve_ent", "inner")
    return joined.select(
        "cve_ent", F.try_divide(people.cast("double"), km2.cast("double")).alias("densidad_poblacional")
    )
