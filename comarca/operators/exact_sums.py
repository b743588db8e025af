"""Exact weighted totals as mergeable partial sums.

A partial sum is one row per key and bucket of weights, with the limbs of every total as longs (see
`functions.exact`). Partial sums of any parts of a table add up to those of the whole, without error and
in any order, so they can be combined map-side, stored, and added to later.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions import exact

BUCKET = "_bucket"


def limb_columns(names: Sequence[str]) -> list[str]:
    return [f"{name}_{k}" for name in names for k in range(exact.LIMBS)]


def partial_sums(
    rows: DataFrame, keys: Sequence[str], weight: str, parts: Mapping[str, str], times: bool = False
) -> DataFrame:
    """Keys, bucket and limbs of the total of ``weight`` for each of ``parts``: name -> SQL condition, or with
    ``times`` how often the row counts. One shuffle of at most a few rows a key and map task."""
    limbs = [f"_limb{k}" for k in range(exact.LIMBS)]
    split = rows.where(F.col(weight).isNotNull()).withColumn(BUCKET, exact.bucket(F.col(weight)))
    split = split.select("*", *[c.alias(n) for c, n in zip(exact.limbs(F.col(weight), F.col(BUCKET)), limbs, strict=True)])
    sums = []
    for name, sql in parts.items():
        for k, limb in enumerate(limbs):
            value = f"{limb} * cast({sql} as bigint)" if times else f"case when {sql} then {limb} else 0L end"
            sums.append(F.expr(f"sum({value}) as `{name}_{k}`"))
    return split.groupBy(*keys, BUCKET).agg(*sums)


def merged(partials: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Partial sums of parts, or of finer keys, added up."""
    return partials.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(c) for c in limb_columns(names)])


def totals(partials: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key with every total as the double nearest to the true sum.

    What is gathered per key is one row a bucket, a few for weights of like size and 256 at most."""
    sums = F.array(*[F.array(*[F.col(f"`{name}_{k}`") for k in range(exact.LIMBS)]) for name in names])
    buckets = partials.groupBy(*keys).agg(F.collect_list(F.struct(BUCKET, sums.alias("_limbs"))).alias("_buckets"))
    # One row per total, so that the plan holds the rounding once, however many totals there are.
    each = buckets.select(*keys, "_buckets", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_place"))

    def of_bucket(row: Column) -> Column:
        limbs = F.get(row["_limbs"], F.col("_place"))
        return exact.terms(row[BUCKET], [F.get(limbs, F.lit(k)) for k in range(exact.LIMBS)])

    each = each.select(*keys, "_place", exact.exact_total(F.flatten(F.transform("_buckets", of_bucket))).alias("_total_of"))
    back = [F.expr(f"max(case when _place = {k} then _total_of end) as `{name}`") for k, name in enumerate(names)]
    return each.groupBy(*keys).agg(*back)
