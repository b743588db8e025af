"""The tables that the queries of this package read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def apart(df: DataFrame, own: Sequence[str], dropped: Sequence[str] = ()) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with its columns `own` and all others in one struct, and each column as it is found there. Whatever the
    others are called, they can't clash with names that an operator uses. Columns named in `dropped` go."""
    others = [c for c in df.columns if c not in own and c not in dropped]
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others")] if others else []
    at = {c: F.col(f"`{c}`") if c in own else F.col(f"_others.`{c}`").alias(c) for c in df.columns if c not in dropped}
    return df.select(*own, *packed), at
