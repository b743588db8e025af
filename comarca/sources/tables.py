"""Delimited sources. Schemas are declared; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

UTF8 = "UTF-8"
LATIN1 = "ISO-8859-1"
QUOTES = {"quote": '"', "escape": '"'}


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    encoding: str = UTF8,
    types: dict[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV with a header row, every column text unless ``types`` says otherwise.

    Without ``columns`` the header of the file names them; with ``columns`` the result keeps
    only those, and a listed column the file lacks is left out. A byte order mark before the
    first header name is dropped. Codes keep their leading zeros because they stay text.
    ``multi_line`` takes quoted line breaks; each file is then read by one task.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).options(**QUOTES).option("multiLine", multi_line)
    names = reader.csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in names])
    table = reader.schema(schema).option("enforceSchema", False).csv(path)
    kept = [name for name in names if columns is None or name in set(columns)]
    return _typed(table, kept, types or {})


def parsed_lines(lines: DataFrame, column: str, names: Sequence[str], kept: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Delimited records held in a text column, as `read_delimited` gives those of a file."""
    schema = ", ".join(f"`{name}` string" for name in names)
    return _typed(lines.select(F.from_csv(column, schema, QUOTES).alias("r")).select("r.*"), kept, types)


def _typed(table: DataFrame, kept: Sequence[str], types: dict[str, str]) -> DataFrame:
    return table.select(*[F.col(name).cast(types[name]).alias(name) if name in types else F.col(name) for name in kept])


def read_microdata(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Survey persons: UTF-8, possibly with a byte order mark."""
    return read_delimited(spark, path, columns, UTF8)


def read_latin1(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Locality, connectivity and published-value tables."""
    return read_delimited(spark, path, columns, LATIN1)


def read_census(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Census rows: geographic levels and total population are integers, other counts may be marks."""
    integers = ("ENTIDAD", "MUN", "LOC", "POBTOT")
    counts = ("POB15_64", "PEA", "PDER_IMSS", "VIVTOT")
    return read_delimited(
        spark, path, integers + counts, UTF8, {name: IntegerType().simpleString() for name in integers}
    )
