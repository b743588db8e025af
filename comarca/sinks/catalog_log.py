"""The variable catalog as a log of additions: each synchronisation appends what it adds, nothing is rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.sinks.publish import write_json
from comarca.sinks.versions import Conflict, Versions
from comarca.sources.documents import CATEGORY_FIELDS, VARIABLE_FIELDS

#: Additions to categories and variables, given those that the catalog has.
Additions = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
_PLACE = "posicion bigint"


def _tables(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    found = []
    for kind, fields in (("categories", CATEGORY_FIELDS), ("variables", VARIABLE_FIELDS)):
        schema = f"{fields}, {_PLACE}"
        paths = [f"{folder}/{kind}" for folder in folders]
        found.append(spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema))
    return found[0], found[1]


def read_catalog_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, str | None]:
    """Categories and variables with their places, and when the catalog was last changed."""
    content = Versions(spark, folder).read()
    return *_tables(spark, content.get("folders", [])), content.get("updated_at")


def append_catalog(spark: SparkSession, folder: str, additions: Additions, updated_at: str, tries: int = 20) -> int:
    """Appends what ``additions`` finds missing and sets the date; the number of the version that is current then.

    Where another writer was faster the additions are found anew against what it has added: no row is lost, none
    is there twice. Places go on from those that exist. Nothing is written, and the date stays, if nothing is missing."""
    versions = Versions(spark, folder)
    for _ in range(tries):
        number = versions.number()
        content = versions.read(number)
        folders = content.get("folders", [])
        existing = _tables(spark, folders)
        added = additions(*existing)
        target = versions.new_folder("added")
        for kind, had, new in zip(("categories", "variables"), existing, added, strict=True):
            end = had.agg(F.coalesce(F.max("posicion") + 1, F.lit(0)).alias("n")).scalar()
            write_json(new.withColumn("posicion", F.col("posicion") + end), f"{target}/{kind}")
        if all(table.isEmpty() for table in _tables(spark, [target])):
            return number
        try:
            return versions.commit({"folders": [*folders, target], "updated_at": updated_at}, number)
        except Conflict:
            continue
    raise Conflict(f"{tries} versions of {folder} came in between")
