"""Weighted totals that grow by batches: stored partial sums, to which new persons are added without the old ones.

Each batch leaves its partial sums (per year, unit and bucket of weights, see `exact_sums`) in a folder of its own
and its id in the log of versions. An id that is already there adds nothing, so a batch may be sent again after any
failure. Sums are exact, so totals don't depend on how persons were dealt into batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.operators import estimators, exact_sums
from comarca.sinks.versions import Versions
from comarca.specs import Share

KEYS = ["_year", "_key"]


class RunningTotals:
    """The totals of ``specs`` in a folder; all batches have the same specs."""

    def __init__(self, spark: SparkSession, folder: str, specs: Sequence[Share]) -> None:
        self.spark, self.specs = spark, list(specs)
        self.parts = estimators.answer_parts(self.specs)
        self.versions = Versions(spark, folder)
        declared = [(s.variable, s.column, s.positive_values) for s in self.specs]
        self.declared = hashlib.sha256(repr(declared).encode()).hexdigest()

    def _content(self, content: dict) -> dict:
        if content and content["declared"] != self.declared:
            raise ValueError("the folder holds totals of other metrics")
        return content or {"declared": self.declared, "batches": {}, "folders": []}

    def batches(self) -> list[str]:
        return sorted(self._content(self.versions.read())["batches"])

    def add(self, batch: str, persons: DataFrame, key: str, weight: str, year: str) -> bool:
        """Adds the persons of a batch; False if a batch of that id is in the totals already.

        Only ``persons`` are read. ``key``, ``weight`` and ``year`` are columns of theirs."""
        if batch in self._content(self.versions.read())["batches"]:
            return False
        kept = estimators.weighed_answers(persons, self.specs, key, weight, carried=[F.col(year).cast("string").alias("_year")])
        folder = self.versions.new_folder("batch")
        exact_sums.partial_sums(kept.withColumn("_key", F.col("_key").cast("string")), KEYS, "_weight", self.parts).write.parquet(folder)
        added = False

        def with_batch(content: dict) -> dict | None:
            nonlocal added
            content = self._content(content)
            added = batch not in content["batches"]
            if not added:
                return None
            return {**content, "batches": {**content["batches"], batch: len(content["batches"])}, "folders": [*content["folders"], folder]}

        self.versions.change(with_batch)
        return added

    def _partials(self, folders: Sequence[str]) -> DataFrame:
        names = exact_sums.limb_columns(list(self.parts))
        schema = ", ".join(["_year string", "_key string", f"{exact_sums.BUCKET} int", *(f"`{n}` bigint" for n in names)])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def compact(self) -> None:
        """Puts one folder in place of those of all batches so far; batches that come meanwhile keep theirs."""
        seen = self._content(self.versions.read())["folders"]
        if len(seen) < 2:
            return
        folder = self.versions.new_folder("all")
        exact_sums.merged(self._partials(seen), KEYS, list(self.parts)).write.parquet(folder)

        def with_one(content: dict) -> dict | None:
            content = self._content(content)
            if not set(seen) <= set(content["folders"]):
                return None  # somebody else was first
            return {**content, "folders": [folder, *(f for f in content["folders"] if f not in seen)]}

        self.versions.change(with_one)

    def shares(self, year: str | int, entity_of: DataFrame | None = None) -> DataFrame:
        """Shares of a year as `estimators.weighted_shares` gives them for the persons of all batches."""
        partials = self._partials(self._content(self.versions.read())["folders"]).where(F.col("_year") == str(year))
        if entity_of is None:
            partials = partials.withColumn("cve_ent", F.col("_key"))
        else:
            units = entity_of.select(F.col("unit").cast("string").alias("_unit"), "cve_ent")
            partials = exact_sums.merged(partials, ["_key"], list(self.parts)).join(units, F.col("_key") == F.col("_unit"))
        sums = exact_sums.merged(partials, ["cve_ent"], list(self.parts))
        return estimators.shares_of_totals(exact_sums.totals(sums, ["cve_ent"], list(self.parts)), self.specs)
