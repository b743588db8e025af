"""Dashboard analytics over wide records: selection, averages, rankings, gaps, scaling, score.

Records hold either a ``metrics`` map or one column per metric; every function takes both.
A missing metric counts as 0 here, and only here: stored tables keep it missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.numeric import clamp_percent, min_max


def metric(records: DataFrame, name: str) -> Column:
    """A metric as stored, null where an entity lacks it."""
    if name in records.columns:
        return F.col(name).cast("double")
    if "metrics" in records.columns:
        return F.try_element_at("metrics", F.lit(name))
    return F.lit(None).cast("double")


def metric_or_zero(records: DataFrame, name: str) -> Column:
    return F.coalesce(metric(records, name), F.lit(0.0))


def select_entities(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records of the named entities; no names, no records."""
    return records.where(F.col("estado").isin(*names)) if names else records.where(F.lit(False))


# --- aggregates, to be combined in one ``agg`` ------------------------------------------


def average(value: Column) -> Column:
    """Mean with missing values as 0 in the sum and present in the count; 0 without rows."""
    return F.coalesce(F.try_divide(F.sum(F.coalesce(value, F.lit(0.0))), F.count(F.lit(1))), F.lit(0.0))


def strict_average(value: Column) -> Column:
    """Mean that is missing as soon as one value is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def top(value: Column, wanted: Column | str = "estado") -> Column:
    """Of the record with the highest value; of equals the one with the lowest entity code."""
    return F.min_by(wanted, F.struct((-F.coalesce(value, F.lit(0.0))).alias("v"), F.col("cve_ent").alias("k")))


def bottom(value: Column, wanted: Column | str = "estado") -> Column:
    """Of the record with the lowest value; of equals the one with the lowest entity code."""
    return F.min_by(wanted, F.struct(F.coalesce(value, F.lit(0.0)).alias("v"), F.col("cve_ent").alias("k")))


def last_ranked(value: Column, wanted: Column | str = "estado") -> Column:
    """Last of the descending ranking: of equals the one with the highest entity code."""
    return F.max_by(wanted, F.struct((-F.coalesce(value, F.lit(0.0))).alias("v"), F.col("cve_ent").alias("k")))


def value_range(value: Column) -> Column:
    zeroed = F.coalesce(value, F.lit(0.0))
    return F.struct(F.min(zeroed).alias("lo"), F.max(zeroed).alias("hi"))


# --- tables -----------------------------------------------------------------------------


def ranking(records: DataFrame, name: str) -> DataFrame:
    """Entities by a metric, highest first; a range sort."""
    shown = records.select("cve_ent", "estado", metric_or_zero(records, name).alias("valor"))
    return shown.orderBy(F.desc("valor"), "cve_ent")


def paired_ranking(records: DataFrame, left: str, right: str) -> DataFrame:
    """Two metrics side by side, highest right one first; raw values and their 0..100 positions."""
    shown = records.select(
        "cve_ent", "estado", metric_or_zero(records, left).alias("left"), metric_or_zero(records, right).alias("right")
    )
    placed = shown.withColumn("left_position", clamp_percent(F.col("left"))).withColumn(
        "right_position", clamp_percent(F.col("right"))
    )
    return placed.orderBy(F.desc("right"), "cve_ent")


def scatter(records: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Point per entity; ``z`` is the size and may be left out."""
    size = [metric_or_zero(records, z).alias("z")] if z else []
    return records.select(
        "cve_ent", "estado", metric_or_zero(records, x).alias("x"), metric_or_zero(records, y).alias("y"), *size
    )


def with_gaps(records: DataFrame) -> DataFrame:
    """Add the gaps between the covered population and the covered localities, in points."""
    gaps = {
        name: metric_or_zero(records, covered) - metric_or_zero(records, base)
        for name, _, _, _, _, base, covered in fixed.GAP_METRICS
    }
    return _with_metrics(records, gaps)


def _with_metrics(records: DataFrame, new: dict[str, Column]) -> DataFrame:
    if "metrics" not in records.columns:
        return records.withColumns(new)
    pairs = [item for name, value in new.items() for item in (F.lit(name), value)]
    kept = F.map_filter("metrics", lambda key, _: ~key.isin(*new))
    return records.withColumn("metrics", F.map_concat(kept, F.create_map(*pairs)))


def ranges(records: DataFrame, names: Sequence[str]) -> Column:
    """Ranges of several metrics as one scalar subquery: a single row, computed once."""
    return records.agg(F.struct(*[value_range(metric(records, name)).alias(name) for name in names]).alias("r")).scalar()


def normalised(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each metric as a position within its range over the given records."""
    spans = records.withColumn("_r", ranges(records, names))
    return spans.select(
        "cve_ent", "estado",
        *[
            min_max(metric_or_zero(records, name), F.col(f"_r.{name}.lo"), F.col(f"_r.{name}.hi")).alias(name)
            for name in names
        ],
    )


def opportunity(records: DataFrame) -> DataFrame:
    """Market attractiveness, whitespace and opportunity score (0..100) of the given records.

    The ranges are over these records, so entities are selected before. The score also joins
    the metrics.
    """
    names = [name for name, _ in fixed.MARKET_WEIGHTS + fixed.WHITESPACE_WEIGHTS]
    spans = records.withColumn("_r", ranges(records, names))

    def scaled(name: str) -> Column:
        return min_max(metric_or_zero(records, name), F.col(f"_r.{name}.lo"), F.col(f"_r.{name}.hi"))

    market = reduce(add, [scaled(name) * weight for name, weight in fixed.MARKET_WEIGHTS])
    whitespace = reduce(add, [(1 - scaled(name)) * weight for name, weight in fixed.WHITESPACE_WEIGHTS])
    parts = spans.withColumns({"_market": market, "_whitespace": whitespace})
    score = (F.col("_market") * fixed.MARKET_SHARE_OF_SCORE + F.col("_whitespace") * fixed.WHITESPACE_SHARE_OF_SCORE) * 100
    scored = parts.withColumns(
        {"opportunityScore": score, "marketAttractiveness": F.col("_market") * 100, "whitespaceScore": F.col("_whitespace") * 100}
    ).drop("_r", "_market", "_whitespace")
    if "metrics" in records.columns:
        return _with_metrics(scored, {"opportunityScore": F.col("opportunityScore")})
    return scored


def unpivoted(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per entity and listed metric, missing values kept."""
    return records.select(
        "cve_ent", "estado",
        F.posexplode(
            F.array(*[F.struct(F.lit(name).alias("id"), metric(records, name).alias("valor")) for name in names])
        ).alias("posicion", "m"),
    ).select("cve_ent", "estado", "posicion", "m.*")


def heatmap(records: DataFrame, metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entity by metric: value and its intensity within the metric's range.

    Metrics the catalog lacks are left out; the list order is in ``posicion``.
    """
    listed = list(dict.fromkeys(names))
    spans = records.withColumn("_r", ranges(records, listed))
    rows = spans.select(
        "cve_ent", "estado",
        F.posexplode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("id"),
                        metric_or_zero(records, name).alias("valor"),
                        min_max(metric_or_zero(records, name), F.col(f"_r.{name}.lo"), F.col(f"_r.{name}.hi")).alias("intensidad"),
                    )
                    for name in listed
                ]
            )
        ).alias("posicion", "m"),
    ).select("cve_ent", "estado", "posicion", "m.*")
    return rows.join(metrics.select("id", "label", "unit"), "id", "inner")


def radar(records: DataFrame, metrics: DataFrame, names: Sequence[str], entities: Sequence[str]) -> DataFrame:
    """Metric by entity: one column per named entity, missing values stay missing."""
    rows = unpivoted(records.where(F.col("estado").isin(*entities)), names)
    turned = rows.groupBy("posicion", "id").pivot("estado", list(entities)).agg(F.max("valor"))
    labels = metrics.select(F.col("id").alias("_id"), "label")
    return turned.join(labels, F.col("id") == F.col("_id"), "left").select(
        "posicion", F.coalesce("label", "id").alias("metric"), *[F.col(f"`{name}`") for name in entities]
    )


# --- which metric goes with which -------------------------------------------------------


def population_pair(name: str) -> tuple[str, str]:
    """Base metric and its label for a population metric; unknown ones get the default."""
    pairs = {key: (base, label) for key, base, label in fixed.POPULATION_PAIRS}
    return pairs.get(name, fixed.POPULATION_PAIRS[-1][1:])


def adoption_pair(name: str) -> tuple[str, str]:
    """Coverage metric and its label for an adoption metric; unknown ones get the default."""
    pairs = {key: (coverage, label) for key, coverage, label in fixed.ADOPTION_PAIRS}
    return pairs.get(name, fixed.ADOPTION_PAIRS[-1][1:])


def gap_pair(name: str) -> tuple[str, str, str, str]:
    """Base and covered metric of a gap, with their labels."""
    labels = {row[0]: row[2] for row in fixed.LOCALITY_SHARES}
    gaps = {row[0]: (row[5], row[6]) for row in fixed.GAP_METRICS}
    base, covered = gaps.get(name, gaps[fixed.DEFAULT_GAP_METRIC])
    return base, covered, labels[base], labels[covered]


def pair_lookup(ids: DataFrame, pairs: Sequence[tuple[str, ...]], column: str = "id") -> DataFrame:
    """Pair table joined to any list of metric ids, unknown ids getting the default pair."""
    default = pairs[-1]
    table = ids.sparkSession.createDataFrame(list(pairs), "_id string, _metric string, _label string")
    return ids.join(table, F.col(column) == F.col("_id"), "left").select(
        *ids.columns,
        F.coalesce("_metric", F.lit(default[1])).alias("paired_metric"),
        F.coalesce("_label", F.lit(default[2])).alias("paired_label"),
    )
