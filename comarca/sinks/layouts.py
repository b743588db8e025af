"""How tables are laid out where they are read often: tiles along a space-filling curve, facts by year and bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions.text import strip
from comarca.operators.coverage import BOX_COLUMNS

#: Bits of a place along each axis; 2**20 steps around the globe are about 40 metres.
CURVE_BITS = 20


def _apart(value: Column) -> Column:
    """The bits of a whole number with a zero between each two, by halving the distance that groups of bits move."""
    width = 16
    while width:
        mask = sum(1 << bit for bit in range(2 * CURVE_BITS) if bit // width % 2 == 0)
        value = value.bitwiseOR(F.shiftleft(value, width)).bitwiseAND(F.lit(mask))
        width //= 2
    return value


def curve_key(longitude: Column, latitude: Column) -> Column:
    """Place on a Z curve: points near each other on the globe mostly have keys near each other."""
    steps = 1 << CURVE_BITS

    def step(value: Column, low: float, span: float) -> Column:
        place = F.floor((value - low) / span * steps).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(steps - 1).cast("long"), place))

    return _apart(step(longitude, -180.0, 360.0)).bitwiseOR(F.shiftleft(_apart(step(latitude, -90.0, 180.0)), 1))


def write_clustered_tiles(tiles: DataFrame, path: str, row_group_bytes: int = 16 << 20) -> None:
    """Tiles with stored boxes (``x_min, y_min, x_max, y_max``) in the order of the curve.

    Files and row groups then hold tiles of one region each, so their minima and maxima tell a box filter which to
    skip. The ranges are sampled, so a region with a third of all tiles becomes many files."""
    west, south, east, north = (F.col(name) for name in BOX_COLUMNS)
    keyed = tiles.withColumn("_curve", curve_key((west + east) / 2, (south + north) / 2))
    ordered = keyed.repartitionByRange("_curve", *BOX_COLUMNS).sortWithinPartitions("_curve").drop("_curve")
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def _save(table: DataFrame, name: str, path: str, buckets: int, by_year: str | None = None) -> DataFrame:
    writer = table.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "cvegeo").sortBy("cvegeo")
    (writer.partitionBy(by_year) if by_year else writer).saveAsTable(name)
    return table.sparkSession.table(name)


def store_connectivity(facts: DataFrame, name: str, path: str, buckets: int, key: str = "CVEGEO", year: str = "ANIO") -> DataFrame:
    """Connectivity facts under clean codes (``cvegeo``), a folder a year, dealt into buckets by code.

    The year is stored as a whole number; text that is none is an error under ANSI mode."""
    clean = F.coalesce(strip(F.col(key).cast("string")), F.lit("")).alias("cvegeo")
    number = strip(F.col(year).cast("string")).cast("int").alias("anio")
    others = [F.col(c) for c in facts.columns if c not in (key, year)]
    # Dealt like the buckets, so each bucket of a year is one file, however many tasks read the facts.
    return _save(facts.select(clean, *others, number).repartition(buckets, "cvegeo"), name, path, buckets, "anio")


def store_localities(localities: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """One row per locality (`estimators.latest_localities`) in the same buckets as the facts."""
    return _save(localities.repartition(buckets, "cvegeo"), name, path, buckets)
