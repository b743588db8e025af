"""Exact sums of doubles: whole-number parts that add up in any order, and one rounding at the end.

A double is a whole number of units of a power of two. Doubles of about the same size share a bucket with
one unit, in which each is a number of at most 62 bits. That number is taken apart into limbs of 21 bits, which
are added as longs: up to 2**42 rows without overflow, in any order and in any grouping, without error.
The sums of a few buckets become one double again by adding them without error (as a list of doubles
that don't overlap) and rounding once: the double nearest to the true sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two that share a bucket, bits of a limb, limbs of a number.
BUCKET = 8
LIMB_BITS = 21
LIMBS = 3
#: Bits of a double behind its first one, and one more for logarithms that fall on the wrong side.
_BEHIND = 53


def _scaled(value: Column, power: Column) -> Column:
    """value * 2**power, in two steps so that neither factor leaves the range of doubles."""
    half = F.floor(power / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def bucket(value: Column) -> Column:
    """The bucket of a finite double; an error for others."""
    size = F.abs(value)
    number = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log2(size) / BUCKET))
    wrong = F.raise_error(F.concat(F.lit("not a finite number: "), value.cast("string"))).cast("int")
    return F.when(value.isNull() | (size < float("inf")), number.cast("int")).otherwise(wrong)


def limbs(value: Column, of: Column) -> list[Column]:
    """The limbs of a double in the bucket `of`, lowest first; the highest has the sign."""
    whole = _scaled(value, F.lit(_BEHIND) - of * BUCKET).cast("long")
    low = [F.shiftright(whole, LIMB_BITS * k).bitwiseAND(F.lit((1 << LIMB_BITS) - 1)) for k in range(LIMBS - 1)]
    return [*low, F.shiftright(whole, LIMB_BITS * (LIMBS - 1))]


def terms(of: Column, sums: Sequence[Column]) -> Column:
    """An array of doubles whose true sum is that of the limbs: each sum as two halves that doubles hold."""
    unit = of * BUCKET - _BEHIND
    halves = []
    for k, total in enumerate(sums):
        halves.append(_scaled(total.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), unit + LIMB_BITS * k))
        halves.append(_scaled(F.shiftright(total, 32).cast("double"), unit + LIMB_BITS * k + 32))
    return F.array(*halves)


def _added(a: Column, b: Column) -> tuple[Column, Column]:
    """The sum of two doubles and its error (Knuth's two-sum)."""
    total = a + b
    of_b = total - a
    return total, (a - (total - of_b)) + (b - of_b)


def exact_total(values: Column) -> Column:
    """The double nearest to the true sum of an array of doubles, ties to even (Shewchuk's expansions).

    The expansion so far is a list of doubles, smallest first, none of which overlaps another. A new number
    goes through it from the smallest on; errors stay behind, what is left is its last entry."""
    none = F.array().cast("array<double>")

    def through(state: Column, part: Column) -> Column:
        total, error = _added(state["carried"], part)
        left = F.when(error != 0, F.concat(state["left"], F.array(error))).otherwise(state["left"])
        return F.struct(total.alias("carried"), left.alias("left"))

    def insert(expansion: Column, value: Column) -> Column:
        start = F.struct(value.alias("carried"), none.alias("left"))
        return F.aggregate(expansion, start, through, lambda s: F.concat(s["left"], F.array(s["carried"])))

    # Round from the largest down. Once something is left over, the next entry tells whether a tie was one.
    def rounded(state: Column, part: Column) -> Column:
        total, error = _added(state["high"], part)
        twice = state["low"] * 2.0
        nudged = state["high"] + twice
        tie = (F.signum(part) == F.signum(state["low"])) & (nudged - state["high"] == twice)
        return F.when(
            state["low"] == 0, F.struct(total.alias("high"), error.alias("low"), F.lit(False).alias("done"))
        ).when(
            ~state["done"], F.struct(F.when(tie, nudged).otherwise(state["high"]).alias("high"), state["low"].alias("low"), F.lit(True).alias("done"))
        ).otherwise(state)

    expansion = F.reverse(F.aggregate(values, none, insert))
    zero = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"), F.lit(False).alias("done"))
    return F.aggregate(expansion, zero, rounded, lambda s: s["high"])
