"""Number expressions: strict and lenient parsing, exact rounding, scaling, classification."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.text import is_blank, strip

#: 2**27 + 1 splits a double into two halves whose products are exact (Veltkamp, Dekker).
_SPLITTER = 134217729.0
#: From 2**52 up a double is a whole number: there is nothing to round.
_WHOLE = 2.0**52


def number_or_zero(text: Column, dtype: str = "double") -> Column:
    """Blank or missing is 0; text that is no number is an error under ANSI mode."""
    number = strip(text.cast("string"))
    number = exact_decimal(number, dtype) if dtype.startswith("decimal") else number.cast(dtype)
    return F.when(is_blank(text), F.lit(0).cast(dtype)).otherwise(number)


def number_or_null(value: Column) -> Column:
    """Text that is no number becomes null."""
    return strip(value.cast("string")).try_cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null when either side is missing or the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def _nearest(size: Column, digits: int, tie: Column) -> Column:
    """The decimal with ``digits`` decimals nearest to ``size`` (0 to 2**52), judged on its exact binary
    value.

    Whole part and fraction of a double are doubles without error, so only the fraction is
    scaled. Its product with 2 * 10**digits is formed without error as ``high + low``: a tie is a tie
    of the binary number, not of its shortest decimal text. ``tie`` is added to the lower
    neighbour in that case. Whole part and digits are put together as a decimal, which
    cannot overflow.
    """
    whole = F.floor(size)
    value = size - whole
    scale = F.lit(float(2 * 10**digits))
    high = value * scale
    spread = value * F.lit(_SPLITTER)
    head = spread - (spread - value)
    low = (head * scale - high) + (value - head) * scale
    half = high / F.lit(2.0)
    lower = F.floor(half)
    fraction = half - lower
    step = (
        F.when((fraction > 0.5) | ((fraction == 0.5) & (low > 0)), F.lit(1))
        .when((fraction < 0.5) | (low < 0), F.lit(0))
        .otherwise(tie(lower if digits else whole % 2 + lower))
    )
    places = (lower + step).cast("decimal(10,0)") * F.lit(Decimal(1).scaleb(-digits)).cast(f"decimal({digits + 1},{digits})")
    return (whole.cast("decimal(17,0)") + places).cast(f"decimal({18 + digits},{digits})")


def round_half_even(value: Column, digits: int) -> Column:
    """Round as IEEE doubles are usually rounded: exact ties go to the even neighbour."""
    size = F.abs(value)
    nearest = _nearest(size, digits, lambda lower: F.pmod(lower, F.lit(2))).cast("double")
    return F.when(size < _WHOLE, F.when(value < 0, F.lit(0.0) - nearest).otherwise(nearest)).otherwise(value)


def fixed_decimals(value: Column, digits: int = 1) -> Column:
    """Text with a fixed number of decimals: exact ties go away from zero, the sign is kept."""
    size = F.abs(value)
    nearest = _nearest(size, digits, lambda lower: F.lit(1)).cast("string")
    text = F.when(size < _WHOLE, nearest).otherwise(F.format_string(f"%.{digits}f", size))
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), text)


def exact_decimal(value: Column, dtype: str) -> Column:
    """A number as a decimal; an error where digits would be lost."""
    number = value.cast(dtype)
    lost = F.raise_error(F.concat(F.lit(f"not exact as {dtype}: "), value.cast("string"))).cast(dtype)
    return F.when(value.isNull() | (number.cast("double") == value.cast("double")), number).otherwise(lost)


def with_unit(value: Column, unit: Column | str, digits: int = 1) -> Column:
    """``fixed_decimals`` followed by the unit, if there is one."""
    unit = unit if isinstance(unit, Column) else F.lit(unit)
    suffix = F.when(F.coalesce(unit, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), unit))
    return F.concat(fixed_decimals(value, digits), suffix)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position of a value within a range; an empty range puts everything in the middle."""
    return F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(value - low, high - low))


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def technology(speed_mbps: Column) -> Column:
    """Network class of a download speed; a limit belongs to the class above it."""
    result = None
    for name, limit in fixed.TECHNOLOGY_LIMITS_MBPS:
        below = speed_mbps < limit
        result = F.when(below, name) if result is None else result.when(below, name)
    return result.otherwise(fixed.TECHNOLOGY_ABOVE)
