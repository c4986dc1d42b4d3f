"""Numeric column helpers with explicit null, zero and rounding behaviour."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000
#: Decimals of an amount that count in a sum; with them a decimal(38) holds amounts up to 10^28.
AMOUNT_SCALE = 10


def clamp(x: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (greatest/least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), x))


def at_most(x: Column, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), x))


def ratio(numerator: Column, denominator: Column, otherwise: Column | None = None) -> Column:
    """numerator / denominator, or `otherwise` (default null) when the denominator is zero or null."""
    fallback = F.lit(None).cast("double") if otherwise is None else otherwise
    return F.when(denominator != 0, numerator / denominator).otherwise(fallback)


def truncated(x: Column) -> Column:
    """Whole part toward zero, as bigint."""
    return x.cast("bigint")


def nearest_even(x: Column) -> Column:
    """Nearest whole number, halves to even, as bigint."""
    return F.rint(x).cast("bigint")


def rounded(x: Column, places: int) -> Column:
    """Round on the exact binary value, halves to even: 2.675 is 2.67 and 0.125 is 0.12.

    The built-in rounding goes by decimal digits and differs only where those end in a half; just
    these values take the slower path through a written number.
    """
    shifted = x * F.lit(float(10 ** (places + 1)))
    nearest = F.rint(shifted)
    half = (F.abs(nearest) % 10 == 5) & (F.abs(shifted - nearest) < 1e-3)
    written = F.replace(F.format_number(x, places), F.lit(","), F.lit("")).cast("double")
    return F.when(half, written).otherwise(F.round(x, places))


def band(x: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first cut with x >= cut; cuts run from high to low. Null takes `otherwise`."""
    label = None
    for cut, name in cuts:
        label = F.when(x >= cut, name) if label is None else label.when(x >= cut, name)
    return label.otherwise(otherwise)


def lookup(key: Column, table: Mapping[str, object], default: object | None = None) -> Column:
    """Constant-table lookup; a key outside the table gives `default` (null when none)."""
    found = None
    for name, value in table.items():
        found = F.when(key == name, F.lit(value)) if found is None else found.when(key == name, F.lit(value))
    if found is None:
        return F.lit(default)
    return found if default is None else found.otherwise(F.lit(default))


def money_sum(x: Column, scale: int | None = AMOUNT_SCALE) -> Column:
    """Sum of amounts that does not depend on summation order; all-null gives 0.

    Amounts are kept to `scale` decimals and added as decimals. `scale=None` adds plain doubles.
    """
    if scale is None:
        return F.coalesce(F.sum(x), F.lit(0.0))
    return F.coalesce(F.sum(x.cast(f"decimal(38,{scale})")).cast("double"), F.lit(0.0))


def money_mean(x: Column, scale: int | None = AMOUNT_SCALE) -> Column:
    """Mean over non-null amounts with the same order-independent sum; null when there are none."""
    if scale is None:
        return F.avg(x)
    total = F.sum(x.cast(f"decimal(38,{scale})")).cast("double")
    return F.when(F.count(x) > 0, total / F.count(x))


def exact_mean(x: Column) -> Column:
    """Mean taken in decimals: order does not matter and the mean of equal values is that value."""
    return F.avg(x.cast("decimal(38,18)")).cast("double")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days from `earlier` to `later`, rounded down (minus 12 hours is -1)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("int")
