"""Aggregate expressions.

Sums of doubles depend on the order in which partitions arrive, so a retried task can
change the last digits of a report.  ``total`` and ``mean`` sum fixed-point integers
instead: the result is the same for every partitioning, and a row costs a
multiplication, a cast and two sums of longs inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import names as N
from .text import _c

MONEY_DIGITS, RATIO_DIGITS = 6, 12  # decimals kept of currency amounts, and of probabilities and margins
_HALF = 30  # bits of the lower half of a sum
_RATIOS = {N.RISK, N.MARGIN, "predicted_probability"}


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def digits_of(column: str) -> int:
    return RATIO_DIGITS if column in _RATIOS else MONEY_DIGITS


def total(value: Column | str, digits: int | None = None) -> Column:
    """Exact sum, as a double, of values taken to ``digits`` decimals.

    NULL and NaN do not take part.  Values too large for the fixed point, infinity among
    them, are summed as doubles beside it.
    """
    d = digits or (digits_of(value) if isinstance(value, str) else MONEY_DIGITS)
    known = _known(value)
    fits = F.abs(known) < 9.0e18 / 10.0**d
    units = F.rint(F.when(fits, known) * 10.0**d).cast("long")
    unit = F.lit(f"{10**-d:.{d}f}").cast(f"decimal({d},{d})")
    # Summed in two halves, which stay longs up to 2^93 units in all, and put together once for each group.
    high = F.sum(F.shiftright(units, _HALF)).cast("decimal(19,0)") * F.lit(1 << _HALF).cast("decimal(10,0)")
    whole = high + F.sum(units.bitwiseAND(F.lit((1 << _HALF) - 1).cast("long"))).cast("decimal(19,0)")
    # 37 digits in all, so that the product keeps its full scale.
    exact = (whole.cast(f"decimal({37 - d},0)") * unit).cast("double")
    large = F.sum(F.when(~fits, known))
    return F.when(large.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + large)


def mean(value: Column | str, digits: int | None = None) -> Column:
    """Exact sum over the number of known values."""
    return F.try_divide(total(value, digits), F.count(_known(value)))


def _known(value: Column | str) -> Column:
    v = _c(value).cast("double")
    return F.when(~F.isnan(v), v)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def share_where(condition: Column) -> Column:
    """Share of rows for which the condition holds."""
    return ratio(F.count_if(condition), F.count(F.lit(1)))
