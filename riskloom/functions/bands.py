"""Fixed bands and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import names as N
from .text import _c


def banded(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge the value lies below; everything else, NULL too, gets the last."""
    v = _c(value)
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(v < edge, label).otherwise(out)
    return out


def rank_in(value: Column | str, labels: Sequence[str], start: int = 1, rest: int = 99) -> Column:
    """Display order of a label: its place in ``labels``, ``rest`` for any other."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), _c(value))
    return F.when(place > 0, place + (start - 1)).otherwise(rest).cast("int")


def profit_band(value: Column | str = N.EXPECTED_PROFIT, labels: Sequence[str] = N.PROFIT_BANDS_DASH) -> Column:
    return banded(value, N.PROFIT_BAND_EDGES, labels)


def risk_band(value: Column | str = N.RISK) -> Column:
    return banded(value, N.RISK_BAND_EDGES, N.RISK_BANDS)


def risk_band_order(band: Column | str) -> Column:
    """High first; anything unexpected sorts with the low band."""
    return rank_in(band, ("High Risk", "Medium Risk"), rest=3)


def upper_tier(value: Column | str, low: Column | float, high: Column | float, labels: Sequence[str]) -> Column:
    """Three tiers from the top down: ``>= high``, ``>= low``, rest (NULL included)."""
    v = _c(value)
    top, middle, rest = labels
    return F.when(v >= high, top).when(v >= low, middle).otherwise(rest)


CALIBRATION_LABELS = ["(-0.001, 0.1]"] + [f"({k / 10}, {(k + 1) / 10}]" for k in range(1, 10)]


def calibration_bin(value: Column | str) -> Column:
    """Ten right-closed probability bins, 1 to 10; 0 belongs to the first.

    Counts the edges below the value instead of scaling it, so that 0.3 and its
    floating-point neighbours land on the right side of the edge.
    """
    v = _c(value)
    above = F.lit(1)
    for k in range(1, 10):
        above = above + (v > k / 10).cast("int")
    return above


def calibration_label(bin_number: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CALIBRATION_LABELS]), _c(bin_number))
