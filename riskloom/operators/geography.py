"""Geographic serving summaries and their decision enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.aggregates import mean, total
from ..functions.bands import profit_band, rank_in, upper_tier
from ..functions.calendar import period_columns
from ..functions.text import country_label, label_or
from .decisions import lookup
from .ordering import exact_quantiles

LOCATION = [
    "map_location_label", "map_location_country", "map_location_region", "map_location_state",
    "map_latitude", "map_longitude", "geo_coordinates_available",
]


def location_columns(country: Column) -> dict[str, Column]:
    """Map labels and checked coordinates for one order destination."""
    region = label_or("order_region_normalized", "unknown_region")
    state = label_or("order_state_normalized", "unknown_state")
    lat, lon = F.col("latitude_rounded").cast("double"), F.col("longitude_rounded").cast("double")
    on_map = (F.col("geo_coordinates_available") == 1) & lat.between(-90, 90) & lon.between(-180, 180)
    return {
        "map_location_label": F.concat_ws(", ", state, region, country),
        "map_location_country": country,
        "map_location_region": region,
        "map_location_state": state,
        "map_latitude": lat,
        "map_longitude": lon,
        "geo_coordinates_available": F.coalesce(on_map.cast("int"), F.lit(0)),
    }


def country_token_label() -> Column:
    return label_or("order_country_normalized", "unknown_country")


def country_display_label(raw: str = "Order_Country") -> Column:
    """English label of the raw country, or of its token when the raw text is blank."""
    shown = F.when(F.trim(F.col(raw)) != "", F.col(raw)).otherwise(country_token_label())
    return country_label(shown)


def _score_aggregates() -> list[Column]:
    """Counts are items unless the name says otherwise: only ``order_count`` is distinct orders."""
    seg = F.col(N.SEGMENT)
    return [
        F.countDistinct(N.ORDER).alias("order_count"),
        F.count(F.lit(1)).alias("order_item_count"),
        F.count_if(F.col(N.HIGH_RISK)).alias("high_risk_order_count"),
        F.count_if(F.col(N.HIGH_MARGIN)).alias("high_margin_order_count"),
        *[mean(c).alias(f"avg_{c}") for c in (N.RISK, N.EXPECTED_PROFIT, N.MARGIN)],
        total(N.EXPECTED_PROFIT).alias("total_predicted_profit"),
        total(N.ORDER_VALUE).alias("total_order_value"),
        *[F.count_if(seg == s).alias(f"{s}_count") for s in (N.PROTECT, N.EXPEDITE, N.PRESERVE, N.STANDARD)],
        F.count_if(seg.isin(N.SCORE_REVIEW, N.MARGIN_REVIEW)).alias("requires_review_count"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    items = F.col("order_item_count")
    return df.withColumns(
        {f"high_{k}_order_rate": F.col(f"high_{k}_order_count") / items for k in ("risk", "margin")}
    )


def geographic_summary(df: DataFrame) -> DataFrame:
    """Scored order items per map location.

    ``df`` carries segments and regional features on one row (see ``enrich_left``
    when they are separate tables) and the raw ``Order_Country``.
    """
    placed = df.select(
        *[e.alias(n) for n, e in location_columns(country_display_label()).items()],
        *N.KEYS, N.RISK, N.HIGH_RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE, N.MARGIN, N.HIGH_MARGIN, N.SEGMENT,
    )
    span = [F.min(N.ORDER_TS).alias(f"min_{N.ORDER_TS}"), F.max(N.ORDER_TS).alias(f"max_{N.ORDER_TS}")]
    return _with_rates(placed.groupBy(*LOCATION).agg(*_score_aggregates(), *span))


def geographic_segment_summary(df: DataFrame) -> DataFrame:
    """Per location, day, segment, risk flag and profit band: the grain dashboard filters need."""
    placed = df.select(
        *[e.alias(n) for n, e in location_columns(country_token_label()).items()],
        F.col(N.ORDER_TS).cast("date").alias(N.ORDER_TS),
        F.col(N.HIGH_RISK).cast("boolean").alias(N.HIGH_RISK),
        profit_band().alias("ao2_expected_profit_band"),
        N.ORDER, N.RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE, N.MARGIN, N.HIGH_MARGIN, N.SEGMENT,
    )
    keys = [*LOCATION, N.ORDER_TS, N.SEGMENT, N.HIGH_RISK, "ao2_expected_profit_band"]
    grouped = placed.groupBy(*keys).agg(*_score_aggregates())
    # The periods follow from the day, so they need not be grouped by.
    periods, at = period_columns(), len(LOCATION) + 1
    dated = grouped.withColumns(periods).select(*keys[:at], *periods, *keys[at:], *[c for c in grouped.columns if c not in keys])
    return _with_rates(dated)


# --- decision enrichment ---------------------------------------------------
# FIXED VALUES: display labels and orders.
SEGMENT_LABELS = {
    N.PROTECT: "Protect High-Value at Risk", N.EXPEDITE: "Expedite Selectively",
    N.PRESERVE: "Preserve Service", N.STANDARD: "Standard Process",
    N.SCORE_REVIEW: "Requires Score Review", N.MARGIN_REVIEW: "Requires Margin Review",
}
MARGIN_TIERS = ("Loss or Negative Margin", "Low Positive Margin", "Core Positive Margin", "Strategic Positive Margin")
EXPOSURE_TIERS = ("High Exposure Geography", "Medium Exposure Geography", "Low Exposure Geography")
INTENSITY_TIERS = ("High Risk Intensity", "Moderate Risk Intensity", "Low Risk Intensity")
ARCHETYPES = {
    # archetype: (display order, recommended focus)
    "Priority Protection Geography": (1, "Protect Value at Risk"),
    "Selective Recovery Review": (2, "Review Selective Expedite"),
    "Preserve Service Geography": (3, "Preserve Service Quality"),
    "Standard Monitoring Geography": (4, "Standard Monitoring"),
    "Operational Monitoring Geography": (5, "Monitor Operational Exposure"),
    "Data Quality Review": (99, "Review Geography Data"),
}


def margin_tier(margin: Column | str, median: Column | float, upper: Column | float) -> Column:
    m = F.col(margin) if isinstance(margin, str) else margin
    loss, low, core, strategic = MARGIN_TIERS
    return F.when(m < 0, loss).when(m < median, low).when(m < upper, core).otherwise(strategic)


def tier_cutoffs(df: DataFrame, accuracy: int | None = None) -> dict[str, float]:
    """The six quantile cutoffs: the value at position ``ceil(p * n)`` of the known ones, whatever their number.

    With ``accuracy`` they come from one mergeable sketch instead, within ``1 / accuracy`` of the exact rank.  An
    empty input gives zeros.  Only these six numbers reach the driver.
    """
    margin = F.col("avg_ao3_predicted_margin")
    wanted = {
        "margin": (F.when(margin >= 0, margin), (0.50, 0.75)),
        "exposure": (F.col("total_order_value"), (0.25, 0.75)),
        "risk": (F.col("high_risk_order_rate"), (0.33, 0.67)),
    }
    ends = ("low", "high")
    if accuracy is not None:
        row = df.agg(*[F.percentile_approx(e, list(ps), accuracy).alias(n) for n, (e, ps) in wanted.items()]).first()
        return {f"{n}_{end}": float(row[n][i]) if row[n] else 0.0 for n in wanted for i, end in enumerate(ends)}
    named = [F.struct(F.lit(n).alias("name"), e.cast("double").alias("v")) for n, (e, _) in wanted.items()]
    found = exact_quantiles(df.select(F.inline(F.array(*named))), ["name"], "v",
                            sorted({p for _, ps in wanted.values() for p in ps}), discrete=True).collect()
    at = {(r["name"], r["probability"]): r["quantile"] for r in found}
    return {f"{n}_{end}": at.get((n, p), 0.0) for n, (_, ps) in wanted.items() for end, p in zip(ends, ps)}


def enrich_geography(df: DataFrame, cutoffs: dict[str, float] | None = None, accuracy: int | None = None) -> DataFrame:
    """Labels, tiers, quality status, archetype and focus for each summary row.

    Pass a stored summary, or ``cutoffs`` computed from one: the quantiles and the
    result both read ``df``.
    """
    q = cutoffs or tier_cutoffs(df, accuracy)
    seg, flag = F.col(N.SEGMENT), F.col(N.HIGH_RISK)
    unknown = F.lit(False)
    for part in ("country", "region", "state"):
        unknown = unknown | (F.col(f"map_location_{part}") == f"unknown_{part}")
    quality = (
        F.when(unknown, "Unknown Geography")
        .when(F.col("geo_coordinates_available") == 0, "Missing Coordinates")
        .otherwise("Complete Coordinates")
    )
    tiers = df.withColumns(
        {
            "ao3_priority_segment_label": lookup(seg, SEGMENT_LABELS, "Unknown Segment"),
            "ao3_priority_segment_sort_order": rank_in(seg, N.OPERATIONAL_SEGMENTS),
            "ao1_high_risk_label": F.when(flag, "High Delivery Risk").otherwise("Standard Delivery Risk"),
            "ao1_high_risk_sort_order": F.when(flag, 1).otherwise(2),
            "ao2_expected_profit_band_sort_order": rank_in("ao2_expected_profit_band", N.PROFIT_BANDS_DASH),
            "ao2_margin_policy_tier": margin_tier("avg_ao3_predicted_margin", q["margin_low"], q["margin_high"]),
            "geo_data_quality_status": quality,
            "geo_exposure_tier": upper_tier("total_order_value", q["exposure_low"], q["exposure_high"], EXPOSURE_TIERS),
            "geo_risk_intensity_tier": upper_tier("high_risk_order_rate", q["risk_low"], q["risk_high"], INTENSITY_TIERS),
        }
    )
    exposed = F.col("geo_exposure_tier").isin(*EXPOSURE_TIERS[:2])
    intense = F.col("geo_risk_intensity_tier").isin(*INTENSITY_TIERS[:2])
    earning = F.col("ao2_margin_policy_tier").isin(*MARGIN_TIERS[2:])
    archetype = (
        F.when(F.col("geo_data_quality_status") != "Complete Coordinates", "Data Quality Review")
        .when((seg == N.PROTECT) & exposed & intense, "Priority Protection Geography")
        .when(seg == N.EXPEDITE, "Selective Recovery Review")
        .when((seg == N.PRESERVE) & earning, "Preserve Service Geography")
        .when(seg == N.STANDARD, "Standard Monitoring Geography")
        .otherwise("Operational Monitoring Geography")
    )
    named = tiers.withColumns(
        {
            "ao2_margin_policy_tier_sort_order": rank_in("ao2_margin_policy_tier", MARGIN_TIERS),
            "geo_exposure_tier_sort_order": rank_in("geo_exposure_tier", EXPOSURE_TIERS),
            "geo_risk_intensity_tier_sort_order": rank_in("geo_risk_intensity_tier", INTENSITY_TIERS),
            "geo_decision_archetype": archetype,
        }
    )
    a = F.col("geo_decision_archetype")
    return named.withColumns(
        {
            "geo_decision_archetype_sort_order": lookup(a, {k: v[0] for k, v in ARCHETYPES.items()}, 100),
            "geo_recommended_focus": lookup(a, {k: v[1] for k, v in ARCHETYPES.items()}, "Monitor Operational Exposure"),
        }
    )
