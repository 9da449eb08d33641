"""Row-local feature sets.

All three sets are plain expressions over the silver row.  They can be stored as
separate tables, or composed into one projection so that no self-join is needed.
"""

from __future__ import annotations

from collections.abc import Container

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.calendar import order_time_columns
from ..functions.text import (
    _c, composite_key, equality_flag, location_token, presence_flag, text_token,
)

LINEAGE = (N.INGEST_TS, N.SOURCE_FILE, N.SILVER_TS)


def speed_tier(days: Column | str) -> Column:
    """Shipping tier by promised days; unknown counts as economy."""
    d = _c(days)
    return F.when(d <= 1, "expedited").when(d <= 3, "standard").otherwise("economy")


def shipping_columns(days: str = "Days_for_shipment_scheduled", mode: str = "Shipping_Mode") -> dict[str, Column]:
    standard = F.lower(F.trim(F.col(mode))) == "standard class"
    return {
        "scheduled_shipping_days": F.col(days).cast("int"),
        "shipping_speed_tier": speed_tier(days),
        "shipping_mode_normalized": text_token(mode),
        "is_same_day_or_next_day_shipping": F.coalesce((F.col(days) <= 1).cast("int"), F.lit(0)),
        "is_standard_shipping": F.coalesce(standard.cast("int"), F.lit(0)),
    }


def commercial_columns(
    price: str = "Order_Item_Product_Price",
    quantity: str = "Order_Item_Quantity",
    discount: str = "Order_Item_Discount",
) -> dict[str, Column]:
    """Gross sales and the discount's share of it (NULL unless gross is positive)."""
    gross = F.col(price) * F.col(quantity)
    return {
        "item_gross_sales_estimate": F.round(gross, 2),
        "item_discount_share_of_gross": F.when(gross > 0, F.col(discount) / gross).cast("double"),
    }


def product_columns() -> dict[str, Column]:
    return {
        "product_category_key": composite_key("Category_Id", text_token("Category_Name")),
        "product_department_key": composite_key("Department_Id", text_token("Department_Name")),
        "product_catalog_key": composite_key("Product_Card_Id", "Product_Category_Id", "Order_Item_Cardprod_Id"),
        "product_name_normalized": text_token("Product_Name"),
    }


# Feature name, silver column and type of the values passed through unchanged.
_PASSED_THROUGH = (
    ("product_status_flag", "Product_Status", "int"),
    ("product_list_price", "Product_Price", "double"),
    ("order_item_quantity", "Order_Item_Quantity", "int"),
    ("item_unit_price", "Order_Item_Product_Price", "double"),
    ("item_discount_amount", "Order_Item_Discount", "double"),
    ("item_discount_rate", "Order_Item_Discount_Rate", "double"),
    ("item_net_sales_amount", "Order_Item_Total", "double"),
)


def _or_carried(made: dict[str, Column], carried: Container[str]) -> dict[str, Column]:
    return {name: F.col(name) if name in carried else e for name, e in made.items()}


def shipping_product_columns(carried: Container[str] = ()) -> dict[str, Column]:
    """The set's columns; those that the rows have ``carried`` from a dimension are taken as they are."""
    found = shipping_columns() | product_columns() | commercial_columns()
    found |= {name: F.col(source).cast(kind) for name, source, kind in _PASSED_THROUGH}
    return _or_carried({name: found[name] for name in N.SHIPPING_PRODUCT_FEATURES}, carried)


def geo_columns(lat: str = "Latitude", lon: str = "Longitude") -> dict[str, Column]:
    return {
        "latitude_rounded": F.round(F.col(lat), 2).cast("double"),
        "longitude_rounded": F.round(F.col(lon), 2).cast("double"),
        "geo_coordinates_available": (F.col(lat).isNotNull() & F.col(lon).isNotNull()).cast("int"),
    }


def customer_regional_columns(carried: Container[str] = ()) -> dict[str, Column]:
    """The set's columns; those that the rows have ``carried`` from a dimension are taken as they are."""
    place = _or_carried({
        f"{side}_{part}_normalized": location_token(f"{side.title()}_{part.title()}")
        for side, parts in (
            ("customer", ("country", "state", "city")),
            ("order", ("country", "region", "state", "city")),
        )
        for part in parts
    }, carried)

    def p(name: str) -> Column:
        return place[f"{name}_normalized"]

    found = place | geo_columns() | {
        "customer_segment_normalized": text_token("Customer_Segment"),
        "market_normalized": location_token("Market"),
        "customer_zipcode_available": presence_flag("Customer_Zipcode"),
        "order_zipcode_available": presence_flag("Order_Zipcode"),
        "customer_region_key": composite_key(p("customer_country"), p("customer_state"), p("customer_city")),
        "order_region_key": composite_key(
            p("order_country"), p("order_region"), p("order_state"), p("order_city")
        ),
        "customer_order_country_match": equality_flag(p("customer_country"), p("order_country")),
        "customer_order_state_match": equality_flag(p("customer_state"), p("order_state")),
    }
    return _or_carried({name: found[name] for name in N.CUSTOMER_REGIONAL_FEATURES}, carried)


def _feature_table(df: DataFrame, columns: dict[str, Column], stamp: str | None) -> DataFrame:
    carried = [c for c in (*N.KEYS, *LINEAGE) if c in df.columns]
    stamped = [F.current_timestamp().alias(stamp)] if stamp else []
    return df.select(*carried, *[e.alias(n) for n, e in columns.items()], *stamped)


def shipping_product_features(
    silver: DataFrame, stamp: str | None = "_shipping_product_features_processed_timestamp"
) -> DataFrame:
    return _feature_table(silver, shipping_product_columns(), stamp)


def customer_regional_features(
    silver: DataFrame, stamp: str | None = "_customer_regional_features_processed_timestamp"
) -> DataFrame:
    return _feature_table(silver, customer_regional_columns(), stamp)


def all_feature_columns(carried: Container[str] = ()) -> dict[str, Column]:
    """Every feature of the three sets over one silver row; text features that it has ``carried`` are not made again."""
    return order_time_columns() | shipping_product_columns(carried) | customer_regional_columns(carried)
