"""Order items of the benchmark's star schema, in the silver layout.

Each function takes the data folder and joins only the dimensions it is asked for,
since an inner join cannot be pruned away once it is in the plan.

``Order_Item_Id`` is built from the line's own columns (line number, part, supplier,
quantity and ship date are unique inside an order): it needs no window, and one
enormous order costs no more than many small ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from ..functions.text import composite_key, location_token, text_token
from ..session import SPREAD_CONF, compile_in_parts
from ..operators.decisions import assign_segments, predicted_margin

# Tables that grow with the data; the others are read as they are.
_FACTS = {"lineitem", "documents", "events", "pages"}

#: Features that are tokens of a dimension's text.
TOKENS = (
    "product_category_key", "product_department_key", "customer_segment_normalized",
    *(f"customer_{p}_normalized" for p in ("country", "state")),
    *(f"order_{p}_normalized" for p in ("country", "state", "region")), "market_normalized",
)

# Names the generated nations are given, by nation key: accents, separators, an
# unmapped name, a blank and a NULL are all represented.
COUNTRY_NAMES = [
    "Alemania", "Estados Unidos", "México", "Perú", "Reino_Unido", "Francia", "Brasil", "España",
    "Países Bajos", "Japón", "Corea del Sur", "Turquía", "Nueva Zelanda", "Panamá", "Bélgica", "Egipto",
    "Arabia Saudí", "Marruecos", "Suecia", "Atlantis", "sint-maarten", "Italia", "India", "  ", None,
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One source table.

    A local session may ask for its fact tables, each a single file that one task would
    read, to be spread over its cores by their leading columns.  A cluster does not.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    spread = int(spark.conf.get(SPREAD_CONF, "0"))
    return df.repartition(spread, *df.columns[:4]) if spread and name in _FACTS else df


def _units(column: str, scale: int) -> Column:
    """A two-decimal double as a whole number of hundredths."""
    return F.rint(F.col(column) * scale).cast("long")


def _money(units: Column) -> Column:
    """Ten-thousandths to currency."""
    return units / 10000.0


def _country(key: Column | str) -> Column:
    return F.get(F.array(*[F.lit(x).cast("string") for x in COUNTRY_NAMES]), F.col(key) if isinstance(key, str) else key)


def _joined(spark: SparkSession, folder: str, parts: Sequence[str]) -> DataFrame:
    """Lines with the source columns of what they refer to.

    Lines are moved with what other tables have on them, never with what follows from it; customers are joined
    to orders, which are fewer, and those last.  Nations, a table of fixed size, come when all else is in place.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    if "place" in parts:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", (F.col("s_acctbal") >= 0).alias("_s_zip"))
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    if "product" in parts:
        part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand", "p_retailprice")
        if "tokens" in parts:
            part = part.withColumns({
                "product_category_key": composite_key("p_size", text_token("p_type")),
                "product_department_key": composite_key(_department(), text_token("p_brand"))})
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    if "customer" in parts:
        customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_acctbal") >= 0).alias("_c_zip"))
        if "tokens" in parts:
            customer = customer.withColumn("customer_segment_normalized", text_token("c_mktsegment"))
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "customer" in parts:
        df = df.join(F.broadcast(_places(spark, folder, "tokens" in parts, {
            "c_nationkey": "key", "Customer_City": "nation", "Customer_State": "region"}, {
            "customer_country_normalized": "country", "customer_state_normalized": "region"})), "c_nationkey")
    if "place" in parts:
        df = df.join(F.broadcast(_places(spark, folder, "tokens" in parts, {
            "s_nationkey": "key", "Order_State": "nation", "Order_Region": "region"}, {
            "order_country_normalized": "country", "order_state_normalized": "nation",
            "order_region_normalized": "region", "market_normalized": "region"})), "s_nationkey")
    return df


def _base(joined: DataFrame, carried: Mapping[str, Column]) -> DataFrame:
    """Lines with their order: keys, delivery, status and amounts, and the ``carried`` columns of other tables."""
    scheduled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2)
        .when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(4)
    )
    discount, tax = _units("l_discount", 100), _units("l_tax", 100)
    step = joined.select(
        F.col("l_orderkey").alias(N.ORDER),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string"),
                    F.unix_date(F.col("l_shipdate").cast("date")).cast("string")).alias(N.ITEM),
        F.col("o_orderdate").alias(N.ORDER_TS), F.col("l_shipdate").alias(N.SHIP_TS),
        F.datediff("l_shipdate", "o_orderdate").alias("Days_for_shipping_real"),
        scheduled.alias("Days_for_shipment_scheduled"),
        F.col("l_quantity").cast("int").alias("Order_Item_Quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Order_Item_Product_Price"),
        (F.col("l_discount") + 0.0).alias("Order_Item_Discount_Rate"),
        F.col("l_linestatus").alias("_line"), F.col("l_returnflag").alias("_return"),
        F.col("o_orderstatus").alias("_status"),
        discount.alias("_discount"), tax.alias("_tax"),
        _units("l_extendedprice", 100).alias("_cents"),
        F.col("l_partkey").alias("Product_Card_Id"), F.col("l_suppkey").alias("Order_Item_Cardprod_Id"),
        F.col("o_custkey").alias("Customer_Id"),
        *[e.alias(n) for n, e in carried.items()],
    )
    value = F.col("_cents") * (100 - F.col("_discount"))
    step = step.withColumn("_value", value).withColumn(
        "_profit", F.expr("(_value * (40 + 25 * _tax - 30 * _discount)) div 100000"))
    actual, planned = F.col("Days_for_shipping_real"), F.col("Days_for_shipment_scheduled")
    returned, status = F.col("_return"), F.col("_status")
    realized = _money(F.col("_profit") + (F.col("Order_Item_Quantity") - 25) * 15000)
    mode = F.array(*[F.lit(x) for x in ("Same Day", "First Class", "Second Class", "Standard Class")])
    return step.withColumns(
        {
            N.LATE: (actual > planned).cast("int"),
            "Shipping_Mode": F.element_at(mode, planned),
            "Delivery_Status": F.when((F.col("_tax") == 8) & (F.col("_discount") == 0), F.lit(None))
            .when((status == "F") & (returned == "R"), N.CANCELLED_DELIVERY)
            .when(actual > planned, "Late delivery").when(actual < planned, "Advance shipping")
            .otherwise("Shipping on time"),
            "Order_Status": F.when((status == "P") & (returned == "A"), "CANCELED")
            .when((status == "O") & (returned == "R"), "SUSPECTED_FRAUD")
            .when(status == "F", "COMPLETE").otherwise("PENDING"),
            "Type": F.when(returned == "A", "CASH").when(returned == "N", "DEBIT").otherwise("TRANSFER"),
            "Product_Status": (F.col("_line") == "F").cast("int"),
            "Order_Item_Total": _money(F.col("_value")),
            "Order_Item_Discount": (F.col("_cents") * F.col("_discount")) / 10000.0,
            N.PROFIT: realized,
            "Benefit_per_order": realized + F.when(F.col("_tax") == 3, 0.5).otherwise(0.0),
        }
    )


def silver(spark: SparkSession, folder: str, *parts: str) -> DataFrame:
    """Silver-layout order items.  ``parts``: any of ``product``, ``customer``, ``place``; ``tokens`` adds the features
    that are text tokens of those, made on the dimensions' rows."""
    compile_in_parts(spark)  # what follows from a line is one wide projection
    carried: dict[str, Column] = {}
    if "product" in parts:
        carried |= {
            "Product_Name": F.col("p_name"), "Category_Id": F.col("p_size"), "Product_Category_Id": F.col("p_size"),
            "Category_Name": F.col("p_type"), "Department_Id": _department(),
            "Department_Name": F.col("p_brand"), "Product_Price": F.col("p_retailprice")}
    if "customer" in parts:
        carried |= {
            "Customer_Segment": F.col("c_mktsegment"), "Customer_Country": _country("c_nationkey"),
            "Customer_City": F.col("Customer_City"), "Customer_State": F.col("Customer_State"),
            "Customer_Zipcode": F.when(F.col("_c_zip"), F.col("o_custkey").cast("string"))}
    if "place" in parts:
        key = F.col("s_nationkey")
        known = key != 13
        carried |= {
            "Order_Country": _country(key), "Order_State": F.col("Order_State"), "Order_Region": F.col("Order_Region"),
            "Market": F.col("Order_Region"), "Order_City": F.col("s_name"),
            "Order_Zipcode": F.when(F.col("_s_zip"), F.col("l_suppkey").cast("string")),
            "Latitude": F.when(known, key * 7.3125 - 80.0), "Longitude": F.when(known, key * 14.125 - 170.0)}
    joined = _joined(spark, folder, parts)
    if "tokens" in parts:
        carried |= {c: F.col(c) for c in joined.columns if c in TOKENS}
    return _base(joined, carried)


def _department() -> Column:
    return F.substring("p_brand", 7, 5).cast("int")


def _places(spark: SparkSession, folder: str, tokens: bool, plain: Mapping[str, str], tokenised: Mapping[str, str]) -> DataFrame:
    """Nations under the ``plain`` names and, if asked for, the ``tokenised`` ones."""
    rows = _nations(spark, folder).toDF("key", "nation", "region").withColumn("country", _country("key"))
    made = [location_token(source).alias(name) for name, source in tokenised.items()] if tokens else []
    return rows.select(*[F.col(source).alias(name) for name, source in plain.items()], *made)


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    """Nation key, nation and region name."""
    return table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")


def risk_units() -> Column:
    """Deterministic stand-in for the late-delivery score, in ten-thousandths."""
    return (
        800 + 1200 * (4 - F.col("Days_for_shipment_scheduled")) + 250 * F.col("_discount")
        + 40 * F.col("Order_Item_Quantity")
    )


def second_risk_units() -> Column:
    return (
        1000 + 900 * (4 - F.col("Days_for_shipment_scheduled")) + 200 * F.col("_tax")
        + 60 * F.col("Order_Item_Quantity")
    )


def with_scores(df: DataFrame) -> DataFrame:
    """Stand-in scores, with missing risks and worthless items among them."""
    unscored = (F.col("Order_Item_Quantity") == 13) & (F.col("_tax") == 0)
    worthless = (F.col("_discount") == 10) & (F.col("_tax") == 8)
    out = df.withColumns(
        {
            N.RISK: F.when(~unscored, _money(risk_units())),
            N.EXPECTED_PROFIT: _money(F.col("_profit")),
            N.ORDER_VALUE: F.when(worthless, 0.0).otherwise(F.col("Order_Item_Total")),
        }
    )
    return out.withColumns({N.MARGIN: predicted_margin(), N.HIGH_RISK: F.col(N.RISK) >= N.RISK_CUTOFF})


def segments(spark: SparkSession, folder: str, *parts: str) -> DataFrame:
    """Scored and segmented order items."""
    return assign_segments(with_scores(silver(spark, folder, *parts)))


LATE_MODELS = ("ao1_xgboost_classifier", "ao1_logistic_regression_baseline")
PROFIT_MODELS = ("ao2_gradient_boosting_regressor", "ao2_ridge_baseline")


def late_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and order item, both models from one scan."""
    scores = [_money(risk_units()), _money(second_risk_units())]
    both = F.array(*[F.struct(F.lit(m).alias("model_name"), s.alias("predicted_probability"))
                     for m, s in zip(LATE_MODELS, scores)])
    return silver(spark, folder).select(*N.KEYS, N.LATE, F.inline(both))


def profit_predictions(spark: SparkSession, folder: str) -> DataFrame:
    scores = [_money(F.col("_profit")), _money(F.expr("_profit div 2") + 50000)]
    both = F.array(*[F.struct(F.lit(m).alias("model_name"), s.alias("predicted_profit"))
                     for m, s in zip(PROFIT_MODELS, scores)])
    return silver(spark, folder).select(*N.KEYS, N.PROFIT, F.inline(both))
