"""Feature sets, modelling tables, joins and chronological splits."""

from pyspark.sql import functions as F

from .. import names as N
from ..operators import contracts, features, gold, split
from ..operators.ordering import chronological_row_number
from . import oracle as O
from .orders import silver, table, with_scores
from .registry import doubles, query

_ALL = ("product", "customer", "place")
_TIER = "CASE WHEN planned <= 1 THEN 'expedited' WHEN planned <= 3 THEN 'standard' ELSE 'economy' END"
_SHIPPING = f"""planned AS scheduled_shipping_days, {_TIER} AS shipping_speed_tier,
  {O.token('Shipping_Mode')} AS shipping_mode_normalized, CAST(planned <= 1 AS INT) AS is_same_day_or_next_day_shipping,
  CAST(Shipping_Mode = 'Standard Class' AS INT) AS is_standard_shipping"""


@query("b15_b16_shipping_and_commercial", f"""WITH {O.BASE} SELECT Order_Id, Order_Item_Id, {_SHIPPING},
  round(unit_price * qty, 2) AS item_gross_sales_estimate, discount_amount / (unit_price * qty) AS item_discount_share_of_gross FROM oi""")
def b15(spark, sf):
    columns = features.shipping_columns() | features.commercial_columns()
    return silver(spark, sf).select(N.ORDER, N.ITEM, *[e.alias(n) for n, e in columns.items()])


@query("b17_shipping_product_features", O.located(f"""
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, {_SHIPPING}, category_key AS product_category_key,
  department_key AS product_department_key, concat_ws('_', partkey, p_size, suppkey) AS product_catalog_key,
  {O.token('p_name')} AS product_name_normalized, Product_Status AS product_status_flag, p_retailprice AS product_list_price,
  qty AS order_item_quantity, unit_price AS item_unit_price, discount_amount AS item_discount_amount,
  disc_rate AS item_discount_rate, round(unit_price * qty, 2) AS item_gross_sales_estimate,
  CAST(Order_Item_Total AS DOUBLE) AS item_net_sales_amount, discount_amount / (unit_price * qty) AS item_discount_share_of_gross
FROM wide"""))
def b17(spark, sf):
    return features.shipping_product_features(silver(spark, sf, "product"), stamp=None)


@query("b13_customer_regional_features", O.located(f"""
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, {O.token('Customer_Segment')} AS customer_segment_normalized,
  {O.place_token('Customer_Country')} AS customer_country_normalized, {O.place_token('Customer_State')} AS customer_state_normalized,
  {O.place_token('Customer_City')} AS customer_city_normalized, CAST(Customer_Zipcode IS NOT NULL AS INT) AS customer_zipcode_available,
  region_t AS market_normalized, country_t AS order_country_normalized, region_t AS order_region_normalized,
  state_t AS order_state_normalized, city_t AS order_city_normalized, CAST(Order_Zipcode IS NOT NULL AS INT) AS order_zipcode_available,
  concat_ws('_', {O.place_token('Customer_Country')}, {O.place_token('Customer_State')}, {O.place_token('Customer_City')}) AS customer_region_key,
  concat_ws('_', country_t, region_t, state_t, city_t) AS order_region_key,
  CAST(coalesce({O.place_token('Customer_Country')} = country_t, FALSE) AS INT) AS customer_order_country_match,
  CAST(coalesce({O.place_token('Customer_State')} = state_t, FALSE) AS INT) AS customer_order_state_match,
  lat AS latitude_rounded, lon AS longitude_rounded, has_geo AS geo_coordinates_available FROM wide"""))
def b13(spark, sf):
    return features.customer_regional_features(silver(spark, sf, "customer", "place"), stamp=None)


_TIME = """CAST(year(order_date_DateOrders) AS INT) AS order_year, CAST(quarter(order_date_DateOrders) AS INT) AS order_quarter,
  CAST(month(order_date_DateOrders) AS INT) AS order_month, CAST(week(order_date_DateOrders) AS INT) AS order_week_of_year,
  CAST(day(order_date_DateOrders) AS INT) AS order_day_of_month, CAST(dayofweek(order_date_DateOrders) + 1 AS INT) AS order_day_of_week,
  CAST(hour(order_date_DateOrders) AS INT) AS order_hour, CAST(dayofweek(order_date_DateOrders) IN (0, 6) AS INT) AS order_is_weekend,
  CASE WHEN month(order_date_DateOrders) IN (12, 1, 2) THEN 'winter' WHEN month(order_date_DateOrders) < 6 THEN 'spring'
    WHEN month(order_date_DateOrders) < 9 THEN 'summer' ELSE 'fall' END AS order_season"""
_REGIONAL = f"""{O.token('Customer_Segment')} AS customer_segment_normalized, {O.place_token('Customer_Country')} AS customer_country_normalized,
  {O.place_token('Customer_State')} AS customer_state_normalized, CAST(Customer_Zipcode IS NOT NULL AS INT) AS customer_zipcode_available,
  region_t AS market_normalized, country_t AS order_country_normalized, region_t AS order_region_normalized, state_t AS order_state_normalized,
  CAST(Order_Zipcode IS NOT NULL AS INT) AS order_zipcode_available,
  CAST(coalesce({O.place_token('Customer_Country')} = country_t, FALSE) AS INT) AS customer_order_country_match,
  CAST(coalesce({O.place_token('Customer_State')} = state_t, FALSE) AS INT) AS customer_order_state_match, has_geo AS geo_coordinates_available"""
_GOLD_LATE = O.located(f"""
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, Late_delivery_risk, Type, {_TIME}, {_SHIPPING},
  category_key AS product_category_key, department_key AS product_department_key, {_REGIONAL} FROM wide
WHERE Delivery_Status <> 'Shipping canceled' AND Order_Status NOT IN ('CANCELED', 'SUSPECTED_FRAUD')""")
_GOLD_PROFIT = O.located(f"""
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, CAST(Order_Profit_Per_Order AS DOUBLE) AS Order_Profit_Per_Order, Type, {_TIME}, {_SHIPPING},
  category_key AS product_category_key, department_key AS product_department_key, unit_price AS item_unit_price,
  disc_rate AS item_discount_rate, qty AS order_item_quantity, {_REGIONAL}, CAST(Order_Item_Total AS DOUBLE) AS ao3_order_value FROM wide""")


@query("d1_primary_population", f"""WITH {O.BASE} SELECT Delivery_Status, Order_Status, count(*) AS row_count FROM oi
WHERE Delivery_Status <> 'Shipping canceled' AND Order_Status NOT IN ('CANCELED', 'SUSPECTED_FRAUD') GROUP BY 1, 2""")
def d1(spark, sf):
    return gold.primary_population(silver(spark, sf)).groupBy("Delivery_Status", "Order_Status").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("e1_gold_late_one_pass", _GOLD_LATE)
def e1(spark, sf):
    return gold.gold_from_silver(silver(spark, sf, *_ALL), N.LATE)


def _late_feature_rows(spark, sf):
    """What both forms from feature tables read: the rows' own columns and the features that the table takes, of each set."""
    made = features.all_feature_columns()
    sets = [[n for n in names if n in N.LATE_PREDICTORS] for names in (N.TIME_FEATURES, N.SHIPPING_PRODUCT_FEATURES, N.CUSTOMER_REGIONAL_FEATURES)]
    own = [*N.KEYS, N.LATE, "Type", "Delivery_Status", "Order_Status"]
    return silver(spark, sf, *_ALL).select(*own, *[made[n].alias(n) for names in sets for n in names]), own, sets


@query("e1_gold_late_joined", _GOLD_LATE)
def e1_joined(spark, sf):
    rows, own, sets = _late_feature_rows(spark, sf)
    rows = gold.store_by_keys(rows, "features")  # dealt by the keys once, for all four sides
    return gold.gold_from_tables(rows.select(*own), [rows.select(*N.KEYS, *names) for names in sets], N.LATE)


@query("e1_gold_late_bucketed", _GOLD_LATE)
def e1_bucketed(spark, sf):
    """From stored feature tables that are bucketed by the keys they are joined on."""
    rows, own, sets = _late_feature_rows(spark, sf)
    rows = gold.store_by_keys(rows, "rows")  # dealt by the keys once, for all four stores
    parts = [gold.store_by_keys(rows.select(*N.KEYS, *names), f"features{i}") for i, names in enumerate(sets)]
    return gold.gold_from_tables(gold.store_by_keys(rows.select(*own), "items"), parts, N.LATE)


@query("e2_gold_profit", _GOLD_PROFIT)
def e2(spark, sf):
    return doubles(gold.gold_from_silver(silver(spark, sf, *_ALL), N.PROFIT))


@query("d5_gold_contract", O.located("""
SELECT 'null' AS problem, 'customer_country_normalized' AS subject, count(*) AS violations FROM wide
WHERE Delivery_Status <> 'Shipping canceled' AND Order_Status NOT IN ('CANCELED', 'SUSPECTED_FRAUD') AND Customer_Country IS NULL HAVING count(*) > 0
UNION ALL SELECT 'null', 'order_country_normalized', count(*) FROM wide
WHERE Delivery_Status <> 'Shipping canceled' AND Order_Status NOT IN ('CANCELED', 'SUSPECTED_FRAUD') AND Order_Country IS NULL HAVING count(*) > 0"""))
def d5_gold(spark, sf):
    made = gold.gold_from_silver(silver(spark, sf, *_ALL), N.LATE)
    return contracts.check_contract(made, contracts.gold_contract(N.LATE))


@query("e3_e4_left_enrichment", O.located("""
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, segment AS ao3_priority_segment,
  CASE WHEN p_size > 10 THEN category_key END AS product_category_key FROM wide"""))
def e3(spark, sf):
    rows = with_scores(silver(spark, sf))
    from ..operators.decisions import assign_segments

    facts = assign_segments(rows).select(*N.KEYS, N.SEGMENT)
    product = silver(spark, sf, "product")
    dims = features.shipping_product_features(product.where("Category_Id > 10"), None)
    doubled = dims.select(*N.KEYS, "product_category_key").unionByName(dims.select(*N.KEYS, "product_category_key"))
    return gold.enrich_left(facts, (gold.dedupe_keys(doubled), ["product_category_key"]))


@query("e5_key_differences", f"""WITH {O.BASE}
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, 'missing' AS side FROM oi WHERE qty > 40 AND NOT (qty < 45)
UNION ALL SELECT Order_Id, Order_Item_Id, order_date_DateOrders, 'unexpected' FROM oi WHERE qty <= 40 AND qty > 35""")
def e5(spark, sf):
    rows = silver(spark, sf)
    left, right = rows.where("Order_Item_Quantity > 40"), rows.where("Order_Item_Quantity > 35 AND Order_Item_Quantity < 45")
    return gold.key_diff(left, right)


@query("e6_key_coverage", f"""WITH {O.BASE},
a AS (SELECT DISTINCT Order_Id, Order_Item_Id FROM oi WHERE qty > 10), b AS (SELECT DISTINCT Order_Id, Order_Item_Id FROM oi WHERE qty < 40)
SELECT (SELECT count(*) FROM oi WHERE qty > 10) AS left_rows, (SELECT count(*) FROM oi WHERE qty < 40) AS right_rows,
  (SELECT count(*) FROM a JOIN b USING (Order_Id, Order_Item_Id)) AS common_rows,
  (SELECT count(*) FROM a ANTI JOIN b USING (Order_Id, Order_Item_Id)) AS left_only_rows,
  (SELECT count(*) FROM b ANTI JOIN a USING (Order_Id, Order_Item_Id)) AS right_only_rows, CAST(0 AS BIGINT) AS duplicated_keys""")
def e6(spark, sf):
    rows = silver(spark, sf)
    return gold.key_coverage(rows.where("Order_Item_Quantity > 10"), rows.where("Order_Item_Quantity < 40"))


@query("e6_merge_one_to_one", f"""WITH {O.SCORED} SELECT Order_Id, Order_Item_Id, order_date_DateOrders,
  CAST(p AS DOUBLE) AS ao1_predicted_late_delivery_probability, CAST(profit AS DOUBLE) AS ao2_predicted_order_profit,
  margin_d AS ao3_predicted_margin FROM scored WHERE qty > 10 AND qty < 40""")
def e6_merge(spark, sf):
    rows = with_scores(silver(spark, sf))
    late = rows.where("Order_Item_Quantity > 10").select(*N.KEYS, N.RISK)
    profit = rows.where("Order_Item_Quantity < 40").select(*N.KEYS, N.EXPECTED_PROFIT, N.MARGIN)
    return doubles(gold.merge_one_to_one(late, profit))


@query("e7_star_lookups", f"""WITH {O.SCORED}, bands AS (SELECT * FROM (VALUES
  ('Negative Profit', 1), ('$0 to $10', 2), ('$10 to $25', 3), ('$25 to $50', 4), ('$50 to $100', 5), ('$100+', 6)) AS t(profit_band, profit_band_sort)),
f AS (SELECT CASE WHEN profit < 0 THEN 'Negative Profit' WHEN profit < 10 THEN '$0 to $10' WHEN profit < 25 THEN '$10 to $25'
  WHEN profit < 50 THEN '$25 to $50' WHEN profit < 100 THEN '$50 to $100' ELSE '$100+' END AS profit_band, count(*) AS n FROM seg GROUP BY 1)
SELECT profit_band, profit_band_sort, coalesce(n, 0) AS n FROM bands LEFT JOIN f USING (profit_band)""")
def e7(spark, sf):
    from ..functions.bands import profit_band
    from ..operators.measures import profit_band_dim

    rows = with_scores(silver(spark, sf))
    counted = rows.groupBy(profit_band(labels=N.PROFIT_BANDS_TO).alias("profit_band")).agg(F.count(F.lit(1)).alias("n"))
    out = gold.attach_dimension(counted, profit_band_dim(rows), "profit_band", keep_empty=True)
    return out.select("profit_band", "profit_band_sort", F.coalesce("n", F.lit(0)).alias("n"))


# --- chronological split ------------------------------------------------------------
_NUMBERED = f"""WITH {O.BASE}, num AS (SELECT *, row_number() OVER (ORDER BY order_date_DateOrders, Order_Id, Order_Item_Id) AS rn FROM oi),
b AS (SELECT *, CASE WHEN rn <= floor((SELECT count(*) FROM oi) * 0.8) THEN 'development' ELSE 'test' END AS part FROM num)"""


@query("g1_chronological_row_number", _NUMBERED + " SELECT Order_Id, Order_Item_Id, order_date_DateOrders, rn AS chronological_row_number FROM b")
def g1(spark, sf):
    return chronological_row_number(silver(spark, sf).select(*N.KEYS), N.CHRONOLOGY, N.ROW_NUMBER)


@query("g2_chronological_split", _NUMBERED + """ SELECT Order_Id, Order_Item_Id, order_date_DateOrders, Late_delivery_risk,
  rn AS chronological_row_number, part AS split_partition FROM b""")
def g2(spark, sf):
    return split.chronological_split(silver(spark, sf).select(*N.KEYS, N.LATE))


@query("g2_selected_boundary", _NUMBERED + """ SELECT Order_Id, Order_Item_Id, part AS split_partition FROM b""")
def g2_selected(spark, sf):
    """The split label from the boundary row alone, without numbering the rows."""
    return split.label_split(silver(spark, sf).select(*N.KEYS)).select(N.ORDER, N.ITEM, N.SPLIT)


@query("g3_inner_split", _NUMBERED + """ SELECT Order_Id, Order_Item_Id, rn AS chronological_row_number,
  CASE WHEN rn <= floor((SELECT count(*) FROM b WHERE part = 'development') * CAST(0.8 AS DOUBLE)) THEN 'development_inner_train' ELSE 'development_inner_validation' END AS modeling_slice
FROM b WHERE part = 'development'""")
def g3(spark, sf):
    out = split.inner_split(split.chronological_split(silver(spark, sf).select(*N.KEYS)))
    return out.select(N.ORDER, N.ITEM, N.ROW_NUMBER, "modeling_slice")


@query("g5_ordering_breaks", _NUMBERED + """ SELECT rn AS chronological_row_number, order_date_DateOrders, Order_Id, Order_Item_Id FROM (
  SELECT rn, order_date_DateOrders, Order_Id, Order_Item_Id, lag(Order_Id) OVER (ORDER BY rn) AS before FROM b) WHERE Order_Id < before""")
def g5(spark, sf):
    numbered = chronological_row_number(silver(spark, sf).select(*N.KEYS), N.CHRONOLOGY, N.ROW_NUMBER)
    broken = contracts.ordering_breaks(numbered, order=[N.ORDER], block=1000)
    return broken.join(numbered.drop(N.ORDER), N.ROW_NUMBER).select(N.ROW_NUMBER, *N.CHRONOLOGY)


@query("g6_row_number_complete", _NUMBERED + """ SELECT min(rn) AS min_row_number, max(rn) AS max_row_number, count(*) AS row_count,
  count(DISTINCT rn) AS distinct_row_numbers, TRUE AS is_complete FROM b""")
def g6(spark, sf):
    return contracts.row_number_complete(
        chronological_row_number(silver(spark, sf).select(*N.KEYS), N.CHRONOLOGY, N.ROW_NUMBER))


_SUMMARY = """ SELECT CASE WHEN part IS NULL THEN 'overall' ELSE 'partition' END AS summary_level, coalesce(part, 'overall') AS split_partition,
  count(*) AS row_count, min(order_date_DateOrders) AS min_order_date_DateOrders, max(order_date_DateOrders) AS max_order_date_DateOrders,
  {measures}, CAST(0 AS BIGINT) AS target_missing_count, min(rn) AS min_chronological_row_number, max(rn) AS max_chronological_row_number,
  count(*) / (SELECT count(*) FROM oi) AS percentage_of_total FROM b GROUP BY GROUPING SETS ((), (part))"""


@query("f5_partition_summary_late", _NUMBERED + _SUMMARY.format(measures="""count(*) FILTER (Late_delivery_risk = 1) AS late_delivery_count,
  count(*) FILTER (Late_delivery_risk = 0) AS non_late_count, count(*) FILTER (Late_delivery_risk = 1) / count(*) AS late_delivery_rate"""))
def f5_late(spark, sf):
    return split.partition_summary(split.label_split(silver(spark, sf).select(*N.KEYS, N.LATE)), N.LATE)


@query("f5_partition_summary_profit", _NUMBERED + _SUMMARY.format(measures="""
  CAST(min(Order_Profit_Per_Order) AS DOUBLE) AS target_min_Order_Profit_Per_Order, CAST(max(Order_Profit_Per_Order) AS DOUBLE) AS target_max_Order_Profit_Per_Order,
  CAST(sum(Order_Profit_Per_Order) AS DOUBLE) / count(*) AS target_avg_Order_Profit_Per_Order"""))
def f5_profit(spark, sf):
    return split.partition_summary(split.label_split(silver(spark, sf).select(*N.KEYS, N.PROFIT)), N.PROFIT)


@query("d2_slice_partition", _NUMBERED + " SELECT Order_Id, Order_Item_Id, rn AS chronological_row_number FROM b WHERE part = 'test'")
def d2(spark, sf):
    out = split.slice_partition(split.chronological_split(silver(spark, sf).select(*N.KEYS)), N.TEST)
    return out.select(N.ORDER, N.ITEM, N.ROW_NUMBER)


@query("f11_class_distribution", f"""WITH {O.BASE} SELECT count(*) AS row_count, count(*) FILTER (Late_delivery_risk = 1) AS positive_count,
  count(*) FILTER (Late_delivery_risk = 0) AS negative_count, count(*) FILTER (Late_delivery_risk = 1) / count(*) AS positive_rate,
  count(*) FILTER (Late_delivery_risk = 0) / count(*) FILTER (Late_delivery_risk = 1) AS positive_class_weight FROM oi""")
def f11(spark, sf):
    return split.class_distribution(silver(spark, sf))
