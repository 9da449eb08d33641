"""ANSI SQL over the source tables: the order-item view and what derives from it.

Written independently of the Spark expressions, as the reference answer for them.
Amounts are DECIMAL here, so that sums are exact.
"""

from .orders import COUNTRY_NAMES

_NAMES = "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in COUNTRY_NAMES) + "]"

# Display label of each name above: by nation key, NULL and blank fall to the unknown token.
COUNTRY_DISPLAY = [
    "Germany", "United States", "Mexico", "Peru", "United Kingdom", "France", "Brazil", "Spain", "Netherlands",
    "Japan", "South Korea", "Turkey", "New Zealand", "Panama", "Belgium", "Egypt", "Saudi Arabia", "Morocco",
    "Sweden", "Atlantis", "Sint Maarten", "Italy", "India", "Unknown Country", "Unknown Country",
]
DISPLAY_LIST = "[" + ", ".join(f"'{n}'" for n in COUNTRY_DISPLAY) + "]"

BASE = f"""
base AS (
  SELECT l_orderkey AS Order_Id,
    concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS Order_Item_Id,
    o_orderdate AS order_date_DateOrders, l_shipdate AS shipping_date_DateOrders,
    CAST(datediff('day', o_orderdate, l_shipdate) AS INT) AS actual,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS planned,
    CAST(l_quantity AS INT) AS qty, l_extendedprice / l_quantity AS unit_price, l_discount + 0.0 AS disc_rate,
    l_linestatus AS line, l_returnflag AS ret, o_orderstatus AS stat,
    CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    l_partkey AS partkey, l_suppkey AS suppkey, o_custkey AS custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
money AS (
  SELECT *, cents * (100 - disc) AS value_u,
    (cents * (100 - disc) * (40 + 25 * tax - 30 * disc)) // 100000 AS profit_u
  FROM base),
oi AS (
  SELECT *, CAST(actual > planned AS INT) AS Late_delivery_risk,
    ['Same Day', 'First Class', 'Second Class', 'Standard Class'][planned] AS Shipping_Mode,
    CASE WHEN tax = 8 AND disc = 0 THEN NULL WHEN stat = 'F' AND ret = 'R' THEN 'Shipping canceled'
         WHEN actual > planned THEN 'Late delivery' WHEN actual < planned THEN 'Advance shipping'
         ELSE 'Shipping on time' END AS Delivery_Status,
    CASE WHEN stat = 'P' AND ret = 'A' THEN 'CANCELED' WHEN stat = 'O' AND ret = 'R' THEN 'SUSPECTED_FRAUD'
         WHEN stat = 'F' THEN 'COMPLETE' ELSE 'PENDING' END AS Order_Status,
    CASE ret WHEN 'A' THEN 'CASH' WHEN 'N' THEN 'DEBIT' ELSE 'TRANSFER' END AS Type,
    CAST(line = 'F' AS INT) AS Product_Status,
    CAST(value_u / 10000.0 AS DECIMAL(18,4)) AS Order_Item_Total,
    cents * disc / 10000.0 AS discount_amount,
    CAST((profit_u + (qty - 25) * 15000) / 10000.0 AS DECIMAL(18,4)) AS Order_Profit_Per_Order
  FROM money)"""

SCORED = BASE + """,
raw_scores AS (
  SELECT *, CASE WHEN qty = 13 AND tax = 0 THEN NULL
      ELSE CAST((800 + 1200 * (4 - planned) + 250 * disc + 40 * qty) / 10000.0 AS DECIMAL(18,4)) END AS p,
    CAST(profit_u / 10000.0 AS DECIMAL(18,4)) AS profit,
    CASE WHEN disc = 10 AND tax = 8 THEN CAST(0 AS DECIMAL(18,4)) ELSE Order_Item_Total END AS value
  FROM oi),
scored AS (
  SELECT *, CASE WHEN value > 0 THEN CAST(CAST(profit AS DOUBLE) / CAST(value AS DOUBLE) AS DECIMAL(38,12)) END AS margin,
    CASE WHEN value > 0 THEN CAST(profit AS DOUBLE) / CAST(value AS DOUBLE) END AS margin_d,
    p >= 0.35 AS risky
  FROM raw_scores),
seg AS (
  SELECT *, margin >= 0 AS rich,
    CASE WHEN p IS NULL OR profit IS NULL THEN 'requires_score_review'
         WHEN value IS NULL OR margin IS NULL OR value <= 0 THEN 'requires_margin_review'
         WHEN risky AND margin >= 0 THEN 'protect_high_value_at_risk'
         WHEN risky THEN 'expedite_selectively'
         WHEN margin >= 0 THEN 'preserve_service' ELSE 'standard_process' END AS segment
  FROM scored)"""

PLACES = f"""
places AS (
  SELECT s_suppkey, {_NAMES}[s_nationkey + 1] AS Order_Country, n_name AS Order_State, r_name AS Order_Region,
    s_name AS Order_City, CASE WHEN s_acctbal >= 0 THEN CAST(s_suppkey AS VARCHAR) END AS Order_Zipcode,
    CASE WHEN s_nationkey <> 13 THEN s_nationkey * CAST(7.3125 AS DOUBLE) - 80 END AS Latitude,
    CASE WHEN s_nationkey <> 13 THEN s_nationkey * CAST(14.125 AS DOUBLE) - 170 END AS Longitude,
    {DISPLAY_LIST}[s_nationkey + 1] AS display_country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
people AS (
  SELECT c_custkey, c_mktsegment AS Customer_Segment, {_NAMES}[c_nationkey + 1] AS Customer_Country,
    n_name AS Customer_City, r_name AS Customer_State,
    CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS VARCHAR) END AS Customer_Zipcode
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def token(expr: str) -> str:
    return rf"regexp_replace(lower(trim({expr})), '\s+', '_', 'g')"


def place_token(expr: str) -> str:
    return f"regexp_replace({token(expr)}, '[^a-z0-9_]', '', 'g')"


def scored(body: str) -> str:
    """Segments, then ``body``: a SELECT, or ``, more AS (...) SELECT``."""
    return f"WITH {SCORED} {body}"


def located(body: str) -> str:
    """Segments with customer, destination and product attributes."""
    return f"""WITH {SCORED}, {PLACES},
wide AS (
  SELECT seg.*, places.*, people.*, p_name, p_size, p_type, p_brand, p_retailprice,
    {place_token('Order_Country')} AS country_t, {place_token('Order_Region')} AS region_t,
    {place_token('Order_State')} AS state_t, {place_token('Order_City')} AS city_t,
    round(Latitude, 2) AS lat, round(Longitude, 2) AS lon,
    CAST(Latitude IS NOT NULL AND Longitude IS NOT NULL AS INT) AS has_geo,
    concat_ws('_', CAST(p_size AS VARCHAR), {token('p_type')}) AS category_key,
    concat_ws('_', CAST(CAST(substr(p_brand, 7, 5) AS INT) AS VARCHAR), {token('p_brand')}) AS department_key
  FROM seg JOIN places ON suppkey = s_suppkey JOIN people ON custkey = c_custkey JOIN part ON partkey = p_partkey)
{body}"""


LATE_PREDICTIONS = BASE + """,
preds AS (
  SELECT Order_Id, Order_Item_Id, order_date_DateOrders, Late_delivery_risk AS y, 'ao1_xgboost_classifier' AS model_name,
    (800 + 1200 * (4 - planned) + 250 * disc + 40 * qty) / 10000.0 AS p, 800 + 1200 * (4 - planned) + 250 * disc + 40 * qty AS pu FROM oi
  UNION ALL
  SELECT Order_Id, Order_Item_Id, order_date_DateOrders, Late_delivery_risk, 'ao1_logistic_regression_baseline',
    (1000 + 900 * (4 - planned) + 200 * tax + 60 * qty) / 10000.0, 1000 + 900 * (4 - planned) + 200 * tax + 60 * qty FROM oi)"""

PROFIT_PREDICTIONS = BASE + """,
preds AS (
  SELECT Order_Id, Order_Item_Id, order_date_DateOrders, CAST(Order_Profit_Per_Order AS DOUBLE) AS a, 'ao2_gradient_boosting_regressor' AS model_name,
    profit_u / 10000.0 AS f FROM oi
  UNION ALL
  SELECT Order_Id, Order_Item_Id, order_date_DateOrders, CAST(Order_Profit_Per_Order AS DOUBLE), 'ao2_ridge_baseline',
    (profit_u // 2 + 50000) / 10000.0 FROM oi),
errs AS (SELECT *, a - f AS r, abs(a - f) AS ae FROM preds)"""
