"""Cleaning, text, calendar and contract queries."""

from pyspark.sql import functions as F

from .. import names as N
from ..functions import bands, calendar, text
from ..operators import cleaning, contracts, sketches
from ..session import materialize
from ..sources.catalog import catalog_problems, dictionary_problems, screening_problems, vocabulary_violations
from . import oracle as O
from .orders import COUNTRY_NAMES, segments, silver, table
from .registry import query

# Dirty text derived from every part: padding, inner runs of blanks, blanks and empty cells.
_DIRTY_SQL = """dirty AS (SELECT p_partkey,
  CASE WHEN p_size < 5 THEN '   ' WHEN p_size < 8 THEN '' ELSE '  ' || replace(p_name, ' ', '   ') || ' ' END AS name,
  ' ' || p_brand || '  ' AS brand FROM part)"""


def _dirty(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(size < 5, "   ").when(size < 8, "").otherwise(
            F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))).alias("name"),
        F.concat(F.lit(" "), F.col("p_brand"), F.lit("  ")).alias("brand"))


@query("b1_nullify_blanks", f"WITH {_DIRTY_SQL} SELECT p_partkey, nullif(trim(name), '') AS name, nullif(trim(brand), '') AS brand FROM dirty")
def b1(spark, sf):
    return cleaning.nullify_blanks(_dirty(spark, sf))


@query("b2_collapse_whitespace", r"""
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (
  SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents)""")
def b2(spark, sf):
    out = cleaning.collapse_text(table(spark, sf, "documents"), ["text"])
    return out.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("b3_null_on_failure_casts", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN TRY_CAST(a AS DOUBLE) ELSE p_size END AS a, TRY_CAST(b AS DOUBLE) AS b FROM (
  SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 20 THEN CAST(p_size AS VARCHAR) || '.0'
      WHEN p_size > 15 THEN CAST(p_size AS VARCHAR) || '.7' ELSE CAST(p_size AS VARCHAR) END AS a,
    CASE WHEN p_size > 40 THEN p_brand ELSE CAST(p_size AS VARCHAR) || '.25' END AS b FROM part)""")
def b3(spark, sf):
    size, as_text = F.col("p_size"), F.col("p_size").cast("string")
    raw = table(spark, sf, "part").select(
        "p_partkey", F.when(size > 25, F.col("p_name")).when(size > 20, F.concat(as_text, F.lit(".0")))
        .when(size > 15, F.concat(as_text, F.lit(".7"))).otherwise(as_text).alias("a"),
        F.when(size > 40, F.col("p_brand")).otherwise(F.concat(as_text, F.lit(".25"))).alias("b"))
    out = cleaning.cast_columns(raw, ["a"], ["b"])
    return out.withColumn("a", F.col("a").cast("double"))


@query("b4_parse_timestamps", """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS parsed FROM orders""")
def b4(spark, sf):
    shown = F.date_format("o_orderdate", N.RAW_TIMESTAMP_PATTERN)
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("on "), shown)).otherwise(shown).alias("parsed"))
    out = cleaning.parse_timestamps(raw, ["parsed"])
    return out.withColumn("parsed", F.col("parsed").cast("timestamp_ntz"))


_RAW_SPEC = cleaning.SilverSpec(
    integers=["line", "quantity"], doubles=["price"], timestamps=["shipped"], text=["flag", "_source_file"],
    watched_gaps=["flag", "shipped"])


def _raw_lines(spark, sf):
    """All-text lines with the faults bronze rows have."""
    c = F.col
    price = (F.rint(c("l_extendedprice") * 100).cast("long") / 100.0).cast("decimal(18,2)").cast("string")
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").cast("string").alias("order_key"),
        F.concat(F.lit(" "), c("l_linenumber").cast("string")).alias("line"),
        F.when(c("l_tax") > 0.065, "many").otherwise(c("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.when(c("l_discount") > 0.095, "n/a").otherwise(price).alias("price"),
        F.when(c("l_discount") < 0.005, "soon").otherwise(F.date_format("l_shipdate", N.RAW_TIMESTAMP_PATTERN)).alias("shipped"),
        F.when(c("l_returnflag") == "R", "  ").otherwise(F.concat(c("l_returnflag"), F.lit("   x "))).alias("flag"),
        F.lit("lines.csv").alias(N.SOURCE_FILE))


_CLEAN_SQL = """clean AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_key, l_linenumber AS line,
  CASE WHEN l_tax <= 0.065 THEN l_quantity END AS quantity,
  CASE WHEN l_discount <= 0.095 THEN l_extendedprice END AS price,
  CASE WHEN l_discount >= 0.005 THEN l_shipdate END AS shipped,
  CASE WHEN l_returnflag <> 'R' THEN l_returnflag || ' x' END AS flag, 'lines.csv' AS _source_file FROM lineitem)"""


@query("b5_clean_silver", f"WITH {_CLEAN_SQL} SELECT * FROM clean")
def b5(spark, sf):
    out = cleaning.clean_silver(_raw_lines(spark, sf), _RAW_SPEC).drop(N.SILVER_TS)
    return out.withColumns({"shipped": F.col("shipped").cast("timestamp_ntz"), "quantity": F.col("quantity").cast("double")})


@query("f8_quality_report", f"""WITH {_CLEAN_SQL},
m AS (SELECT count(*) AS n, count(*) FILTER (line <> 7) AS n_kept, count(*) - count(flag) AS no_flag, count(*) - count(shipped) AS no_ship,
  count(*) - count(quantity) AS bad_q, count(*) - count(price) AS bad_p FROM clean)
SELECT 'bronze_row_count' AS metric_name, CAST(n AS VARCHAR) AS metric_value FROM m
UNION ALL SELECT 'silver_row_count', CAST(n_kept AS VARCHAR) FROM m
UNION ALL SELECT 'dropped_row_count', CAST(n - n_kept AS VARCHAR) FROM m
UNION ALL SELECT 'missing_flag', CAST(no_flag AS VARCHAR) FROM m
UNION ALL SELECT 'missing_shipped', CAST(no_ship AS VARCHAR) FROM m
UNION ALL SELECT 'invalid_integer_cast_line', '0' FROM m
UNION ALL SELECT 'invalid_integer_cast_quantity', CAST(bad_q AS VARCHAR) FROM m
UNION ALL SELECT 'invalid_decimal_cast_price', CAST(bad_p AS VARCHAR) FROM m
UNION ALL SELECT 'invalid_timestamp_parse_shipped', CAST(no_ship AS VARCHAR) FROM m
UNION ALL SELECT 'silver_column_count', '8' FROM m""")
def f8(spark, sf):
    """Measured while a silver table is written that loses the seventh lines."""
    _, report = cleaning.write_silver(_raw_lines(spark, sf), lambda df: materialize(df, "silver"), _RAW_SPEC, keep=F.col("line") != 7)
    return report.select("metric_name", "metric_value")


@query("b6_text_token", f"SELECT doc_id, md5({O.token('text')}) AS token_digest FROM documents")
def b6(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.text_token("text")).alias("token_digest"))


@query("b7_location_token", f"""WITH {O.PLACES}
SELECT s_suppkey, {O.place_token('Order_Country')} AS country, {O.place_token('Order_City')} AS city FROM places""")
def b7(spark, sf):
    sup = table(spark, sf, "supplier")
    names = F.array(*[F.lit(x).cast("string") for x in COUNTRY_NAMES])
    return sup.select("s_suppkey", text.location_token(F.get(names, F.col("s_nationkey"))).alias("country"),
                      text.location_token("s_name").alias("city"))


@query("b8_b9_b11_flags_and_labels", f"""WITH {O.PLACES}
SELECT custkey, CAST(Customer_Zipcode IS NOT NULL AS INT) AS zip_flag,
  CASE WHEN Customer_Country IS NULL OR trim(Customer_Country) = '' THEN 'unknown' ELSE trim(Customer_Country) END AS label,
  CASE WHEN Customer_State = 'ASIA' THEN 1 ELSE 0 END AS same_state
FROM (SELECT c_custkey AS custkey, Customer_Zipcode, Customer_Country, Customer_State FROM people)""")
def b8(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = F.array(*[F.lit(x).cast("string") for x in COUNTRY_NAMES])
    zip_code = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string"))
    return joined.select(
        F.col("c_custkey").alias("custkey"), text.presence_flag(zip_code).alias("zip_flag"),
        text.label_or(F.trim(F.get(names, F.col("c_nationkey"))), "unknown").alias("label"),
        text.equality_flag("r_name", F.lit("ASIA")).alias("same_state"))


@query("b10_composite_keys", f"""SELECT p_partkey,
  concat_ws('_', CAST(p_size AS VARCHAR), {O.token('p_type')}) AS category_key,
  concat_ws('_', CASE WHEN p_size > 10 THEN p_brand END, CAST(p_partkey AS VARCHAR)) AS catalog_key FROM part""")
def b10(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", text.composite_key("p_size", text.text_token("p_type")).alias("category_key"),
        text.composite_key(F.when(F.col("p_size") > 10, F.col("p_brand")), "p_partkey").alias("catalog_key"))


@query("b12_geo_features", f"""WITH {O.PLACES}
SELECT s_suppkey, round(Latitude, 2) AS latitude_rounded, round(Longitude, 2) AS longitude_rounded,
  CAST(Latitude IS NOT NULL AND Longitude IS NOT NULL AS INT) AS geo_coordinates_available,
  CAST(coalesce(Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180, FALSE) AS INT) AS on_map FROM places""")
def b12(spark, sf):
    from ..operators.features import geo_columns
    from ..operators.geography import location_columns

    key = F.col("s_nationkey")
    sup = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(key != 13, key * 7.3125 - 80.0).alias("Latitude"),
        F.when(key != 13, key * 14.125 - 170.0).alias("Longitude"),
        F.lit("x").alias("order_region_normalized"), F.lit("x").alias("order_state_normalized"))
    geo = sup.withColumns(geo_columns())
    return geo.select("s_suppkey", *geo_columns(), location_columns(F.lit("x"))["geo_coordinates_available"].alias("on_map"))


@query("b14_country_labels", f"""WITH {O.PLACES}
SELECT s_suppkey, CASE WHEN Order_Country IS NULL THEN NULL WHEN trim(Order_Country) = '' THEN '' ELSE display_country END AS label
FROM places""")
def b14(spark, sf):
    names = F.array(*[F.lit(x).cast("string") for x in COUNTRY_NAMES])
    return table(spark, sf, "supplier").select(
        "s_suppkey", text.country_label(F.get(names, F.col("s_nationkey"))).alias("label"))


# --- calendar -----------------------------------------------------------------
_EVENT_SQL = """SELECT event_id, CAST(year(ts) AS INT) AS order_year, CAST(quarter(ts) AS INT) AS order_quarter,
  CAST(month(ts) AS INT) AS order_month, CAST(week(ts) AS INT) AS order_week_of_year, CAST(day(ts) AS INT) AS order_day_of_month,
  CAST(dayofweek(ts) + 1 AS INT) AS order_day_of_week, CAST(hour(ts) AS INT) AS order_hour,
  CAST(dayofweek(ts) IN (0, 6) AS INT) AS order_is_weekend,
  CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) < 6 THEN 'spring' WHEN month(ts) < 9 THEN 'summer' ELSE 'fall' END AS order_season
FROM events"""


@query("c1_c2_order_time_features", _EVENT_SQL)
def c1(spark, sf):
    return table(spark, sf, "events").select("event_id", *[e.alias(n) for n, e in calendar.order_time_columns("ts").items()])


@query("c3_c4_period_keys", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS order_date_key,
  CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS order_week_key,
  strftime(o_orderdate, '%Y-%m') AS order_month_key, CAST(date_trunc('week', o_orderdate) AS DATE) AS order_week_start FROM orders""")
def c3(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", *[e.alias(n) for n, e in calendar.period_columns("o_orderdate").items()],
        calendar.week_start("o_orderdate").alias("order_week_start"))


@query("c5_calendar_dimension", """
WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT date, CAST(year(date) AS INT) AS year, 'Q' || quarter(date) AS quarter, CAST(month(date) AS INT) AS month_number,
  strftime(date, '%b') AS month, strftime(date, '%Y-%m') AS year_month, CAST(date_trunc('week', date) AS DATE) AS week_start,
  CAST(1 + (datediff('day', date_trunc('week', date_trunc('year', date)), date)) // 7 AS INT) AS week_number,
  CAST(day(date) AS INT) AS day, CAST(isodow(date) AS INT) AS day_of_week_number, strftime(date, '%a') AS day_of_week FROM d""")
def c5(spark, sf):
    return calendar.calendar_for(table(spark, sf, "orders"), "o_orderdate")


@query("c6_delivery_flags", f"""WITH {O.BASE} SELECT Order_Id, Order_Item_Id, CAST(actual - planned AS DOUBLE) AS delivery_delay_gap,
  1 AS valid_delivery_metric_flag, CAST(actual <= planned AS INT) AS actual_on_time_delivery_flag,
  CAST(actual > planned AS INT) AS actual_late_delivery_flag FROM oi""")
def c6(spark, sf):
    return silver(spark, sf).select(N.ORDER, N.ITEM, *[e.alias(n) for n, e in calendar.delivery_columns().items()])


# --- contracts -----------------------------------------------------------------
@query("d3_d4_rule_violations", f"""WITH {O.BASE}
SELECT 'range_actual' AS rule, count(*) FILTER (NOT actual BETWEEN 0 AND 60) AS violations FROM oi
UNION ALL SELECT 'domain_mode', count(*) FILTER (Shipping_Mode NOT IN ('Same Day', 'First Class')) FROM oi
UNION ALL SELECT 'binary_Late_delivery_risk', 0 FROM (SELECT count(*) FROM oi)
UNION ALL SELECT 'cheap', count(*) FILTER (Order_Item_Total < 1000) FROM oi""")
def d3(spark, sf):
    c = F.col
    rules = {
        "range_actual": ~c("Days_for_shipping_real").between(0, 60),
        "domain_mode": contracts.domain_rules({"Shipping_Mode": ["Same Day", "First Class"]})["domain_Shipping_Mode"],
        **contracts.binary_rules([N.LATE]),
        "cheap": c("Order_Item_Total") < 1000,
    }
    return contracts.rule_violations(silver(spark, sf), rules)


@query("d5_check_contract", f"""WITH {O.BASE}
SELECT * FROM (
SELECT 'missing_column' AS problem, 'Order_Zipcode' AS subject, CAST(1 AS BIGINT) AS violations FROM (SELECT count(*) FROM oi)
UNION ALL SELECT 'forbidden_column', 'Delivery_Status', 1 FROM (SELECT count(*) FROM oi)
UNION ALL SELECT 'wrong_type', 'Order_Item_Total: expected int, found double', 1 FROM (SELECT count(*) FROM oi)
UNION ALL SELECT 'null', 'Delivery_Status', count(*) FILTER (Delivery_Status IS NULL) FROM oi
UNION ALL SELECT 'rule', 'slow', count(*) FILTER (actual > 2000) FROM oi
UNION ALL SELECT 'duplicate_key', 'Order_Id', (SELECT count(*) FROM (SELECT Order_Id FROM oi GROUP BY 1 HAVING count(*) > 1)))
WHERE violations > 0""")
def d5(spark, sf):
    contract = contracts.Contract(
        types={"Order_Item_Total": "int"}, required=["Order_Zipcode"], forbidden=["Delivery_Status"],
        non_null=[*N.KEYS, "Delivery_Status"], unique=[N.ORDER],
        rules={"slow": F.col("Days_for_shipping_real") > 2000, "never": F.col("Order_Item_Quantity") < 0})
    return contracts.check_contract(silver(spark, sf), contract)


@query("d7_vocabulary_violations", """
SELECT 'o_orderstatus' AS column_name, o_orderstatus AS invalid_value, count(*) AS row_count FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 2""")
def d7(spark, sf):
    return vocabulary_violations(
        table(spark, sf, "orders"),
        {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})


_DICT_SQL = """doc AS (SELECT p_name AS column_name, CASE WHEN p_size > 45 THEN 'int' ELSE 'string' END AS data_type, CASE WHEN p_size > 5 THEN 'bronze' ELSE 'silver' END AS source_layer,
  p_type AS source_name, CASE WHEN p_size % 7 > 0 THEN 'use' ELSE ' ' END AS guidance, CASE WHEN p_size % 5 = 0 THEN 'needs_review' WHEN p_size % 3 = 0 THEN 'done' ELSE '' END AS review_status, p_partkey FROM part),
have AS (SELECT p_name || CASE WHEN p_partkey % 50 = 0 THEN '!' ELSE '' END AS column_name FROM part)"""


@query("d7_dictionary_problems", f"""WITH {_DICT_SQL}
SELECT 'undocumented_column' AS problem, column_name AS subject FROM have WHERE column_name NOT IN (SELECT column_name FROM doc)
UNION ALL SELECT 'unexpected_column', column_name FROM doc WHERE column_name NOT IN (SELECT column_name FROM have)
UNION ALL SELECT 'type_mismatch', column_name FROM doc JOIN have USING (column_name) WHERE data_type <> 'string'
UNION ALL SELECT 'no_guidance', column_name FROM doc WHERE trim(guidance) = '' AND review_status = ''
UNION ALL SELECT 'not_screened', column_name FROM doc WHERE source_layer = 'bronze' AND review_status <> 'needs_review' AND source_name NOT IN (SELECT p_type FROM part WHERE p_size < 3)""")
def d7_dictionary(spark, sf):
    """A dictionary made of parts: wrong types, missing notes, unscreened fields and renamed columns are planted."""
    size, part = F.col("p_size"), table(spark, sf, "part")
    doc = part.select(
        F.col("p_name").alias("column_name"), F.when(size > 45, "int").otherwise("string").alias("data_type"),
        F.when(size > 5, "bronze").otherwise("silver").alias("source_layer"), F.col("p_type").alias("source_name"),
        F.when(size % 7 > 0, "use").otherwise(" ").alias("guidance"),
        F.when(size % 5 == 0, "needs_review").when(size % 3 == 0, "done").otherwise("").alias("review_status"))
    have = part.select(F.concat("p_name", F.when(F.col("p_partkey") % 50 == 0, "!").otherwise("")).alias("column_name"), F.lit("string").alias("data_type"))
    return dictionary_problems(doc, have, part.where(size < 3).select(F.col("p_type").alias("variable_name")))


@query("d7_screening_problems", """WITH s AS (SELECT p_name AS variable_name, CASE WHEN p_partkey % 4 = 0 THEN 'engineered' ELSE 'raw' END AS origin, p_partkey,
  CASE WHEN p_size % 3 = 0 THEN 'target' ELSE 'forbidden' END AS policy, CASE WHEN p_size % 2 = 0 THEN 'target_only' ELSE 'dashboard_only' END AS modeling FROM part),
raw AS (SELECT * FROM s WHERE origin = 'raw'), t AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey <= 20), x AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey BETWEEN 21 AND 60)
SELECT 'raw_field_not_screened' AS problem, p_name AS subject FROM part WHERE p_name NOT IN (SELECT variable_name FROM raw)
UNION ALL SELECT 'feature_not_screened', p_name FROM part WHERE p_name NOT IN (SELECT variable_name FROM s WHERE origin = 'engineered')
UNION ALL SELECT 'target_missing', name FROM t WHERE name NOT IN (SELECT variable_name FROM raw)
UNION ALL SELECT 'target_not_marked', name FROM t JOIN raw ON name = variable_name WHERE NOT (policy = 'target' AND modeling = 'target_only')
UNION ALL SELECT 'proxy_missing', name FROM x WHERE name NOT IN (SELECT variable_name FROM raw)
UNION ALL SELECT 'proxy_allowed', name FROM x JOIN raw ON name = variable_name WHERE NOT (policy = 'forbidden' AND modeling = 'dashboard_only')""")
def d7_screening(spark, sf):
    """A screening made of parts: the first twenty are targets, the next forty forbidden proxies."""
    size, key, part = F.col("p_size"), F.col("p_partkey"), table(spark, sf, "part")
    policy, modeling = F.when(size % 3 == 0, "target").otherwise("forbidden"), F.when(size % 2 == 0, "target_only").otherwise("dashboard_only")
    screening = part.select(
        F.col("p_name").alias("variable_name"), F.when(key % 4 == 0, "engineered").otherwise("raw").alias("variable_origin"),
        policy.alias("ao1_policy"), policy.alias("ao2_policy"), modeling.alias("modeling_policy"), F.lit("dashboard_only").alias("dashboard_policy"))
    names = {r["p_partkey"]: r["p_name"] for r in part.where(key <= 60).select("p_partkey", "p_name").collect()}
    targets = {n: "ao1_policy" for k, n in names.items() if k <= 20}
    return screening_problems(
        screening, part.select(F.col("p_name").alias("source_column")),
        part.select(F.col("p_name").alias("variable_name"), F.lit("engineered").alias("variable_origin")),
        targets, sorted({n for k, n in names.items() if k > 20}), raw_origin="raw")


@query("a10_catalog_problems", f"""WITH {_DIRTY_SQL}, named AS (SELECT p_partkey, nullif(trim(name), '') AS name, trim(brand) AS brand FROM dirty)
SELECT 'blank_cell' AS problem, 'name' AS subject, count(*) AS row_count FROM named WHERE name IS NULL HAVING count(*) > 0
UNION ALL SELECT 'duplicate_name', name, count(*) FROM named GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'vocabulary_brand', brand, count(*) FROM named WHERE brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY brand""")
def a10(spark, sf):
    named = cleaning.nullify_blanks(_dirty(spark, sf))
    return catalog_problems(named, unique=["name"], vocabulary={"brand": ["Brand#1", "Brand#2", "Brand#3"]})


@query("f7_null_counts", f"""WITH {O.SCORED}
SELECT 'Delivery_Status' AS column_name, count(*) - count(Delivery_Status) AS null_count FROM seg
UNION ALL SELECT 'ao1_predicted_late_delivery_probability', count(*) - count(p) FROM seg
UNION ALL SELECT 'ao3_predicted_margin', count(*) - count(margin) FROM seg""")
def f7(spark, sf):
    return contracts.null_counts(segments(spark, sf), ["Delivery_Status", N.RISK, N.MARGIN])


@query("f9_cardinality", """
SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS distinct_values FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem""")
def f9(spark, sf):
    return contracts.cardinality(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag", "l_orderkey", "l_shipdate"])


@query("f9_sketched_cardinality", """
SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS distinct_values, TRUE AS within_bounds, count(*) AS row_count FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), TRUE, count(*) FROM lineitem
UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), TRUE, count(*) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), TRUE, count(*) FROM lineitem""")
def f9_sketched(spark, sf):
    """Sketches of single months merged to those of all time, held against the exact counts."""
    columns = ["l_partkey", "l_returnflag", "l_orderkey", "l_shipdate"]
    rows = table(spark, sf, "lineitem")
    monthly = sketches.distinct_sketches(rows.withColumn("month", F.trunc("l_shipdate", "month")), columns, ["month"])
    found = sketches.estimates(sketches.merge_sketches(monthly)).drop("distinct_values", "filled_count")
    inside = F.col("distinct_values").between(F.col("distinct_lower"), F.col("distinct_upper"))
    exact = contracts.cardinality(rows, columns)
    return exact.join(found, "column_name").select("column_name", "distinct_values", inside.alias("within_bounds"), "row_count")


@query("f10_uniqueness", """SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def f10(spark, sf):
    return contracts.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("f10_duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def f10_rows(spark, sf):
    return contracts.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("f6_conditional_counts", f"""WITH {O.SCORED} SELECT Type, count(*) FILTER (risky) AS high_risk,
  count(*) FILTER (segment = 'expedite_selectively') / count(*) AS expedite_share FROM seg GROUP BY Type""")
def f6(spark, sf):
    from ..functions.aggregates import count_where, share_where

    return segments(spark, sf).groupBy("Type").agg(
        count_where(F.col(N.HIGH_RISK)).alias("high_risk"), share_where(F.col(N.SEGMENT) == N.EXPEDITE).alias("expedite_share"))


@query("i1_i2_bands", f"""WITH {O.SCORED} SELECT profit_band, risk_band, risk_order, count(*) AS n FROM (
  SELECT CASE WHEN profit < 0 THEN 'Negative Profit' WHEN profit < 10 THEN '$0 - $10' WHEN profit < 25 THEN '$10 - $25'
      WHEN profit < 50 THEN '$25 - $50' WHEN profit < 100 THEN '$50 - $100' ELSE '$100+' END AS profit_band,
    CASE WHEN p < 0.35 THEN 'Low Risk' WHEN p < 0.65 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_band,
    CASE WHEN p < 0.35 THEN 3 WHEN p < 0.65 THEN 2 ELSE 1 END AS risk_order FROM seg) GROUP BY ALL""")
def i1(spark, sf):
    band = bands.risk_band()
    return segments(spark, sf).groupBy(
        bands.profit_band().alias("profit_band"), band.alias("risk_band"), bands.risk_band_order(band).alias("risk_order")
    ).agg(F.count(F.lit(1)).alias("n"))
