"""Exploratory profiles."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from .. import names as N
from ..operators import contracts, profiling as P, sketches
from . import oracle as O
from .orders import silver, table
from .registry import query, rounded

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _quart(c):
    return f"""SELECT '{c}' AS variable_name, quantile_cont({c} + 0.0, 0) AS mn, quantile_cont({c} + 0.0, 0.25) AS q1, quantile_cont({c} + 0.0, 0.5) AS md,
      quantile_cont({c} + 0.0, 0.75) AS q3, quantile_cont({c} + 0.0, 1) AS mx FROM lineitem"""


_FENCES = "q AS (" + " UNION ALL ".join(_quart(c) for c in _NUM) + """), f AS (SELECT *, q3 - q1 AS iqr, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM q),
v AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS variable_name, {c} + 0.0 AS x FROM lineitem" for c in _NUM) + """),
o AS (SELECT variable_name, count(*) FILTER (x < lo OR x > hi) AS outlier_count, count(*) AS n FROM v JOIN f USING (variable_name) GROUP BY 1)"""


@query("i10_iqr_outliers", f"""WITH {_FENCES} SELECT variable_name, round(q1, 9) AS q1, round(q3, 9) AS q3, round(iqr, 9) AS iqr, round(lo, 9) AS lower_fence,
  round(hi, 9) AS upper_fence, outlier_count, outlier_count / n AS outlier_rate FROM f JOIN o USING (variable_name)""")
def i10(spark, sf):
    return rounded(P.iqr_outliers(table(spark, sf, "lineitem"), _NUM), ["q1", "q3", "iqr", "lower_fence", "upper_fence"], 9)


@query("n1_profile", f"""WITH {_FENCES},
facts AS (SELECT 'numeric' AS status, count(*) AS row_count FROM lineitem)
SELECT variable_name, status, row_count, CAST(0 AS DOUBLE) AS missing_rate, u AS unique_values, round(mn, 9) AS summary_min, round(q1, 9) AS summary_q1, round(md, 9) AS summary_median,
  round(q3, 9) AS summary_q3, round(mx, 9) AS summary_max, NULL AS first_timestamp, NULL AS last_timestamp, CAST(outlier_count AS DOUBLE) AS outlier_count, outlier_count / n AS outlier_rate,
  outlier_count / n > 0.05 AS high_outlier_rate, FALSE AS high_cardinality, FALSE AS high_missingness, u = 1 AS single_value
FROM f JOIN o USING (variable_name) CROSS JOIN facts JOIN (SELECT variable_name, count(DISTINCT x) AS u FROM v GROUP BY 1) USING (variable_name)
UNION ALL SELECT 'l_returnflag', 'categorical', count(*), 0, count(DISTINCT l_returnflag), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, FALSE, FALSE, FALSE FROM lineitem
UNION ALL SELECT 'l_shipdate', 'datetime', count(*), 0, count(DISTINCT l_shipdate), NULL, NULL, NULL, NULL, NULL, CAST(min(l_shipdate) AS VARCHAR), CAST(max(l_shipdate) AS VARCHAR), NULL, NULL,
  FALSE, FALSE, FALSE, FALSE FROM lineitem""")
def n1(spark, sf):
    rows = table(spark, sf, "lineitem")
    rows = rows.withColumns({c: F.col(c) + 0.0 for c in _NUM})
    out = P.profile(rows, [*_NUM, "l_returnflag", "l_shipdate"])
    out = rounded(out, [c for c in out.columns if c.startswith("summary_")], 9)
    return out.withColumns({"outlier_count": F.col("outlier_count").cast("double"),
                            **{c: F.col(c).cast("string") for c in ("first_timestamp", "last_timestamp")}})


@query("n1_sketched_profile", f"""
WITH t AS (SELECT unnest([{", ".join(f"'{c}'" for c in _NUM)}, 'l_returnflag', 'l_shipdate']) AS variable_name),
r AS (SELECT count(*) AS row_count, {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _NUM)},
  CAST(min(l_shipdate) AS VARCHAR) AS first_timestamp, CAST(max(l_shipdate) AS VARCHAR) AS last_timestamp FROM lineitem)
SELECT variable_name, CASE variable_name WHEN 'l_returnflag' THEN 'categorical' WHEN 'l_shipdate' THEN 'datetime' ELSE 'numeric' END AS status,
  row_count, CAST(0 AS DOUBLE) AS missing_rate,
  CASE variable_name {" ".join(f"WHEN '{c}' THEN round(CAST(lo_{c} AS DOUBLE), 9)" for c in _NUM)} END AS summary_min,
  CASE variable_name {" ".join(f"WHEN '{c}' THEN round(CAST(hi_{c} AS DOUBLE), 9)" for c in _NUM)} END AS summary_max,
  CASE WHEN variable_name = 'l_shipdate' THEN first_timestamp END AS first_timestamp,
  CASE WHEN variable_name = 'l_shipdate' THEN last_timestamp END AS last_timestamp,
  TRUE AS unique_within_bounds, TRUE AS quartiles_within_rank
FROM t CROSS JOIN r""")
def n1_sketched(spark, sf):
    """The profile without a shuffle of values; its estimates are held against the exact ones."""
    rows = table(spark, sf, "lineitem")
    rows = rows.withColumns({c: F.col(c) + 0.0 for c in _NUM})
    names, accuracy = [*_NUM, "l_returnflag", "l_shipdate"], 10_000
    exact = contracts.cardinality(rows, names).withColumnRenamed("column_name", "variable_name")
    out = P.sketched_profile(rows, names, accuracy=accuracy)
    # Places of the quartiles among all rows; one struct for each studied column.
    marks = {r[0]: r[1:] for r in out.where("status = 'numeric'").select("variable_name", "summary_q1", "summary_median", "summary_q3").collect()}
    n, slack = F.count(F.lit(1)), 1 + F.count(F.lit(1)) / accuracy
    near = [F.struct(F.lit(c).alias("variable_name"), reduce(and_, [
        (F.count_if(F.col(c) < x) <= p * n + slack) & (F.count_if(F.col(c) <= x) >= p * n - slack)
        for p, x in zip((0.25, 0.5, 0.75), marks[c])]).alias("near")) for c in marks]
    places = rows.agg(F.array(*near).alias("all")).select(F.inline("all"))
    low, high = sketches.bounds(F.col("unique_values"))
    out = out.join(exact, "variable_name").join(places, "variable_name", "left")
    out = out.withColumns({"unique_within_bounds": F.col("distinct_values").between(low, high),
                           "quartiles_within_rank": F.coalesce("near", F.col("status") != "numeric"),
                           "first_timestamp": F.col("first_timestamp").cast("string"),
                           "last_timestamp": F.col("last_timestamp").cast("string")})
    out = rounded(out, ["summary_min", "summary_max"], 9)
    return out.select("variable_name", "status", "row_count", "missing_rate", "summary_min", "summary_max", "first_timestamp",
                      "last_timestamp", "unique_within_bounds", "quartiles_within_rank")


@query("n1_profile_text_columns", """
WITH c AS (SELECT 'shipped' AS variable_name, 'datetime' AS status, strftime(l_shipdate, '%Y-%m-%d') AS v, l_shipdate AS t, NULL AS x FROM lineitem
  UNION ALL SELECT 'quantity', 'numeric', CASE WHEN l_discount > 0.095 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END, NULL, CASE WHEN l_discount > 0.095 THEN NULL ELSE l_quantity END FROM lineitem
  UNION ALL SELECT 'flag', 'categorical', CASE WHEN l_discount > 0.085 THEN NULL ELSE l_returnflag END, NULL, NULL FROM lineitem)
SELECT variable_name, status, count(*) AS row_count, (count(*) - count(v)) / count(*) AS missing_rate, count(DISTINCT v) AS unique_values, quantile_cont(x, 0.5) AS summary_median,
  CAST(min(t) AS VARCHAR) AS first_timestamp, variable_name = 'flag' AND (count(*) - count(v)) / count(*) > 0.1 AS high_missingness FROM c GROUP BY 1, 2""")
def n1_text(spark, sf):
    c = F.col
    raw = table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
        F.when(c("l_discount") <= 0.095, c("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.when(c("l_discount") <= 0.085, c("l_returnflag")).alias("flag"))
    out = P.profile(raw)
    return out.select("variable_name", "status", "row_count", "missing_rate", "unique_values", "summary_median",
                      c("first_timestamp").cast("string").alias("first_timestamp"), "high_missingness")


@query("n2_monthly_counts", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS row_count FROM events GROUP BY 1")
def n2(spark, sf):
    return P.monthly_counts(table(spark, sf, "events"), "ts")


def _levels(cols, extra):
    return " UNION ALL ".join(f"SELECT '{n}' AS variable_name, CAST({e} AS VARCHAR) AS level, {extra} FROM oi" for n, e in cols.items())


_CATS = {"Shipping_Mode": "Shipping_Mode", "Type": "Type", "Delivery_Status": "coalesce(Delivery_Status, '(missing)')", "Order_Item_Quantity": "qty"}
_RATES = f"""WITH {O.BASE}, l AS ({_levels(_CATS, "Late_delivery_risk AS y")}),
g AS (SELECT variable_name, level, count(*) AS row_count, CAST(sum(y) AS BIGINT) AS late FROM l GROUP BY 1, 2),
t AS (SELECT count(*) AS n, CAST(sum(Late_delivery_risk) AS BIGINT) AS late_all, greatest(100, ceil(count(*) * 0.005)) AS support FROM oi),
r AS (SELECT variable_name, level, row_count, late / row_count AS late_delivery_rate, late / row_count - late_all / n AS late_delivery_rate_difference, row_count >= support AS supported FROM g CROSS JOIN t)"""


@query("n3_bivariate_rate", _RATES + " SELECT *, count(*) OVER w AS level_count, count(*) OVER w > 75 AS high_cardinality FROM r WINDOW w AS (PARTITION BY variable_name)")
def n3(spark, sf):
    return P.bivariate_rate(silver(spark, sf), list(_CATS))


@query("n3_bivariate_rate_summary", _RATES + """ SELECT variable_name, count(*) AS level_count, count(*) > 75 AS high_cardinality, count(*) FILTER (supported) AS supported_levels,
  count(*) FILTER (NOT supported) AS unsupported_levels, max_by(level, late_delivery_rate) FILTER (supported) AS highest_level, min_by(level, late_delivery_rate) FILTER (supported) AS lowest_level,
  max_by(level, abs(late_delivery_rate_difference)) FILTER (supported) AS strongest_level,
  max_by(late_delivery_rate_difference, abs(late_delivery_rate_difference)) FILTER (supported) AS strongest_difference FROM r GROUP BY 1""")
def n3_summary(spark, sf):
    return P.bivariate_rate_summary(silver(spark, sf), list(_CATS))


_NUMS = {"Order_Item_Quantity": "CAST(qty AS DOUBLE)", "Order_Item_Total": "CAST(Order_Item_Total AS DOUBLE)", "Days_for_shipment_scheduled": "CAST(planned AS DOUBLE)"}


def _binned(extra):
    """Right-closed quantile bins of each numeric column; the scheduled days have only four values."""
    parts = []
    for n, e in _NUMS.items():
        k = 4 if n.startswith("Days") else 5
        edges = ", ".join(f"quantile_cont({e}, {i / k!r})" for i in range(k + 1))
        parts.append(f"""SELECT '{n}' AS variable_name, {extra}, {e} AS value, (SELECT list_sort(list_distinct([{edges}])) FROM oi) AS edges FROM oi""")
    return f"""u AS ({' UNION ALL '.join(parts)}),
bn AS (SELECT *, 1 + len(list_filter(edges[2:len(edges) - 1], lambda x: value > x)) AS bin_number FROM u),
bb AS (SELECT *, edges[bin_number] AS bin_lower, edges[bin_number + 1] AS bin_upper FROM bn)"""


@query("n4_i7_bivariate_rate_numeric", f"""WITH {O.BASE}, {_binned("Late_delivery_risk AS y")},
t AS (SELECT count(*) AS n, CAST(sum(Late_delivery_risk) AS BIGINT) AS late_all, greatest(100, ceil(count(*) * 0.005)) AS support FROM oi)
SELECT variable_name, bin_number, round(bin_lower, 7) AS bin_lower, round(bin_upper, 7) AS bin_upper, count(*) AS row_count, CAST(sum(y) AS BIGINT) / count(*) AS late_delivery_rate,
  CAST(sum(y) AS BIGINT) / count(*) - max(late_all) / max(n) AS late_delivery_rate_difference, count(*) >= max(support) AS supported FROM bb CROSS JOIN t GROUP BY 1, 2, 3, 4""")
def n4(spark, sf):
    return rounded(P.bivariate_rate_numeric(silver(spark, sf), list(_NUMS)), ["bin_lower", "bin_upper"], 7)


@query("n4_class_location", f"""WITH {O.BASE}, u AS ({" UNION ALL ".join(f"SELECT '{n}' AS variable_name, Late_delivery_risk, {e} AS v FROM oi" for n, e in _NUMS.items())})
SELECT variable_name, Late_delivery_risk, count(*) AS row_count, round(avg(v), 7) AS mean_value, quantile_cont(v, 0.5) AS median_value FROM u GROUP BY 1, 2""")
def n4_location(spark, sf):
    return rounded(P.class_location(silver(spark, sf), list(_NUMS)), ["mean_value"], 7)


_OVER = """o AS (SELECT count(*) AS n, avg(CAST(Order_Profit_Per_Order AS DOUBLE)) AS m, quantile_cont(CAST(Order_Profit_Per_Order AS DOUBLE), 0.5) AS md FROM oi)"""
_DIFFS = """round(avg(y), 7) AS mean_profit, round(quantile_cont(y, 0.5), 7) AS median_profit, round(avg(y) - max(m), 7) AS profit_difference_from_overall_mean,
  round(quantile_cont(y, 0.5) - max(md), 7) AS profit_difference_from_overall_median"""
_DCOLS = ["mean_profit", "median_profit", "profit_difference_from_overall_mean", "profit_difference_from_overall_median"]


@query("n5_bivariate_mean", f"""WITH {O.BASE}, l AS ({_levels(_CATS, "CAST(Order_Profit_Per_Order AS DOUBLE) AS y")}), {_OVER}
SELECT variable_name, level, count(*) AS row_count, {_DIFFS}, CASE WHEN count(*) >= greatest(100, ceil(max(n) * 0.005)) THEN 'support_ok' ELSE 'below_min_support' END AS sample_size_flag,
  count(*) OVER (PARTITION BY variable_name) AS level_count, count(*) OVER (PARTITION BY variable_name) > 75 AS high_cardinality
FROM l CROSS JOIN o GROUP BY 1, 2""")
def n5(spark, sf):
    return rounded(P.bivariate_mean(silver(spark, sf), list(_CATS)), _DCOLS, 7)


@query("n6_bivariate_mean_numeric", f"""WITH {O.BASE}, {_binned("CAST(Order_Profit_Per_Order AS DOUBLE) AS y")}, {_OVER},
g AS (SELECT variable_name, bin_number, round(bin_lower, 7) AS bin_lower, round(bin_upper, 7) AS bin_upper, count(*) AS row_count, avg(y) AS raw_mean, {_DIFFS}, CASE WHEN count(*) >= greatest(100, ceil(max(n) * 0.005)) THEN 'support_ok' ELSE 'below_min_support' END AS sample_size_flag
  FROM bb CROSS JOIN o GROUP BY 1, 2, 3, 4),
k AS (SELECT variable_name, bin_number, raw_mean - lag(raw_mean) OVER (PARTITION BY variable_name ORDER BY bin_number) AS d, 1 AS ok FROM g WHERE sample_size_flag = 'support_ok'),
s AS (SELECT * FROM g LEFT JOIN k USING (variable_name, bin_number))
SELECT * EXCLUDE (raw_mean, d, ok), CASE WHEN count(ok) OVER w < 3 THEN 'too few bins for monotonicity comment' WHEN min(d) OVER w >= 0 AND max(d) OVER w > 0 THEN 'mean profit increases across supported bins'
  WHEN max(d) OVER w <= 0 AND min(d) OVER w < 0 THEN 'mean profit decreases across supported bins' ELSE 'nonlinear or uneven bin pattern' END AS monotonic_pattern
FROM s WINDOW w AS (PARTITION BY variable_name)""")
def n6(spark, sf):
    return rounded(P.bivariate_mean_numeric(silver(spark, sf), list(_NUMS)), [*_DCOLS, "bin_lower", "bin_upper"], 7)


_DIST = ["mean_profit", "std_profit", "min_profit", "max_profit", "skewness", "p01", "p05", "p25", "p50", "p75", "p95", "p99"]


@query("n7_target_distribution", f"""WITH {O.BASE}, y AS (SELECT CAST(Order_Profit_Per_Order AS DOUBLE) AS y FROM oi),
d AS (SELECT count(y) AS row_count, count(*) - count(y) AS missing_count, avg(y) AS mean_profit, stddev_samp(y) AS std_profit, min(y) AS min_profit, max(y) AS max_profit, skewness(y) AS skewness,
  {", ".join(f"quantile_cont(y, {p}) AS p{n}" for n, p in (("01", 0.01), ("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95), ("99", 0.99)))} FROM y)
SELECT row_count, missing_count, {", ".join(f"round({c}, 6) AS {c}" for c in _DIST)},
  (SELECT count(*) FROM y WHERE y < p25 - (p75 - p25) * 1.5 OR y > p75 + (p75 - p25) * 1.5) AS outlier_count FROM d""")
def n7(spark, sf):
    return rounded(P.target_distribution(silver(spark, sf)), _DIST, 6)


@query("n8_proxy_audit", f"""WITH {O.BASE} SELECT count(*) AS compared_rows, count(*) FILTER (tax <> 3) / count(*) AS exact_match_rate, CAST(0.5 AS DOUBLE) AS max_absolute_difference FROM oi""")
def n8(spark, sf):
    return rounded(P.proxy_audit(silver(spark, sf), N.PROFIT, "Benefit_per_order"), ["max_absolute_difference"], 9)


@query("n9_imbalance_summary", f"""WITH {O.BASE}, t AS (SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS missing_target_count, count(*) FILTER (Late_delivery_risk = 1) AS count_late_1,
  count(*) FILTER (Late_delivery_risk = 0) AS count_not_late_0 FROM oi)
SELECT *, count_late_1 + count_not_late_0 AS rows_with_valid_binary_target, count_late_1 / total_rows AS late_delivery_rate, count_not_late_0 / total_rows AS not_late_rate,
  CASE WHEN count_late_1 >= count_not_late_0 THEN 'late_1' ELSE 'not_late_0' END AS majority_class, CASE WHEN count_late_1 >= count_not_late_0 THEN 'not_late_0' ELSE 'late_1' END AS minority_class,
  greatest(count_late_1, count_not_late_0) / least(count_late_1, count_not_late_0) AS majority_minority_class_ratio,
  CASE WHEN greatest(count_late_1, count_not_late_0) / least(count_late_1, count_not_late_0) < 1.5 THEN 'mild' WHEN greatest(count_late_1, count_not_late_0) / least(count_late_1, count_not_late_0) < 3 THEN 'moderate' ELSE 'severe' END AS imbalance_severity,
  CAST(greatest(100, ceil(total_rows * 0.005)) AS BIGINT) AS minimum_slice_support FROM t""")
def n9(spark, sf):
    return P.imbalance_summary(silver(spark, sf))


@query("n10_imbalance_slices", f"""WITH {O.BASE}, l AS ({_levels(_CATS, "Late_delivery_risk AS y")}),
t AS (SELECT count(*) AS n, CAST(sum(Late_delivery_risk) AS BIGINT) AS late_all, CAST(greatest(100, ceil(count(*) * 0.005)) AS BIGINT) AS support FROM oi)
SELECT variable_name AS grouping_variable, level AS group_value, count(*) AS row_count, CAST(sum(y) AS BIGINT) AS late_count, count(*) - CAST(sum(y) AS BIGINT) AS not_late_count,
  CAST(sum(y) AS BIGINT) / count(*) AS late_delivery_rate, CAST(sum(y) AS BIGINT) / count(*) - max(late_all) / max(n) AS difference_from_overall_rate,
  CASE WHEN count(*) >= max(support) THEN 'meets_min_support' ELSE 'below_min_support_' || CAST(max(support) AS VARCHAR) || '_rows' END AS sample_size_flag FROM l CROSS JOIN t GROUP BY 1, 2""")
def n10(spark, sf):
    return P.imbalance_slices(silver(spark, sf), list(_CATS))


_CATALOG = [
    ("Shipping_Mode", "allowed", "allowed", "approved", "candidate_feature", "allowed", "yes"),
    ("Type", "conditional", "allowed", "needs_group_review", "candidate_feature", "allowed", "yes"),
    ("Delivery_Status", "forbidden", "forbidden", "excluded", "dashboard_only", "dashboard_only", "no"),
    ("Order_Item_Quantity", "allowed", "allowed", "approved", "candidate_feature", "allowed", "yes"),
]


@query("n11_annotate_policy", _RATES + """, x AS (SELECT DISTINCT variable_name FROM r)
SELECT variable_name, (SELECT count(*) FROM r WHERE r.variable_name = x.variable_name) AS level_count,
  CASE variable_name WHEN 'Delivery_Status' THEN 'dashboard_only' WHEN 'Type' THEN 'conditional_requires_group_review' ELSE 'candidate_for_gold_review' END AS late_recommendation,
  CASE variable_name WHEN 'Delivery_Status' THEN 'dashboard_only' WHEN 'Type' THEN 'conditional_requires_group_review'
    WHEN 'Order_Item_Quantity' THEN 'conditional_requires_group_review' ELSE 'candidate_for_gold_review' END AS profit_recommendation FROM x""")
def n11(spark, sf):
    catalog = spark.createDataFrame(
        _CATALOG, "variable_name STRING, ao1_policy STRING, ao2_policy STRING, screening_status STRING, "
        "modeling_policy STRING, dashboard_policy STRING, decision_time_availability STRING")
    profiled = P.bivariate_rate_summary(silver(spark, sf), [c[0] for c in _CATALOG]).select("variable_name", "level_count")
    late = P.annotate_late_policy(profiled, catalog).select("variable_name", "level_count", F.col("recommendation").alias("late_recommendation"))
    profit = P.annotate_profit_policy(profiled, catalog).select("variable_name", F.col("recommendation").alias("profit_recommendation"))
    return late.join(profit, "variable_name")
