"""The steps around the models against reference SQL.

Encoding, selection, ranking, prediction tables, held-out scores, attributions and cluster
reports are checked over all order items, with deterministic stand-ins where the
product's own query takes a fitted model.  Fits are checked by what their solution must
satisfy: a closed form or first-order conditions.
"""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from .. import names as N
from ..operators import attribution as A, clustering as C, modeling as L, split
from ..session import materialize
from ..sources import files
from . import oracle as O
from .orders import _money, risk_units, second_risk_units, segments, silver, table, with_scores
from .q_evaluation import _SCORES
from .registry import query, rounded

_NUMBERED = f"""WITH {O.SCORED}, num AS (SELECT *, row_number() OVER (ORDER BY order_date_DateOrders, Order_Id, Order_Item_Id) AS rn, count(*) OVER () AS n FROM seg),
dev AS (SELECT *, CASE WHEN rn <= floor(floor(n * 0.8) * 0.8) THEN 'inner_train' ELSE 'inner_validation' END AS slice FROM num WHERE rn <= floor(n * 0.8))"""


@query("l2_partition_usage", _NUMBERED + " SELECT DISTINCT CASE WHEN rn <= floor(n * 0.8) THEN 'development' ELSE 'test' END AS split_partition, rn <= floor(n * 0.8) AS fit_on FROM num")
def l2(spark, sf):
    rows = split.chronological_split(silver(spark, sf).select(*N.KEYS))
    fit_on = split.partition_usage(rows)["fit_on"]
    return rows.select(N.SPLIT, (F.col(N.SPLIT) == fit_on).alias("fit_on")).distinct()


@query("a3_column_mapping", """SELECT CAST(row_number() OVER () AS INT) AS ordinal_position, column_name AS bronze_column_name,
  upper(substr(column_name, 1, 1)) || ' ' || substr(column_name, 3) AS source_column_name, FALSE AS kept FROM (DESCRIBE lineitem)""")
def a3(spark, sf):
    lines = table(spark, sf, "lineitem")
    spaced = lines.toDF(*[f"{c[0].upper()} {c[2:]}" for c in lines.columns])
    out = files.column_mapping(spaced)
    return out.select("ordinal_position", F.lower("bronze_column_name").alias("bronze_column_name"), "source_column_name", (~F.col("was_renamed")).alias("kept"))


_GROUPS = L.FeatureGroups(numeric=["quantity", "planned"], binary=["filled"], categorical=["Shipping_Mode"])


@query("l1_encoding_by_slice", _NUMBERED + """, f AS (SELECT slice, CAST(qty AS DOUBLE) AS quantity, CASE WHEN qty <> 13 THEN CAST(planned AS DOUBLE) END AS planned, CAST(line = 'F' AS DOUBLE) AS filled, Shipping_Mode FROM dev),
md AS (SELECT quantile_disc(planned, 0.5) AS m FROM f WHERE slice = 'inner_train'),
g AS (SELECT slice, quantity, coalesce(planned, m) AS planned, filled, Shipping_Mode FROM f CROSS JOIN md),
st AS (SELECT avg(quantity) AS qm, stddev_pop(quantity) AS qs, avg(planned) AS pm, stddev_pop(planned) AS ps FROM g WHERE slice = 'inner_train'),
v AS (SELECT * FROM g CROSS JOIN st WHERE slice = 'inner_validation')
SELECT 'numeric_continuous__quantity' AS feature_name, round(avg((quantity - qm) / qs), 7) AS mean_value FROM v
UNION ALL SELECT 'numeric_continuous__planned', round(avg((planned - pm) / ps), 7) FROM v UNION ALL SELECT 'binary_flags__filled', round(avg(filled), 7) FROM v
UNION ALL SELECT 'categorical__Shipping_Mode_' || t.Shipping_Mode, round(CAST(count(*) FILTER (v.Shipping_Mode = t.Shipping_Mode) AS DOUBLE) / count(*), 7)
  FROM (SELECT DISTINCT Shipping_Mode FROM g WHERE slice = 'inner_train') t CROSS JOIN v GROUP BY t.Shipping_Mode""")
def l1(spark, sf):
    """Imputed, scaled and encoded on the training slice, means over the validation slice."""
    c = F.col
    rows = silver(spark, sf).select(
        *N.KEYS, c("Order_Item_Quantity").cast("double").alias("quantity"), c("Product_Status").cast("double").alias("filled"), "Shipping_Mode",
        F.when(c("Order_Item_Quantity") != 13, c("Days_for_shipment_scheduled").cast("double")).alias("planned"))
    rows = split.inner_split(split.chronological_split(rows))
    pre = L.fit_preprocessor(rows.where(c("modeling_slice") == N.INNER_TRAIN), _GROUPS)
    validation = L.transform(pre, rows.where(c("modeling_slice") == N.INNER_VALIDATION), _GROUPS)
    means = validation.select(F.posexplode(vector_to_array(Summarizer.mean(c(L.FEATURES)))).alias("slot", "mean_value"))
    named = spark.createDataFrame(list(enumerate(L.feature_names(pre, _GROUPS))), "slot INT, feature_name STRING")
    return rounded(means.join(named, "slot").select("feature_name", "mean_value"), ["mean_value"], 7)


def _signals(spark, sf, target):
    """Two raw predictors as the feature vector.  A fit reads its rows several times, so they are joined once and stored."""
    rows = silver(spark, sf).select(
        F.col("Order_Item_Quantity").cast("double").alias("a"), F.col("_tax").cast("double").alias("b"), F.col(target).cast("double").alias(target))
    return VectorAssembler(inputCols=["a", "b"], outputCol=L.FEATURES).transform(materialize(rows, "signals"))


@query("l7_ridge_closed_form", f"""WITH {O.BASE}, x AS (SELECT CAST(qty AS DOUBLE) AS a, CAST(tax AS DOUBLE) AS b, CAST(Order_Profit_Per_Order AS DOUBLE) AS y FROM oi),
s AS (SELECT count(*) AS n, var_pop(a) * count(*) + 1000 AS aa, var_pop(b) * count(*) + 1000 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy FROM x)
SELECT 'a' AS feature_name, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 5) AS coefficient FROM s
UNION ALL SELECT 'b', round((byy * aa - ay * ab) / (aa * bb - ab * ab), 5) FROM s""")
def l7(spark, sf):
    """Ridge with a penalty of 1000 on two predictors: the normal equations in SQL."""
    model = L.fit_ridge(_signals(spark, sf, N.PROFIT), alpha=1000.0)
    return rounded(L.coefficients(spark, model, ["a", "b"]).select("feature_name", "coefficient"), ["coefficient"], 5)


@query("l3_feature_group_problems", """WITH g AS (SELECT DISTINCT p_brand AS treatment, p_type || '_' || p_size % 9 AS feature_name FROM part),
ok AS (SELECT DISTINCT p_type || '_' || p_size % 11 AS feature_name FROM part WHERE p_size > 5), bad AS (SELECT DISTINCT lower(p_type || '_' || p_size % 9) AS low FROM part WHERE p_retailprice > 1900),
n AS (SELECT feature_name, string_agg(treatment, ', ' ORDER BY treatment) AS detail, count(*) AS c FROM g GROUP BY 1)
SELECT 'in several groups' AS problem, feature_name, detail FROM n WHERE c > 1 UNION ALL SELECT 'not grouped', feature_name, '' FROM ok ANTI JOIN n USING (feature_name)
UNION ALL SELECT 'not approved', feature_name, '' FROM n ANTI JOIN ok USING (feature_name) UNION ALL SELECT 'forbidden', feature_name, '' FROM n SEMI JOIN bad ON bad.low = lower(feature_name)""")
def l3(spark, sf):
    """Part types stand in for features, brands for treatments."""
    name = lambda m: F.concat(F.col("p_type"), F.lit("_"), (F.col("p_size") % m).cast("string")).alias("feature_name")
    part = table(spark, sf, "part")
    listed = part.select(F.col("p_brand").alias("treatment"), name(9))
    return L.feature_group_problems(listed, part.where("p_size > 5").select(name(11)), part.where("p_retailprice > 1900").select(F.upper(name(9)).alias("feature_name")))


@query("l5_coefficient_table", """WITH c AS (SELECT 'f' || p_partkey AS feature_name, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE (p_size - 25) * (p_partkey % 37) END AS DOUBLE) AS coefficient FROM part)
SELECT feature_name, coefficient, abs(coefficient) AS absolute_coefficient, round(ln(exp(greatest(least(coefficient, 700), -700))), 6) AS log_odds,
  CASE WHEN coefficient > 0 THEN 'positive' WHEN coefficient < 0 THEN 'negative' ELSE 'neutral' END AS direction, row_number() OVER (ORDER BY abs(coefficient) DESC, feature_name) AS coefficient_rank FROM c""")
def l5(spark, sf):
    """Odds ratios (by their logarithm, as they span 600 orders of magnitude), direction and rank of given coefficients."""
    key = F.col("p_partkey")
    value = F.when(key % 10 == 0, 0).otherwise((F.col("p_size") - 25) * (key % 37)).cast("double")
    out = L.coefficient_table(table(spark, sf, "part").select(F.concat(F.lit("f"), key.cast("string")).alias("feature_name"), value.alias("coefficient")))
    return out.withColumn("log_odds", F.round(F.ln("odds_ratio"), 6) + 0.0).drop("odds_ratio")


@query("l4_first_order_conditions", """SELECT f AS feature_name, CAST(0 AS DOUBLE) AS gradient, count(*) AS row_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN (SELECT unnest(['a', 'b', 'intercept']) AS f) GROUP BY f""")
def l4(spark, sf):
    """At the fitted coefficients the penalized, class-balanced loss is flat: its gradient per row, to three decimals."""
    rows = _signals(spark, sf, N.LATE)
    model = L.fit_logistic(rows, c=1.0)
    weighted = L.balanced_weights(rows)
    w = [float(x) for x in model.coefficients]
    error = F.col("class_weight") * (1.0 / (1.0 + F.exp(-(F.lit(float(model.intercept)) + F.lit(w[0]) * F.col("a") + F.lit(w[1]) * F.col("b")))) - F.col(N.LATE))
    n = F.count(F.lit(1))
    sums = weighted.agg(
        ((F.sum(error * F.col("a")) + w[0]) / n).alias("a"), ((F.sum(error * F.col("b")) + w[1]) / n).alias("b"),
        (F.sum(error) / n).alias("intercept"), n.alias("row_count"))
    shown = sums.select("row_count", F.inline(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("gradient")) for f in ("a", "b", "intercept")])))
    return shown.select("feature_name", (F.round("gradient", 3) + 0.0).alias("gradient"), "row_count")


def _late_candidates(spark, sf):
    scores = {"one": _money(risk_units()), "two": _money(second_risk_units()), "three": F.lit(0.5)}
    return silver(spark, sf).select(*N.KEYS, N.LATE, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_name"), p.alias("predicted_probability")) for m, p in scores.items()])))


@query("l6_candidate_selection", _SCORES.replace("),\nu AS", """ UNION ALL SELECT 'three', 0.5, count(*) FILTER (Late_delivery_risk = 1), count(*) FILTER (Late_delivery_risk = 0) FROM oi),
u AS""") + """, auc AS (SELECT CASE model_name WHEN 'ao1_xgboost_classifier' THEN 'one' WHEN 'three' THEN 'three' ELSE 'two' END AS candidate_id,
  CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (CAST(2 AS DOUBLE) * max(np) * max(nn)) AS roc_auc, CAST(sum(pos) FILTER (score >= 0.5) AS DOUBLE) / max(np) AS recall FROM u GROUP BY 1)
SELECT candidate_id, round(roc_auc, 9) AS roc_auc, round(coalesce(recall, 0), 9) AS recall,
  row_number() OVER (ORDER BY roc_auc DESC, recall DESC, list_position(['one', 'two', 'three'], candidate_id)) = 1 AS selected FROM auc""")
def l6(spark, sf):
    out = L.select_candidate(_late_candidates(spark, sf), N.LATE, ["one", "two", "three"])
    return rounded(out.select("candidate_id", "roc_auc", "recall", "selected"), ["roc_auc", "recall"], 9)


@query("l8_candidate_selection", f"""WITH {O.BASE}, c AS (SELECT CAST(Order_Profit_Per_Order AS DOUBLE) AS y, unnest(['one', 'two', 'three']) AS candidate_id,
  unnest([profit_u / 10000.0, (profit_u // 2 + 50000) / 10000.0, CAST(12.5 AS DOUBLE)]) AS f FROM oi),
m AS (SELECT candidate_id, sqrt(avg((y - f) * (y - f))) AS rmse, avg(abs(y - f)) AS mae FROM c GROUP BY 1)
SELECT candidate_id, round(rmse, 6) AS rmse, round(mae, 6) AS mae, row_number() OVER (ORDER BY rmse, mae, list_position(['one', 'two', 'three'], candidate_id)) = 1 AS selected FROM m""")
def l8(spark, sf):
    guesses = {"one": _money(F.col("_profit")), "two": _money(F.expr("_profit div 2") + 50000), "three": F.lit(12.5)}
    rows = silver(spark, sf).select(*N.KEYS, N.PROFIT, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_name"), p.alias("predicted_profit")) for m, p in guesses.items()])))
    out = L.select_candidate(rows, N.PROFIT, ["one", "two", "three"])
    return rounded(out.select("candidate_id", "rmse", "mae", "selected"), ["rmse", "mae"], 6)


@query("l9_g10_ranked_importance", """WITH i AS (SELECT p_type || '_' || p_brand AS feature_name, CAST(sum(p_size) AS DOUBLE) AS importance_value FROM part GROUP BY 1)
SELECT feature_name, importance_value, importance_value / sum(importance_value) OVER () AS importance_share, row_number() OVER (ORDER BY importance_value DESC, feature_name) AS importance_rank FROM i""")
def l9(spark, sf):
    given = table(spark, sf, "part").groupBy(F.concat_ws("_", "p_type", "p_brand").alias("feature_name")).agg(F.sum("p_size").cast("double").alias("importance_value"))
    return L.rank_importance(given)


class _StandIn:
    """A model whose predictions are a given expression."""

    def __init__(self, name, value):
        self.name, self.value = name, value

    def transform(self, df):
        return df.withColumn(self.name, self.value)


@query("l10_prediction_table", _NUMBERED + """ SELECT 'ao2_ridge_baseline' AS model_name, 'development_' || slice AS evaluation_slice, Order_Id, Order_Item_Id, order_date_DateOrders, rn AS chronological_row_number,
  'development' AS split_partition, CAST(Order_Profit_Per_Order AS DOUBLE) AS Order_Profit_Per_Order, profit_u / 10000.0 AS predicted_profit,
  CAST(Order_Profit_Per_Order AS DOUBLE) - profit_u / 10000.0 AS residual, abs(CAST(Order_Profit_Per_Order AS DOUBLE) - profit_u / 10000.0) AS absolute_error FROM dev WHERE slice = 'inner_validation'""")
def l10(spark, sf):
    rows = split.inner_split(split.chronological_split(silver(spark, sf).select(*N.KEYS, N.PROFIT, "_profit")))
    validation = rows.where(F.col("modeling_slice") == N.INNER_VALIDATION)
    return L.prediction_rows(_StandIn("prediction", _money(F.col("_profit"))), validation, N.PROFIT, "ao2_ridge_baseline")


@query("l11_integrated_scores", _NUMBERED + """ SELECT Order_Id, Order_Item_Id, rn AS chronological_row_number, CAST(p AS DOUBLE) AS p, p >= 0.35 AS high_risk, CAST(profit AS DOUBLE) AS expected_profit,
  CAST(value AS DOUBLE) AS order_value, round(margin_d, 9) AS margin FROM num WHERE rn > floor(n * 0.8) AND p IS NOT NULL""")
def l11(spark, sf):
    """Held-out scores of both objectives, joined one to one, with the margin."""
    rows = split.chronological_split(with_scores(silver(spark, sf)).select(*N.KEYS, N.RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE))
    rows = rows.where((F.col(N.SPLIT) == N.TEST) & F.col(N.RISK).isNotNull()).withColumnsRenamed({N.RISK: "_p", N.EXPECTED_PROFIT: "_f"})
    late = L.score_late(_StandIn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))), rows, "one", N.RISK_CUTOFF)
    profit = L.score_profit(_StandIn("prediction", F.col("_f")), rows, "two")
    out = L.integrate_scores(late, profit)
    return out.select(
        N.ORDER, N.ITEM, N.ROW_NUMBER, F.col(N.RISK).alias("p"), F.col(N.HIGH_RISK).alias("high_risk"),
        F.col(N.EXPECTED_PROFIT).alias("expected_profit"), F.col(N.ORDER_VALUE).cast("double").alias("order_value"), F.round(N.MARGIN, 9).alias("margin"))


class _Weights:
    coefficients = (0.5, -2.0)


@query("l12_linear_contributions", f"""WITH {O.BASE}, m AS (SELECT avg(qty) AS qm, avg(tax) AS tm FROM oi),
c AS (SELECT 'a' AS feature_name, 0.5 * (qty - qm) AS v FROM oi CROSS JOIN m UNION ALL SELECT 'b', -2.0 * (tax - tm) FROM oi CROSS JOIN m),
s AS (SELECT feature_name, avg(abs(v)) AS mean_abs, count(*) AS sample_size FROM c GROUP BY 1)
SELECT feature_name, round(mean_abs, 7) AS mean_abs_contribution, sample_size, round(mean_abs / sum(mean_abs) OVER (), 7) AS importance_share, row_number() OVER (ORDER BY mean_abs DESC, feature_name) AS rank FROM s""")
def l12(spark, sf):
    out = A.linear_attribution(_Weights, _signals(spark, sf, N.PROFIT), ["a", "b"])
    return rounded(out.select("feature_name", "mean_abs_contribution", "sample_size", "importance_share", "rank"), ["mean_abs_contribution", "importance_share"], 7)


_DRIVERS = {
    # Name form of a part -> (policy status, review decision) that the rules must give.
    "numeric_continuous__item_unit_price": ("caution", "accepted_with_caution"), "numeric_continuous__order_hour": ("allowed", "accepted"),
    "numeric_continuous__Order Profit Per Order": ("forbidden", "blocked"), "categorical__order_country_normalized_spain": ("caution", "accepted_with_caution"),
    "binary_flags__order_is_weekend": ("allowed", "accepted"), "x__my_realized_profit_2": ("forbidden", "blocked"),
}


@query("l13_policy_rules", f"""WITH d AS (SELECT p_partkey, [{", ".join(f"'{k}'" for k in _DRIVERS)}][1 + p_partkey % {len(_DRIVERS)}] AS feature_name FROM part)
SELECT p_partkey, feature_name,
  CASE WHEN regexp_matches(lower(feature_name), 'profit.per.order|realized_profit') THEN 'forbidden' WHEN regexp_matches(feature_name, 'item_unit_price|country') THEN 'caution' ELSE 'allowed' END AS policy_status,
  CASE WHEN regexp_matches(lower(feature_name), 'profit.per.order|realized_profit') THEN 'blocked' WHEN regexp_matches(feature_name, 'item_unit_price|country') THEN 'accepted_with_caution' ELSE 'accepted' END AS review_decision FROM d""")
def l13(spark, sf):
    names = F.array(*[F.lit(k) for k in _DRIVERS])
    rows = table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_DRIVERS)).cast("int")).alias("feature_name"))
    return A.classify_drivers(rows, L.PROFIT_GROUPS.all).select("p_partkey", "feature_name", "policy_status", "review_decision")


_ROLES = ["predictor", "feature_importance_driver", "shap_driver"]


@query("l13_forbidden_feature_check", f"""WITH d AS (SELECT p_brand AS source_artifact, p_partkey, ['{"', '".join(_ROLES)}'][1 + p_partkey % 3] AS feature_role,
  [{", ".join(f"'{k}'" for k in _DRIVERS)}][1 + p_partkey % {len(_DRIVERS)}] AS feature_name FROM part)
SELECT source_artifact, feature_role, feature_name, count(*) AS named, regexp_matches(lower(feature_name), 'profit.per.order|realized_profit') AS is_blocked FROM d GROUP BY ALL""")
def l13_artifacts(spark, sf):
    key = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (key % len(xs)).cast("int"))
    artifacts = table(spark, sf, "part").select(F.col("p_brand").alias("source_artifact"), pick(_ROLES).alias("feature_role"), pick(list(_DRIVERS)).alias("feature_name"))
    found = A.forbidden_feature_check(artifacts, L.PROFIT_GROUPS.all)
    return found.groupBy("source_artifact", "feature_role", "feature_name", "is_blocked").agg(F.count(F.lit(1)).alias("named"))


@query("l13_report_review", f"""WITH d AS (SELECT p_partkey, [{", ".join(f"'{k}'" for k in _DRIVERS)}][1 + p_partkey % {len(_DRIVERS)}] AS feature_name FROM part)
SELECT p_partkey, feature_name, CASE WHEN contains(feature_name, 'country') THEN 'geography' WHEN contains(feature_name, 'price') THEN 'commercial_price'
    WHEN contains(feature_name, 'hour') OR contains(feature_name, 'week') THEN 'order_timing' ELSE 'other' END AS driver_category,
  CASE WHEN regexp_matches(lower(feature_name), 'profit.per.order|realized_profit') THEN 'forbidden' WHEN regexp_matches(feature_name, 'item_unit_price|country') THEN 'caution' ELSE 'allowed' END AS target_policy_status FROM d""")
def l13_report(spark, sf):
    names = F.array(*[F.lit(k) for k in _DRIVERS])
    rows = table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_DRIVERS)).cast("int")).alias("feature_name"))
    return rows.withColumns(A.report_columns(F.col("feature_name")))


_ASSIGNED = O.scored(", k AS (SELECT *, CAST(planned - 1 AS INT) AS cluster FROM seg WHERE p IS NOT NULL AND margin IS NOT NULL)")


def _assigned(spark, sf):
    rows = segments(spark, sf).where(F.col(N.RISK).isNotNull() & F.col(N.MARGIN).isNotNull())
    return rows.select(*N.KEYS, N.RISK, N.EXPECTED_PROFIT, N.MARGIN, N.SEGMENT, (F.col("Days_for_shipment_scheduled") - 1).cast("int").alias(C.CLUSTER))


_ROUNDED = _ASSIGNED + """, x AS (SELECT cluster, CAST(p AS DOUBLE) AS a, round(margin_d, 2) AS b FROM k)"""


def _signal_rows(spark, sf):
    """Risk and margin to two decimals as the signals."""
    rows = _assigned(spark, sf).select(C.CLUSTER, F.col(N.RISK).cast("double").alias("a"), F.round(F.col(N.MARGIN).cast("double"), 2).alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="signals").transform(rows)


@query("l14_silhouette", _ROUNDED + """, g AS (SELECT cluster, a, b, count(*) AS n FROM x GROUP BY 1, 2, 3), c AS (SELECT cluster, sum(n) AS size FROM g GROUP BY 1),
d AS (SELECT t.cluster AS own, t.a, t.b, s.cluster AS other, sum(s.n * sqrt((t.a - s.a) ** 2 + (t.b - s.b) ** 2)) AS far FROM g t CROSS JOIN g s GROUP BY ALL),
m AS (SELECT own, a, b, max(far / (size - 1)) FILTER (own = other) AS inside, min(far / size) FILTER (own <> other) AS outside FROM d JOIN c ON other = c.cluster GROUP BY 1, 2, 3)
SELECT round(sum(n * (outside - inside) / greatest(inside, outside)) / sum(n), 4) AS silhouette, TRUE AS error_is_bounded FROM m JOIN g ON g.cluster = own AND g.a = m.a AND g.b = m.b""")
def l14(spark, sf):
    """Euclidean silhouette of a given assignment, against all pairs of distinct points."""
    value, error = C.silhouette(_signal_rows(spark, sf))
    return spark.range(1).select(F.round(F.lit(value), 4).alias("silhouette"), F.lit(error < 0.05).alias("error_is_bounded"))


_CENTRES = {3: [(0.2, 0.1), (0.4, 0.4), (0.5, 0.2)], 4: [(0.1, 0.2), (0.3, 0.3), (0.4, 0.1), (0.6, 0.5)]}


@query("l14_fixed_centres", _ROUNDED + f""", m AS (SELECT * FROM (VALUES {", ".join(f"({k}, {i}, {a}, {b})" for k, cs in _CENTRES.items() for i, (a, b) in enumerate(cs))}) AS v(k, i, ca, cb)),
n AS (SELECT k, x.a, x.b, min(struct_pack(far := (x.a - ca) ** 2 + (x.b - cb) ** 2, i := i)) AS best, count(*) AS c FROM (SELECT row_number() OVER () AS r, a, b FROM x) x CROSS JOIN m GROUP BY k, r, x.a, x.b),
s AS (SELECT k, best.i AS i, count(*) AS size, sum(best.far) AS inertia FROM n GROUP BY 1, 2)
SELECT k, round(sum(inertia), 6) AS inertia, min(size) AS min_cluster_size, round(CAST(min(size) AS DOUBLE) / sum(size), 9) AS min_cluster_share,
  round(CAST(max(size) AS DOUBLE) / sum(size), 9) AS max_cluster_share, CAST(min(size) AS DOUBLE) / sum(size) >= 0.01 AS meets_min_share_rule FROM s GROUP BY 1""")
def l14_centres(spark, sf):
    """Inertia and shares of assignments to given centres."""
    rows, out = _signal_rows(spark, sf).select("signals"), None
    for k, centres in _CENTRES.items():
        seen = C.Clustering(np.array(centres), 0.0, np.zeros(k)).transform(rows).withColumn("x", vector_to_array("signals"))
        at = F.get(F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres]), F.col(C.CLUSTER))
        far = F.pow(F.get("x", F.lit(0)) - F.get(at, F.lit(0)), 2) + F.pow(F.get("x", F.lit(1)) - F.get(at, F.lit(1)), 2)
        sizes = seen.groupBy(C.CLUSTER).agg(F.count(F.lit(1)).alias("size"), F.sum(far).alias("inertia"))
        part = sizes.agg(F.lit(k).alias("k"), F.round(F.sum("inertia"), 6).alias("inertia"), F.min("size").alias("min_cluster_size"),
                         (F.min("size") / F.sum("size")).alias("min_cluster_share"), (F.max("size") / F.sum("size")).alias("max_cluster_share"))
        out = part if out is None else out.unionByName(part)
    out = C.select_clustering(out.withColumn("silhouette_score", F.lit(0.0))).drop("silhouette_score", "selected")
    return rounded(out, ["min_cluster_share", "max_cluster_share"], 9)


_GROUPED_METRICS = f"""WITH {O.BASE}, m AS (SELECT Type, planned AS k, round(avg(qty) / 50, 6) AS silhouette_score, round(CAST(count(*) AS DOUBLE) / 100000, 9) AS min_cluster_share FROM oi GROUP BY 1, 2)"""


@query("l14_selected_count", _GROUPED_METRICS + """ SELECT Type, CAST(k AS INT) AS k, silhouette_score, min_cluster_share, min_cluster_share >= 0.01 AS meets_min_share_rule,
  row_number() OVER (PARTITION BY Type ORDER BY min_cluster_share >= 0.01 DESC, silhouette_score DESC, min_cluster_share DESC, k) = 1 AS selected FROM m""")
def l14_selected(spark, sf):
    """Which cluster count wins, for metrics of order types that stand in for clusterings."""
    given = silver(spark, sf).groupBy("Type", F.col("Days_for_shipment_scheduled").cast("int").alias("k")).agg(
        F.round(F.avg("Order_Item_Quantity") / 50, 6).alias("silhouette_score"), F.round(F.count(F.lit(1)) / 100000, 9).alias("min_cluster_share"))
    return C.select_clustering(given, within=["Type"])


@query("l17_adoption", """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 1000 AS smallest, CAST(p_partkey % 11 AS DOUBLE) / 20 AS silhouette, p_partkey % 5 = 0 AS duplicates, p_partkey % 7 = 0 AS unclear, p_partkey % 3 AS split FROM part)
SELECT p_partkey, CASE WHEN smallest < 0.01 OR duplicates THEN 'do_not_adopt' WHEN unclear OR split = 0 OR silhouette < 0.25 THEN 'document_but_do_not_use' ELSE 'adopt_as_optional_context' END AS recommendation FROM p""")
def l17(spark, sf):
    """The adoption rules over figures of all parts."""
    key = F.col("p_partkey")
    given = table(spark, sf, "part").select(
        key, (F.col("p_size").cast("double") / 1000).alias("smallest"), ((key % 11).cast("double") / 20).alias("silhouette"),
        (key % 5 == 0).alias("mostly_duplicates_segments"), (key % 7 == 0).alias("hard_to_explain"), (key % 3).alias("segments_split"))
    return given.select("p_partkey", C.adoption(F.col("smallest"), F.col("silhouette")).alias("recommendation"))


@query("l15_profiles_of_assignment", _ASSIGNED + """, s AS (SELECT cluster, segment, count(*) AS n FROM k GROUP BY 1, 2),
t AS (SELECT cluster, max_by(segment, struct_pack(n := n, segment := segment)) AS dominant, CAST(max(n) AS DOUBLE) / sum(n) AS share FROM s GROUP BY 1)
SELECT cluster, count(*) AS row_count, round(avg(CAST(p AS DOUBLE)), 7) AS mean_risk, round(avg(margin_d), 7) AS mean_margin, round(quantile_cont(CAST(profit AS DOUBLE), 0.5), 7) AS median_profit,
  max(dominant) AS dominant_segment, round(max(share), 7) AS dominant_share,
  CASE WHEN max(share) < 0.6 THEN 'mixed / unclear' ELSE CASE WHEN avg(CAST(p AS DOUBLE)) >= 0.35 THEN 'high risk' ELSE 'low risk' END || ' / ' || CASE WHEN avg(margin_d) >= 0 THEN 'high margin' ELSE 'low margin' END END AS label
FROM k JOIN t USING (cluster) GROUP BY 1""")
def l15(spark, sf):
    out = C.cluster_profiles(_assigned(spark, sf))
    return rounded(out.select(
        F.col(C.CLUSTER).alias("cluster"), "row_count", F.col("mean_predicted_late_delivery_risk").alias("mean_risk"), F.col("mean_predicted_margin").alias("mean_margin"),
        F.col("median_expected_profit").alias("median_profit"), F.col("dominant_ao3_priority_segment").alias("dominant_segment"),
        F.col("dominant_ao3_segment_share").alias("dominant_share"), F.col("suggested_interpretation_label").alias("label"),
    ), ["mean_risk", "mean_margin", "median_profit", "dominant_share"], 7)


@query("l16_comparison_of_assignment", _ASSIGNED + """, s AS (SELECT cluster, segment, count(*) AS n FROM k GROUP BY 1, 2),
d AS (SELECT cluster, max(n) AS top, sum(n) AS n FROM s GROUP BY 1),
q AS (SELECT segment, count(*) FILTER (n >= 0.1 * total) AS m FROM (SELECT *, sum(n) OVER (PARTITION BY segment) AS total FROM s) WHERE segment NOT LIKE 'requires%' GROUP BY 1)
SELECT CAST(sum(top) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS weighted_dominant_segment_share, (SELECT count(*) FILTER (m >= 2) FROM q) AS segments_split,
  sum(top) / sum(n) >= 0.9 AS mostly_duplicates_segments, sum(top) / sum(n) < 0.6 AS hard_to_explain FROM d""")
def l16(spark, sf):
    return C.cluster_comparison(_assigned(spark, sf))


@query("l18_sample_rows", O.scored(""" SELECT Order_Id, Order_Item_Id, order_date_DateOrders, segment AS ao3_priority_segment FROM seg
ORDER BY md5(concat_ws('|', '42', CAST(Order_Id AS VARCHAR), Order_Item_Id, CAST(order_date_DateOrders AS VARCHAR))), Order_Id, Order_Item_Id LIMIT 500"""))
def l18(spark, sf):
    return L.sample_rows(segments(spark, sf).select(*N.KEYS, N.SEGMENT), 500)


# --- boosted trees: the first tree of both objectives, two levels deep ------------------------------
def _first_tree_sql(start: str, g: str, h: str, lam: float, alpha: float, least: float) -> str:
    """Every split and leaf of the first tree, by trying each cut of each predictor."""
    score = lambda x, y: f"(greatest(abs({x}) - {alpha}, 0) ** 2 / ({y} + {lam}))"
    leaf = lambda x, y: f"(-sign({x}) * greatest(abs({x}) - {alpha}, 0) / ({y} + {lam}))"

    def level(name: str, source: str) -> str:
        """Best cut of each part of ``source`` (part, a, b, g, h)."""
        return f"""{name}_v AS (SELECT part, slot, v, sum(g) AS g, sum(h) AS h FROM (
    SELECT part, unnest([0, 1]) AS slot, unnest([a, b]) AS v, g, h FROM {source}) GROUP BY ALL),
{name}_c AS (SELECT part, slot, v, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER (PARTITION BY part, slot) AS tg, sum(h) OVER (PARTITION BY part, slot) AS th
  FROM {name}_v WINDOW w AS (PARTITION BY part, slot ORDER BY v)),
{name} AS (SELECT part, slot, v AS cut, {score("lg", "lh")} + {score("(tg - lg)", "(th - lh)")} - {score("tg", "th")} AS gain, lg, lh, tg - lg AS rg, th - lh AS rh
  FROM {name}_c WHERE lh >= {least} AND th - lh >= {least} QUALIFY row_number() OVER (PARTITION BY part ORDER BY round(gain, 6) DESC, slot, v) = 1)"""

    return f"""{start},
r AS (SELECT 'root' AS part, a, b, {g} AS g, {h} AS h FROM q),
{level("one", "r")},
s AS (SELECT CASE WHEN CASE one.slot WHEN 0 THEN r.a ELSE r.b END <= one.cut THEN 'low' ELSE 'high' END AS part, r.a, r.b, r.g, r.h FROM r CROSS JOIN one),
{level("two", "s")},
splits AS (SELECT * FROM one UNION ALL SELECT * FROM two),
nodes AS (SELECT part AS node, CAST(slot AS INT) AS slot, CAST(cut AS DOUBLE) AS cut, gain, CAST(NULL AS DOUBLE) AS value, lh + rh AS cover FROM splits
  UNION ALL SELECT part || '.low', NULL, NULL, NULL, 0.1 * {leaf("lg", "lh")}, lh FROM two
  UNION ALL SELECT part || '.high', NULL, NULL, NULL, 0.1 * {leaf("rg", "rh")}, rh FROM two)"""


_LATE_TREE = f"""WITH {O.BASE}, x AS (SELECT CAST(qty AS DOUBLE) AS a, CAST(tax AS DOUBLE) AS b, CAST(Late_delivery_risk AS DOUBLE) AS y FROM oi),
k AS (SELECT sum(1 - y) / sum(y) AS pw FROM x), z AS (SELECT a, b, y, CASE WHEN y = 1 THEN pw ELSE 1.0 END AS w FROM x CROSS JOIN k),
m AS (SELECT 1 / (1 + exp(-4 * (sum(w * y) / sum(w) - 0.5))) AS p FROM z), q AS (SELECT z.*, p FROM z CROSS JOIN m)"""
_PROFIT_TREE = f"""WITH {O.BASE}, x AS (SELECT CAST(qty AS DOUBLE) AS a, CAST(tax AS DOUBLE) AS b, CAST(Order_Profit_Per_Order AS DOUBLE) AS y FROM oi),
q AS (SELECT a, b, y, avg(y) OVER () AS p FROM x)"""
_LATE_TREE = _first_tree_sql(_LATE_TREE, "(p - y) * w", "p * (1 - p) * w", 2.0, 0.1, 3.0)
_PROFIT_TREE = _first_tree_sql(_PROFIT_TREE, "p - y", "1.0", 1.0, 0.0, 1.0)
_NODES = " SELECT node, coalesce(slot, -1) AS slot, cut, round(gain, 1) AS gain, round(value, 7) AS value, round(cover, 4) AS cover FROM nodes"


def _first_tree(rows, target, *penalties):
    candidate = L.Candidate("first", 1, 2, 0.1, 1.0, 1.0, *penalties)
    return L.fit_boosted(rows, target, [candidate])[0]


def _node_table(spark, model):
    """Nodes of the one tree by their path: model metadata, seven rows at most."""
    tree, rows, stack = model.trees[0], [], [("root", 0)]
    while stack:
        path, n = stack.pop()
        inner = tree.left[n] >= 0
        rows.append((path, *((tree.slot[n], tree.cut[n], tree.gain[n], None) if inner else (-1, None, None, tree.value[n])), tree.cover[n]))
        if inner:
            begin = "" if path == "root" else path + "."
            stack += [(begin + "low", tree.left[n]), (begin + "high", tree.right[n])]
    table = spark.createDataFrame(rows, "node STRING, slot INT, cut DOUBLE, gain DOUBLE, value DOUBLE, cover DOUBLE")
    return table.withColumns({"gain": F.round("gain", 1), "value": F.round("value", 7), "cover": F.round("cover", 4)})


@query("l6_first_tree", _LATE_TREE + _NODES)
def l6_tree(spark, sf):
    """Splits, gains and penalized leaf values of the classifier's first tree."""
    return _node_table(spark, _first_tree(_signals(spark, sf, N.LATE), N.LATE, 3.0, 2.0, 0.1))


@query("l8_first_tree", _PROFIT_TREE + _NODES)
def l8_tree(spark, sf):
    return _node_table(spark, _first_tree(_signals(spark, sf, N.PROFIT), N.PROFIT))


_GAIN = """, g AS (SELECT CASE slot WHEN 0 THEN 'a' ELSE 'b' END AS feature_name, avg(gain) AS gain FROM splits GROUP BY 1),
f AS (SELECT feature_name, coalesce(gain, 0) AS gain FROM (SELECT unnest(['a', 'b']) AS feature_name) LEFT JOIN g USING (feature_name))
SELECT feature_name, round(gain / sum(gain) OVER (), 7) AS importance_value, round(gain / sum(gain) OVER (), 7) AS importance_share,
  row_number() OVER (ORDER BY gain DESC, feature_name) AS importance_rank FROM f"""


@query("l9_gain_importance", _PROFIT_TREE + _GAIN)
def l9_gain(spark, sf):
    """Mean loss reduction of each predictor's splits in the first tree."""
    out = L.feature_importance(spark, _first_tree(_signals(spark, sf, N.PROFIT), N.PROFIT), ["a", "b"])
    return rounded(out, ["importance_value", "importance_share"], 7)


_TREE_SHAPLEY = """, leaf AS (SELECT value, split_part(node, '.', 1) = 'low' AS low1, split_part(node, '.', 2) = 'low' AS low2, one.slot AS f1, one.cut AS c1, two.slot AS f2, two.cut AS c2,
    (two.lh + two.rh) / (one.lh + one.rh) AS r1, cover / (two.lh + two.rh) AS r2 FROM nodes JOIN two ON two.part = split_part(node, '.', 1) CROSS JOIN one WHERE value IS NOT NULL),
d AS (SELECT a, b, count(*) AS n FROM q GROUP BY 1, 2),
w AS (SELECT *, CAST((CASE f1 WHEN 0 THEN a ELSE b END <= c1) = low1 AS INT) AS m1, CAST((CASE f2 WHEN 0 THEN a ELSE b END <= c2) = low2 AS INT) AS m2 FROM d CROSS JOIN leaf),
v AS (SELECT a, b, max(n) AS n, sum(value * r1 * r2) AS v0, sum(value * m1 * m2) AS vab,
    sum(value * CASE f1 WHEN 0 THEN m1 ELSE r1 END * CASE f2 WHEN 0 THEN m2 ELSE r2 END) AS va, sum(value * CASE f1 WHEN 1 THEN m1 ELSE r1 END * CASE f2 WHEN 1 THEN m2 ELSE r2 END) AS vb FROM w GROUP BY 1, 2),
p AS (SELECT n, unnest(['a', 'b']) AS feature_name, unnest([(va - v0 + vab - vb) / 2, (vb - v0 + vab - va) / 2]) AS phi FROM v)
SELECT feature_name, round(sum(n * abs(phi)) / sum(n), 7) AS mean_abs_contribution, round(sum(n * phi) / sum(n), 7) + 0 AS mean_signed_contribution, CAST(sum(n) AS BIGINT) AS sample_size FROM p GROUP BY 1"""


@query("l12_first_tree_attribution", _PROFIT_TREE + _TREE_SHAPLEY)
def l12_tree(spark, sf):
    """Shapley values of the first tree, against all coalitions of its two predictors."""
    rows = _signals(spark, sf, N.PROFIT)
    out = A.tree_attribution(_first_tree(rows, N.PROFIT), rows, ["a", "b"])
    return out.select("feature_name", F.round("mean_abs_contribution", 7).alias("mean_abs_contribution"),
                      (F.round("mean_signed_contribution", 7) + 0.0).alias("mean_signed_contribution"), "sample_size")
