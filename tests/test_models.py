import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskloom import names as N
from riskloom.operators import attribution as A, boosting, clustering as C, gold, modeling as L

GROUPS = L.FeatureGroups(numeric=["x1", "x2"], binary=["b1"], categorical=["c1"])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(600):
        x1, x2, b, c = float(rng.normal()), float(rng.normal()), int(rng.integers(0, 2)), "uvw"[int(rng.integers(0, 3))]
        signal = x1 + 0.5 * b + (1.0 if c == "u" else 0.0)
        data.append((i, i, i, x1 if i % 50 else None, x2, b, c if i % 40 else None, int(signal + rng.normal() * 0.3 > 0.5), signal * 10))
    return spark.createDataFrame(data, f"{N.ORDER} INT, {N.ITEM} INT, {N.ORDER_TS} INT, x1 DOUBLE, x2 DOUBLE, b1 INT, c1 STRING, {N.LATE} INT, {N.PROFIT} DOUBLE")


@pytest.fixture(scope="module")
def encoded(rows):
    pre = L.fit_preprocessor(rows, GROUPS)
    return L.transform(pre, rows, GROUPS), L.feature_names(pre, GROUPS), pre


def test_preprocessing_scales_and_encodes(encoded, spark, rows):
    features, names, pre = encoded
    assert names == ["numeric_continuous__x1", "numeric_continuous__x2", "binary_flags__b1"] + [
        f"categorical__c1_{v}" for v in ("u", "unknown", "v", "w")]
    x = np.array([r[0] for r in features.select(vector_to_array("features")).collect()])
    assert x.shape[1] == len(names)
    assert np.allclose(x[:, :2].mean(0), 0, atol=1e-9) and np.allclose(x[:, :2].std(0), 1, atol=1e-9)
    assert np.allclose(x[:, 3:].sum(1), 1)
    unseen = L.transform(pre, rows.limit(1).withColumn("c1", F.lit("new")), GROUPS)
    assert sum(unseen.select(vector_to_array("features")).first()[0][3:]) == 0


def test_feature_group_contract():
    L.check_feature_groups(L.LATE_GROUPS, N.LATE_PREDICTORS, N.LATE_GOLD_FORBIDDEN)
    L.check_feature_groups(L.PROFIT_GROUPS, N.PROFIT_PREDICTORS, N.PROFIT_GOLD_FORBIDDEN)
    with pytest.raises(ValueError, match="forbidden"):
        L.check_feature_groups(L.FeatureGroups(["Sales"], [], []), ["Sales"], ["sales"])


def test_ridge_equals_the_normal_equations(encoded):
    features, names, _ = encoded
    model = L.fit_ridge(features, alpha=1.0)
    got = features.select(vector_to_array("features").alias("x"), N.PROFIT).collect()
    x, y = np.array([r["x"] for r in got]), np.array([r[N.PROFIT] for r in got])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(np.array(model.coefficients), beta, atol=1e-5)


def test_logistic_and_candidates(spark, encoded):
    features, names, _ = encoded
    table = L.coefficients(spark, L.fit_logistic(features, max_iter=50), names).collect()
    assert table[0]["feature_name"] == "numeric_continuous__x1" and table[0]["direction"] == "positive"
    assert table[0]["odds_ratio"] == pytest.approx(math.exp(table[0]["coefficient"]))
    grid = [L.Candidate("one", 1, 1, 0.1, 1.0, 1.0), L.Candidate("more", 10, 3, 0.3, 1.0, 1.0)]
    results, models = L.candidate_results(features, features, N.LATE, grid)
    assert [r["candidate_id"] for r in results.where("selected").collect()] == ["more"]
    shares = L.feature_importance(spark, models["more"], names).agg(F.sum("importance_share")).first()[0]
    assert shares == pytest.approx(1.0)


def brute_shapley(tree, x, width):
    """Path-dependent Shapley values of one tree by enumerating all coalitions."""
    def value(n, known):
        if tree.left[n] < 0:
            return tree.value[n]
        if tree.slot[n] in known:
            return value(tree.left[n] if x[tree.slot[n]] <= tree.cut[n] else tree.right[n], known)
        return sum(tree.cover[c] / tree.cover[n] * value(c, known) for c in (tree.left[n], tree.right[n]))

    phi = np.zeros(width)
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        for size in range(width):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                phi[i] += w * (value(0, {*s, i}) - value(0, set(s)))
    return phi


def test_tree_attribution_equals_enumeration(encoded):
    features, names, _ = encoded
    model = L.fit_gbt_regressor(features, L.Candidate("c", 3, 3, 0.3, 1.0, 1.0))
    sample = features.limit(25)
    got = {r["feature_name"]: r for r in A.tree_attribution(model, sample, names, max_rows=None).collect()}
    xs = [r[0] for r in sample.select(vector_to_array("features")).collect()]
    phi = np.array([sum(brute_shapley(t, x, len(names)) for t in model.trees) for x in xs])
    for i, name in enumerate(names):
        assert got[name]["mean_abs_contribution"] == pytest.approx(np.abs(phi[:, i]).mean(), abs=1e-9)
        assert got[name]["mean_signed_contribution"] == pytest.approx(phi[:, i].mean(), abs=1e-9)


def chain(depth, rng):
    """A tree that tests another feature at each of ``depth`` steps."""
    tree = boosting.Tree()
    node = tree.add(0.0, 1000.0)
    for k in range(depth):
        share = rng.uniform(0.2, 0.8)
        tree.slot[node], tree.cut[node] = k, 0.0
        tree.left[node] = tree.add(float(rng.normal()), tree.cover[node] * share)
        tree.right[node] = tree.add(float(rng.normal()), tree.cover[node] * (1 - share))
        node = tree.right[node]
    return tree


def test_attribution_of_deep_trees():
    rng = np.random.default_rng(3)
    small = chain(9, rng)
    x = rng.normal(size=(12, 9))
    assert np.allclose(A.tree_contributions([small], 9)(x), [brute_shapley(small, r, 9) for r in x], atol=1e-12)
    deep = chain(24, rng)
    x = rng.normal(size=(400, 24)) + 0.7
    phi = A.tree_contributions([deep], 24)(x)
    model = boosting.BoostedTrees(boosting.SQUARED, 0.0, 24, [deep])
    expected, reach, node = 0.0, 1.0, 0
    while deep.left[node] >= 0:  # the cover-weighted mean leaf
        expected += deep.cover[deep.left[node]] / deep.cover[0] * deep.value[deep.left[node]]
        node = deep.right[node]
    expected += deep.cover[node] / deep.cover[0] * deep.value[node]
    assert np.allclose(phi.sum(1), model.margins(x) - expected, atol=1e-9)


def exact_greedy(x, y, w, s, objective, base):
    """The same boosting by sorting: every cut of every feature, row by row sums."""
    margin, trees = np.full(len(y), base), []
    soft = lambda g: np.sign(g) * max(abs(g) - s.reg_alpha, 0.0)
    score = lambda g, h: soft(g) ** 2 / (h + s.reg_lambda)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = ((p - y) * w, p * (1 - p) * w) if objective == boosting.LOGISTIC else ((margin - y) * w, w)
        step, used = np.zeros(len(y)), []

        def grow(rows, depth):
            best = None
            if depth < s.depth:
                for slot in range(x.shape[1]):
                    for cut in np.unique(x[rows, slot])[:-1]:
                        low = x[rows, slot] <= cut
                        a, b = rows[low], rows[~low]
                        if min(h[a].sum(), h[b].sum()) >= s.min_child_weight:
                            gain = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[rows].sum(), h[rows].sum())
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = gain, slot, a, b
            if best is None:
                step[rows] = -s.rate * soft(g[rows].sum()) / (h[rows].sum() + s.reg_lambda)
                return
            used.append(best[:2])
            grow(best[2], depth + 1)
            grow(best[3], depth + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + step
        trees.append(used)
    return margin, trees


@pytest.mark.parametrize("objective", [boosting.LOGISTIC, boosting.SQUARED])
def test_boosting_equals_exact_greedy(spark, monkeypatch, objective):
    monkeypatch.setattr(boosting, "REFRESH", 3)  # several refreshes in few rounds
    rng = np.random.default_rng(8)
    n = 300
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 2, n), rng.normal(size=n).round(1), np.zeros(n)], 1).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 0)).astype(float) * 0.9 + rng.normal(size=n) * 0.3
    y = (y > 0.5).astype(float) if objective == boosting.LOGISTIC else y * 40
    w = np.where(y > 0, 1.7, 1.0) if objective == boosting.LOGISTIC else np.ones(n)
    rows = spark.createDataFrame(
        [(i, r, float(a), float(b)) for i, (r, a, b) in enumerate(zip(x.tolist(), y, w))], "id LONG, x ARRAY<DOUBLE>, y DOUBLE, w DOUBLE"
    ).withColumn("features", array_to_vector("x"))
    settings = [boosting.Setting(7, 3, 0.3, reg_lambda=1.5, reg_alpha=0.4, min_child_weight=2.0), boosting.Setting(4, 1, 0.5, reg_lambda=0.0)]
    models = boosting.fit_many(rows.repartition(3), settings, objective, "y", weight=F.col("w"))
    for s, model in zip(settings, models):
        margin, trees = exact_greedy(x, y, w, s, objective, model.base)
        assert len(model.trees) == s.rounds and np.allclose(model.margins(x), margin, atol=1e-5)
        gains = {}
        for used in trees:
            for gain, slot in used:
                gains.setdefault(slot, []).append(gain)
        mean = np.array([np.mean(gains.get(i, [0.0])) for i in range(4)])
        assert np.allclose(model.gain_importance(), mean / mean.sum(), atol=1e-6)
    again = boosting.fit_many(rows.repartition(7), settings, objective, "y", weight=F.col("w"))
    assert [t.value for m in models for t in m.trees] == [t.value for m in again for t in m.trees]


def test_boosting_takes_one_job_a_level_whatever_is_stored(spark, encoded, monkeypatch):
    """Two jobs of an aggregation for each of hundreds of levels were most of the time of the grids."""
    features, _, _ = encoded
    jobs, values = [], []
    for name, rounds, store, tables in (("few", 2, 16, 64), ("many", 12, 16, 64), ("stored", 12, 1, 1)):
        monkeypatch.setattr(boosting, "STORE", store)
        monkeypatch.setattr(boosting, "MOST_TABLES", tables)
        spark.sparkContext.setJobGroup(name, name)
        model = L.fit_gbt_classifier(features, L.Candidate(name, rounds, 2, 0.3, 0.8, 0.8))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        values.append([t.value for t in model.trees])
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] - jobs[0] <= 10 * 2
    assert values[1] == values[2] and values[1][:2] == values[0]


def test_leaf_tables_equal_patterns_of_rows(monkeypatch):
    """The table of a leaf's patterns and the patterns that rows have give the same contributions."""
    rng = np.random.default_rng(4)
    tree = boosting.Tree()
    for _ in range(7):
        tree.add(float(rng.normal()), 0.0)
    tree.slot[:3], tree.cut[:3] = [0, 1, 2], [0.1, -0.2, 0.3]
    tree.left[:3], tree.right[:3], tree.cover = [1, 3, 5], [2, 4, 6], [10.0, 6.0, 4.0, 4.0, 2.0, 1.0, 3.0]
    x = rng.normal(size=(200, 4))
    by_table = A.tree_contributions([tree], 4)
    assert all(table is not None for _, table in by_table.__closure__[0].cell_contents)
    monkeypatch.setattr(A, "TABLE_FEATURES", 0)
    assert np.array_equal(by_table(x), A.tree_contributions([tree], 4)(x))


def test_boosting_draws_rows_and_columns(spark, encoded):
    features, names, _ = encoded
    drawn = L.Candidate("drawn", 8, 2, 0.3, 0.5, 0.5)
    a, b = (L.fit_gbt_classifier(features.repartition(k), drawn) for k in (2, 5))
    whole = L.fit_gbt_classifier(features, L.Candidate("whole", 8, 2, 0.3, 1.0, 1.0))
    assert [t.value for t in a.trees] == [t.value for t in b.trees] != [t.value for t in whole.trees]
    scored = a.transform(features)
    assert scored.select(F.avg((F.col("prediction") == F.col(N.LATE)).cast("int"))).first()[0] > 0.7
    with pytest.raises(ValueError):
        boosting.fit_many(features.limit(0), [boosting.Setting(1, 1, 0.1)], boosting.LOGISTIC, N.LATE)


def test_linear_attribution_sums_to_nothing(encoded):
    features, names, _ = encoded
    rows = A.linear_attribution(L.fit_ridge(features), features, names, max_rows=None).collect()
    assert all(abs(r["mean_signed_contribution"]) < 1e-9 for r in rows)
    assert sum(r["importance_share"] for r in rows) == pytest.approx(1.0) and rows[0]["sample_size"] == 600


def test_driver_policy(spark):
    df = spark.createDataFrame([(n,) for n in (
        "numeric_continuous__item_unit_price", "categorical__order_state_normalized_new_york", "numeric_continuous__order_hour",
        "Order_Profit_Per_Order", "numeric_continuous__sales_per_customer_x", "categorical__shipping_speed_tier_standard")], "feature_name STRING")
    got = {r["feature_name"]: r for r in A.classify_drivers(df, L.PROFIT_GROUPS.all).collect()}
    assert [r["policy_status"] for r in got.values()] == ["caution", "caution", "allowed", "forbidden", "forbidden", "caution"]
    place = got["categorical__order_state_normalized_new_york"]
    assert place["base_feature_name"] == "order_state_normalized" and place["driver_family"] == "geography"
    assert got["numeric_continuous__sales_per_customer_x"]["matched_policy_rule"] == "forbidden_token:sales_per_customer"
    assert got["Order_Profit_Per_Order"]["review_decision"] == "blocked"


def test_one_to_one_merge_refuses_repeats(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, l STRING")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k INT, r STRING")
    with pytest.raises(ValueError, match="not unique"):
        gold.merge_one_to_one(left, right, ["k"])
    assert gold.merge_one_to_one(left, right.limit(1), ["k"]).count() == 1


def test_cluster_profiles_and_adoption(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(300):
        risk = [0.1, 0.5, 0.9][i % 3] + rng.normal() * 0.01
        data.append((i, i, i, float(risk), 5.0, float(rng.normal() * 0.01 + 0.2), N.PROTECT if risk > 0.35 else N.PRESERVE))
    df = spark.createDataFrame(data, f"{N.ORDER} INT, {N.ITEM} INT, {N.ORDER_TS} INT, {N.RISK} DOUBLE, {N.EXPECTED_PROFIT} DOUBLE, {N.MARGIN} DOUBLE, {N.SEGMENT} STRING")
    vectors = C.signal_vectors(df)
    metrics, models = C.kmeans_candidates(vectors, ks=(3,), restarts=3)
    assigned = C.assign_clusters(models[3], vectors)
    profiles = C.cluster_profiles(assigned).collect()
    assert sum(p["row_share"] for p in profiles) == pytest.approx(1.0)
    comparison = C.cluster_comparison(assigned)
    assert C.adoption_decision(metrics, comparison).first()["k"] == 3


def brute_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    n = np.bincount(label)
    mean = np.stack([d[:, label == c].sum(1) for c in range(len(n))], 1)
    inside = mean[np.arange(len(x)), label] / np.maximum(n[label] - 1, 1)
    mean = mean / n
    mean[np.arange(len(x)), label] = np.inf
    outside = mean.min(1)
    return np.where(n[label] > 1, (outside - inside) / np.maximum(inside, outside), 0.0).mean()


def test_silhouette_of_points_outliers_and_copies(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 2)) * [1, 0.2], rng.normal(size=(500, 2)) * 0.1 + 2, [[900.0, -3], [900.0, -3], [5, 5]], np.repeat([[1.0, 1.0]], 200, 0)])
    label = np.where(x[:, 0] > 800, 2, (x[:, 0] > 1.2).astype(int))
    table = lambda x, label: spark.createDataFrame(list(zip(x.tolist(), label.tolist())), f"x ARRAY<DOUBLE>, {C.CLUSTER} INT").withColumn("signals", array_to_vector("x"))
    exact = brute_silhouette(x, label)
    for cells, close in ((128, 2e-4), (8, 5e-3)):
        value, error = C.silhouette(table(x, label), cells=cells)
        assert abs(value - exact) <= min(error, close)
        assert C.silhouette(table(x, label).repartition(7), cells=cells) == pytest.approx((value, error), abs=1e-12)
    few = rng.integers(0, 4, (300, 2)).astype(float)
    own = (few[:, 0] > 1).astype(int)
    assert C.silhouette(table(few, own)) == (pytest.approx(brute_silhouette(few, own), abs=1e-9), 0.0)
    assert C.silhouette(table(few, own * 0)) == (0.0, 0.0)


def test_all_restarts_find_the_best_clustering(spark):
    rng = np.random.default_rng(9)
    spots = np.array([[0, 0], [4, 0], [0, 5], [6, 6]])
    x = np.concatenate([rng.normal(size=(200, 2)) * 0.3 + c for c in spots])
    vectors = spark.createDataFrame([(r,) for r in x.tolist()], "x ARRAY<DOUBLE>").select(array_to_vector("x").alias("signals"))
    metrics, models = C.kmeans_candidates(vectors, ks=(3, 4), restarts=4)
    assert np.allclose(models[4].centers, spots[np.lexsort(spots.T[::-1])], atol=0.1) and models[4].sizes.tolist() == [200] * 4
    near = ((x[:, None] - models[4].centers) ** 2).sum(2).min(1).sum()
    assert models[4].cost == pytest.approx(near) and models[3].cost > near
    assert metrics.where("selected").first()["k"] == 4 and metrics.where("silhouette_error > 0.05").count() == 0
    assert models[4].transform(vectors).select(C.CLUSTER).distinct().count() == 4
    one = C.fit_kmeans(vectors.limit(1), ks=(2,), restarts=2)[2]
    assert one.cost == 0.0 and sorted(one.sizes.tolist()) == [0, 1]


def test_sample_is_the_same_whatever_the_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias(N.ORDER), F.col("id").alias(N.ITEM), F.col("id").alias(N.ORDER_TS))
    draws = [sorted(r[0] for r in L.sample_rows(df.repartition(k), 20).collect()) for k in (1, 5)]
    assert draws[0] == draws[1] and len(set(draws[0])) == 20


def test_equal_points_are_clustered_once_with_their_number(spark):
    """Copies of rows used to be worked on one by one, in every step and for every distance."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(25, 2)) + 4])
    once = spark.createDataFrame([(r,) for r in x.tolist()], "x ARRAY<DOUBLE>").withColumn("signals", array_to_vector("x"))
    many = once.crossJoin(spark.range(30)).repartition(5)
    points = C.equal_points(many.select("x"))
    assert points.count() == 65 and {r["n"] for r in points.collect()} == {30}
    a, b = (C.fit_kmeans(v, ks=(2,), restarts=3)[2] for v in (once, many))
    assert np.allclose(a.centers, b.centers) and b.cost == pytest.approx(30 * a.cost) and (b.sizes == 30 * a.sizes).all()
    label = a.transform(once).select(C.CLUSTER).collect()
    value, error = C.silhouette(a.transform(many))
    repeated = np.repeat(x, 30, axis=0), np.repeat([r[0] for r in label], 30)
    assert abs(value - brute_silhouette(*repeated)) <= error + 1e-9


def test_comparison_reads_the_assignment_once(spark):
    """Its counts were taken anew, joins and all, for each of the three things made of them."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i % 3, N.PROTECT if i % 2 else N.PRESERVE) for i in range(60)], f"{C.CLUSTER} INT, {N.SEGMENT} STRING")
    row = C.cluster_comparison(rows.mapInArrow(told, rows.schema)).first()
    assert row["segments_split"] == 2 and row["weighted_dominant_segment_share"] == 0.5
    assert seen.value == 60
