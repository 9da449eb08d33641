import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.aggregates import mean, total
from riskloom.operators import ordering, split
from riskloom.operators.ordering import chronological_row_number, exact_quantiles, running_totals
from riskloom import names as N


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one order on one day; dates tie heavily everywhere."""
    rng = np.random.default_rng(7)
    rows = [(int(d), int(o), i) for i, (d, o) in enumerate(zip(rng.integers(0, 5, 900), rng.integers(0, 50, 900)))]
    rows += [(2, 77, 10_000 + i) for i in range(450)]
    rng.shuffle(rows)
    return [tuple(map(int, r)) for r in rows]


def test_row_number_equals_a_global_sort(spark, skewed):
    df = spark.createDataFrame(skewed, "d INT, o INT, i INT").repartition(7)
    got = {r["i"]: r["n"] for r in chronological_row_number(df, ["d", "o", "i"], "n", slices=6).collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(skewed), 1)}


def test_split_boundary_is_floor(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(11)], f"{N.ORDER_TS} INT, {N.ORDER} INT, {N.ITEM} INT")
    parts = split.chronological_split(df)
    assert parts.where(F.col(N.SPLIT) == N.DEVELOPMENT).count() == 8
    inner = split.inner_split(parts).groupBy("modeling_slice").count().collect()
    assert {r[0]: r[1] for r in inner} == {N.INNER_TRAIN: 6, N.INNER_VALIDATION: 2}
    assert split.partition_usage(parts)["fit_on"] == N.DEVELOPMENT


def test_running_totals_cross_slices(spark):
    rows = [(g, v, v % 3 + 1) for g in ("a", "b", None) for v in range(200)]
    out = running_totals(spark.createDataFrame(rows, "g STRING, v INT, w INT"), ["g"], [F.desc("v")], ["w"]).toPandas()
    for g in ("a", "b"):
        part = out[out.g == g].sort_values("v", ascending=False)
        assert (part["w"].cumsum() == part["w_upto"]).all()


def test_exact_quantiles_match_linear_interpolation(spark, skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(skewed, "d INT, o INT, i INT")
    got = {(r["d"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["d"], "o", probs).collect()}
    pdf = pd.DataFrame(skewed, columns=["d", "o", "i"])
    for d, part in pdf.groupby("d"):
        for p in probs:
            assert got[(d, p)] == pytest.approx(np.quantile(part["o"], p), abs=1e-9)
    whole = exact_quantiles(df, [], "i", [0.3]).collect()
    assert [r["quantile"] for r in whole] == [pytest.approx(np.quantile(pdf["i"], 0.3))]


def test_quantiles_of_nothing_one_row_and_null_groups(spark):
    df = spark.createDataFrame([("a", 3.0), (None, 1.0), (None, 2.0), ("b", None)], "g STRING, v DOUBLE")
    got = {r["g"]: r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {"a": 3.0, None: 1.5}
    assert exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


def test_sums_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x),) for x in np.round(rng.normal(0, 1e4, 5000), 4)]
    df = spark.createDataFrame(rows + [(None,), (float("nan"),)], "v DOUBLE")
    seen = {tuple(df.repartition(k).agg(total("v"), mean("v")).first()) for k in (1, 3, 13)}
    assert len(seen) == 1
    exact = sum(round(x * 10**4) for (x,) in rows) / 10**4
    assert seen.pop()[0] == exact


def test_tables_of_a_job_go_with_it(spark):
    import os

    from riskloom.session import job_folder, materialize

    with job_folder(spark) as folder:
        assert materialize(spark.range(5), "x").count() == 5 and os.listdir(folder)
    assert not os.path.exists(folder)
    assert materialize(spark.range(3)).count() == 3


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from riskloom.session import shared_folder

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError):
        shared_folder(unset)


def test_selected_quantiles_of_hot_huge_and_odd_values(spark):
    rng = np.random.default_rng(4)
    groups = {
        "money": np.concatenate([rng.normal(100, 1e-4, 500), [100.0] * 700]), "signs": rng.normal(size=401) * 10.0 ** rng.integers(-9, 9, 401),
        "one": np.array([3.5]), "same": np.full(50, -0.1), None: np.array([1.0, 2.0]), "ends": np.array([-np.inf, -1e300, 1e300, np.inf]),
        "close": 1e15 + np.arange(100.0),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("gone", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["probability"]): r["quantile"] for r in ordering.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, x in groups.items():
        for p in probs:
            if g != "ends":
                assert got[g, p] == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert (got["ends", 0.0], got["ends", 1.0]) == (-np.inf, np.inf)
    weighted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    again = {(r["g"], r["probability"]): r["quantile"] for r in ordering.exact_quantiles(weighted, ["g"], "v", probs, "n").collect()}
    assert {k: v for k, v in again.items() if k[0] != "ends"} == {k: v for k, v in got.items() if k[0] != "ends"}
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v DOUBLE")
    assert [r["quantile"] for r in ordering.exact_quantiles(nan, [], "v", [0.0, 0.5]).orderBy("probability").collect()] == [1.0, 2.0]
    assert ordering.exact_quantiles(df.where("v is null"), ["g"], "v", [0.5]).count() == 0


def test_selected_row_and_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), f"k{i:04d}", float(a) if a % 3 else None) for i, a in enumerate(rng.integers(0, 12, 300))]
    df = spark.createDataFrame(rows, "a LONG, k STRING, x DOUBLE").withColumn("t", F.timestamp_seconds(F.col("a") * 86400)).repartition(4)
    for keys in (["a", "k"], ["t", "k"], ["x", "k"]):
        in_order = [r.asDict() for r in df.orderBy(*keys).select(*keys).collect()]
        for position in (1, 2, 57, 150, 299, 300):
            assert ordering.row_at(df, keys, position) == in_order[position - 1]
        assert ordering.row_at(df, keys, 301) is None
    numbered = split.chronological_split(df, 0.7, ["t", "k"])
    labelled = split.label_split(df, 0.7, ["t", "k"])
    assert labelled.join(numbered, ["k", "split_partition"]).count() == 300
    assert split.label_split(df, 0.0, ["t", "k"]).where("split_partition = 'development'").count() == 0
    assert split.label_split(df, 1.0, ["t", "k"]).where("split_partition = 'test'").count() == 0
    with pytest.raises(ValueError):
        ordering.row_at(df, ["k"], 1)


def test_discrete_quantiles_are_values_at_whole_positions(spark):
    for n in (1, 2, 3, 100, 300, 700):
        df = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") + 1).cast("double").alias("v"))
        got = {r["probability"]: r["quantile"] for r in ordering.exact_quantiles(df, ["g"], "v", [0.25, 0.33, 0.67], discrete=True).collect()}
        assert got == {p / 100: max(1, -(-p * n // 100)) for p in (25, 33, 67)}


def test_stored_tables_are_compressed_well(spark):
    from riskloom.session import materialize

    assert all(f.endswith(".zstd.parquet") for f in materialize(spark.range(10)).inputFiles())
