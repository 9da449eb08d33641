import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom import names as N
from riskloom.operators import modeling as L, split

GROUPS = L.FeatureGroups(numeric=["x1", "x2"], binary=["b1", "b2"], categorical=["c1", "c2"])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i // 3, str(i), i // 20, float(i % 7) if i % 11 else None, 2.0 if i % 5 else float("nan"), i % 2 if i % 3 else None, 1,
             "wvu"[i % 3] if i % 13 else None, "" if i % 2 else f"k{i % 17}", float(i)) for i in range(240)]
    return spark.createDataFrame(
        data, f"{N.ORDER} LONG, {N.ITEM} STRING, {N.ORDER_TS} INT, x1 DOUBLE, x2 DOUBLE, b1 INT, b2 INT, c1 STRING, c2 STRING, {N.PROFIT} DOUBLE"
    ).repartition(3)


def test_stored_vectors_are_those_of_the_stages(spark, rows):
    """Vectors are made in batches, from values counted in one pass, where each stage took the rows through itself."""
    pre = L.fit_preprocessor(rows, GROUPS)
    assert pre.labels[0] == ["u", "unknown", "v", "w"] and pre.labels[1][0] == "(blank)" and len(pre.labels[1]) == 18
    assert pre.medians == {"x1": 3.0, "x2": 2.0} and pre.modes == {"b1": 0.0, "b2": 1.0}
    odd = rows.withColumns({"c1": F.when(F.col("c1") == "u", "new").otherwise(F.col("c1")), "b1": F.lit(None).cast("int")})
    for some in (rows, odd, rows.limit(0)):
        made = {r[0]: r[1] for r in L.transform(pre, some, GROUPS).select(N.ITEM, vector_to_array("features")).collect()}
        kept = L.store_encoded(pre, some, GROUPS, [*N.KEYS, "x1", N.PROFIT])
        assert {r[0]: r[1] for r in kept.select(N.ITEM, vector_to_array("features")).collect()} == made
        assert sorted(kept.select(N.ITEM, N.ORDER_TS, "x1", N.PROFIT).collect(), key=str) == sorted(
            some.select(N.ITEM, N.ORDER_TS, "x1", N.PROFIT).collect(), key=str)
    with pytest.raises(ValueError):
        L.fit_preprocessor(rows.withColumn("b2", F.lit(None).cast("int")), GROUPS)


def test_slices_of_labelled_rows_are_those_of_numbered_ones(rows):
    """Only the rows whose numbers are wanted are put in order."""
    numbered = split.chronological_split(rows)
    labelled = split.label_split(rows)
    assert N.ROW_NUMBER not in labelled.columns
    key = lambda df, *c: {r[0]: tuple(r[1:]) for r in df.select(N.ITEM, *c).collect()}
    assert key(labelled, N.SPLIT) == key(numbered, N.SPLIT)
    assert key(split.inner_split(labelled), "modeling_slice") == key(split.inner_split(numbered), "modeling_slice")
    test = split.slice_partition(labelled, N.TEST)
    after = split.numbered_after(test, labelled.where(F.col(N.SPLIT) == N.DEVELOPMENT).count())
    assert key(after, N.ROW_NUMBER) == key(split.slice_partition(numbered, N.TEST), N.ROW_NUMBER)


def test_held_out_scores_carry_the_numbers_of_all_rows(rows):
    for target, score in ((N.PROFIT, "ao2_chronological_row_number"), (N.LATE, N.ROW_NUMBER)):
        some = rows.withColumns({N.LATE: (F.col(N.PROFIT) % 2).cast("int"), N.ORDER_VALUE: F.col(N.PROFIT) + 1})
        numbered = split.chronological_split(some)
        candidate = L.Candidate("small", 2, 2, 0.3, 1.0, 1.0)
        a, b = (L.fit_and_score(p, target, GROUPS, candidate) for p in (split.label_split(some), numbered))
        assert {r[0]: r[1] for r in a.select(N.ITEM, score).collect()} == {r[0]: r[1] for r in b.select(N.ITEM, score).collect()}
        assert a.columns == b.columns and a.count() == 48
