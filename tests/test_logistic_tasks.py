"""The logistic fit's tasks are bounded."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom import names as N
from riskloom.operators import modeling as L


def test_logistic_fit_goes_over_bounded_tasks(spark, monkeypatch):
    parts = []

    class Seen(L.LogisticRegression):
        def fit(self, rows):
            parts.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    rows = spark.range(400, numPartitions=2).select(
        F.col("id").alias(N.ORDER), F.array(F.rand(3), F.rand(4)).alias("x"), (F.col("id") % 3 == 0).cast("int").alias(N.LATE))
    rows = rows.select(N.ORDER, N.LATE, array_to_vector("x").alias(L.FEATURES))
    whole = L.fit_logistic(rows)
    monkeypatch.setattr(L, "LogisticRegression", Seen)
    monkeypatch.setattr(L, "ROWS_PER_TASK", 50)
    dealt = L.fit_logistic(rows)
    assert parts == [8]
    assert abs(whole.coefficients.toArray() - dealt.coefficients.toArray()).max() < 1e-6
