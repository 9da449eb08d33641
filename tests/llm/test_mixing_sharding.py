import math
import zlib

import numpy as np
import pytest
from llm_words import words
from pyspark.sql import functions as F

from riskloom.llm import mixing, queries, sharding
from riskloom.llm.common import n_words


def targets(sizes, weights=(5, 2, 1), ratio=1.5, cap=2):
    """Shares re-dealt until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, rest = {}, set(order)
    while True:
        left = ratio * sum(sizes.values()) - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > cap * sizes[s]}
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}
        rest -= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken_words(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), f"s{rng.zipf(1.6) % 7}" if rng.random() > 0.1 else None, " ".join("w" for _ in range(int(rng.integers(0, 60))))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING")
    plan = mixing.plan_mix(docs, "source", n_words(F.col("text")), [F.col("doc_id")]).toPandas()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    assert len(plan) == len(rows) and (plan["taken"] <= 2 * plan["size"]).all()
    for s, part in plan.groupby(plan["source"].fillna("none")):
        s = None if s == "none" else s
        assert math.isclose(part["target"].iloc[0], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(part["taken"].sum() - want[s]) <= 1
    again = mixing.plan_mix(docs.repartition(5), "source", n_words(F.col("text")), [F.col("doc_id")]).toPandas()
    assert plan.sort_values("doc_id")["uses"].tolist() == again.sort_values("doc_id")["uses"].tolist()


def test_inverse_of_demand(spark):
    knots = ((0.0, 0.2), (0.25, 2.0), (0.7, 0.0), (1.0, 1.0))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    t = np.linspace(0, 1, 201)
    w = np.interp(t, *zip(*knots))
    share = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))]) / area
    got = spark.createDataFrame([(float(x),) for x in share], "x DOUBLE").select(mixing.demand_inverse(F.col("x"), knots).alias("t")).toPandas()["t"]
    assert np.allclose(np.interp(got, t, share), share, atol=1e-6)


def test_training_order_is_sorted_and_keeps_columns(spark, odd_docs, no_docs):
    clash = odd_docs.withColumnsRenamed({"lang": "size", "n_chars": "uses"})
    out = mixing.mix_documents(clash)
    assert out.columns == clash.columns and out.count() > 0
    assert mixing.mix_documents(no_docs).count() == 0
    plan = mixing.plan_mix(odd_docs, "source", n_words(F.col("text")), [F.col("doc_id"), F.col("text")])
    order = mixing.training_order(plan).select("position").toPandas()["position"]
    assert order.is_monotonic_increasing
    assert plan.where("size = 0 and taken > 0").count() == 0


def test_mixed_words_are_the_planned_ones(spark):
    space = "\u00a0 \t\n \r\x0b"
    long = space.join(f"\u00c0{i}" for i in range(1000)) + " "
    rows = [(1, "a", "x " * 100), (2, "b", long), (3, "c", long), *[(i, "d", f" y{i}  z ") for i in range(10, 60)]]
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING")
    plan = mixing.plan_mix(docs, "source", n_words(F.col("text")), [F.col("doc_id"), F.col("text")]).toPandas()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    mixed = mixed.toPandas()
    taken = plan.groupby("doc_id")["taken"].sum()
    used = mixed.groupby("doc_id")["text"].agg(lambda t: sum(len(words(x)) for x in t))
    assert used.to_dict() == taken[taken > 0].to_dict()
    size = plan.set_index("doc_id")["size"]
    assert (taken % size).loc[[2, 3]].any()  # some budget ends inside a long text
    assert all(dict((i, t) for i, _, t in rows)[r["doc_id"]].startswith(r["text"]) for _, r in mixed.iterrows())


def test_sharding_query_against_brute_force(spark, sf):
    got = queries.QUERIES["op4_sharding"](spark, sf).toPandas().set_index("doc_id")
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got.index) == set(docs)
    for i, raw in docs.items():
        assert got.loc[i, "size"] == len(raw) + 8 and got.loc[i, "text_crc32"] == zlib.crc32(raw)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(got["shard"]) == set(range(24))
    moved = got[got["shard"] != got["grown_shard"]]
    assert (moved["grown_shard"] == 24).all() and 0 < len(moved) < 0.12 * len(got)


def test_shards_follow_weights_and_only_give_up_their_own(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    old, new = [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0]
    got = keys.select(sharding.rendezvous(F.col("k"), old).alias("a"), sharding.rendezvous(F.col("k"), new).alias("b")).toPandas()
    assert np.allclose(got["a"].value_counts(normalize=True).sort_index(), [0.25, 0.5, 0.25], atol=0.02)
    assert ((got["a"] == got["b"]) | (got["b"] == 3)).all() and abs((got["b"] == 3).mean() - 0.5) < 0.02


def test_shards_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    got = sharding.assign_shards(odd_docs.withColumnRenamed("lang", "_h"), "doc_id", [1.0, 3.0])
    rows = got.toPandas()
    assert len(rows) == odd_docs.count() and all(sorted(p["slot"]) == list(range(len(p))) for _, p in rows.groupby("shard"))
    assert sharding.assign_shards(no_docs, "doc_id", [1.0]).count() == 0
    sharding.write_shards(got, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(rows)


HELPERS = ("_key", "_null", "_src", "_bucket", "_from", "_class", "_part", "_size", "_row", "_total", "_start", "_inside", "_cap", "_all", "_rest", "_h", "_one")


def test_columns_named_like_helpers_survive(spark, odd_docs):
    named = odd_docs
    for i, c in enumerate(HELPERS):
        named = named.withColumn(c, F.lit(i))
    for planned in (
        mixing.plan_mix(named, "source", F.lit(3), [F.col("doc_id"), F.col("text")]),
        sharding.assign_shards(named.drop("text"), "doc_id", [1.0, 2.0], grown=[1.0, 2.0, 1.0]),
    ):
        got = planned.select(*HELPERS).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(range(len(HELPERS)))] and planned.count() == 12
    mixed = mixing.mix_documents(named)
    assert mixed.columns == named.columns and mixed.select(*HELPERS).distinct().count() == 1


def test_rows_repeated_in_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 400 + [(i, f"w{i} x", "t") for i in range(300)], "doc_id LONG, text STRING, source STRING")
    planned = mixing.plan_mix(docs, "source", F.size(F.split("text", " ")), [F.col("doc_id"), F.col("text")])
    sums = {r["source"]: (r["t"], r["target"]) for r in planned.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
    assert all(abs(t - target) <= 1 for t, target in sums.values())
    slots = sharding.assign_shards(docs, "doc_id", [1.0] * 3).groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m"))
    assert all(r["n"] == r["m"] + 1 for r in slots.collect())


def test_a_third_of_equal_rows_is_numbered_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRETCH", 16)
    monkeypatch.setattr(sharding, "STRETCHES_PER_BUCKET", 4)
    spans = []
    whole = sharding.prefix_sums

    def watched(df, group, bucket, *rest):
        spans.append((df.groupBy(*group, bucket).count().agg(F.max("count")).first()[0], df.agg(F.max(rest[1])).first()[0]))
        return whole(df, group, bucket, *rest)

    monkeypatch.setattr(sharding, "prefix_sums", watched)
    rows = [(1, "same", None)] * 3000 + [(None, None, None)] * 40 + [(i, f"t{i}", 1.5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, _part DOUBLE")
    got = sharding.assign_shards(docs, "doc_id", [1.0] * 3)
    pdf = got.toPandas()
    assert got.columns == ["doc_id", "text", "_part", "shard", "slot"] and len(pdf) == len(rows)
    assert all(sorted(p["slot"]) == list(range(len(p))) for _, p in pdf.groupby("shard"))
    assert (pdf["doc_id"] == 1).sum() == 3001 and pdf["doc_id"].isna().sum() == 40
    assert spans[0][1] == 16 and spans[0][0] < 1500  # rows that a window sees
    again = sharding.assign_shards(docs.repartition(7), "doc_id", [1.0] * 3)
    assert got.exceptAll(again).count() == 0


def test_chosen_shard_is_the_best_score(spark, sf):
    """The race by brute force: the query's shard and grown shard for every document."""
    import xxhash

    got = queries.QUERIES["op4_sharding"](spark, sf).toPandas()

    def race(key, shards):
        times = []
        for i in range(shards):
            seed = xxhash.xxh64_intdigest(f"shard {i}".encode(), 42)
            u = (xxhash.xxh64_intdigest(str(key).encode(), seed) >> 12) + 0.5
            times.append(-math.log(u / 2.0**52))
        return times.index(min(times))

    assert [race(k, 24) for k in got["doc_id"]] == got["shard"].tolist()
    assert [race(k, 25) for k in got["doc_id"]] == got["grown_shard"].tolist()
