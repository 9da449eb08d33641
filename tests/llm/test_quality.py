import re

import numpy as np
from llm_words import words

from riskloom.llm import queries, quality


def brute(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = [x for x in t.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_statistics_equal_brute_force(spark, sf, odd_docs):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [r["text"] for r in odd_docs.collect() if r["doc_id"] != 5] + ["a b c a b c a b", "x x x x", "a b c d\r\na b c\x1fd"]
    for t in texts:
        if len(t or "") < 8000:
            assert quality.text_statistics(t)[:5] == brute(t)


def test_query_follows_base_rule_and_splits_labels(spark, sf):
    got = queries.QUERIES["op1_quality_rules"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got["base_failed"] == ((got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"]))).all()
    assert not got["kept"][got["base_failed"]].any()


def test_held_out_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert rules.rules and ((got["quality"] == 1) == got["kept"]).mean() > 0.97


def test_covering_finds_a_conjunction_and_ignores_noise():
    rng = np.random.default_rng(3)
    x = rng.random((1500, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.6) & (x[:, 4] <= 0.5)
    found = quality.learn(x, bad)
    covered = np.zeros(len(x), bool)
    for rule in found.rules:
        covered |= rule.covers(x)
    assert (covered == bad).mean() > 0.97 and all(len(r.conditions) <= 4 for r in found.rules)
    assert len(quality.learn(x, rng.random(1500) < 0.5).rules) <= 1
    for empty in (quality.learn(x[:0], bad[:0]), quality.learn(x, np.zeros(1500)), quality.learn(x, np.ones(1500))):
        assert not empty.rules


def test_odd_rows_and_names(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (3, None, 0)], "doc_id LONG, quality INT, toxic INT")
    rules = quality.fit(odd_docs, labels)
    clash = odd_docs.withColumnsRenamed({"lang": "kept", "source": "_stats", "n_chars": "n_words"})
    got = quality.judge(clash, rules)
    assert got.count() == odd_docs.count() and "_stats" in got.columns
    assert quality.judge(no_docs, quality.fit(no_docs, labels.limit(0))).count() == 0
    assert quality.keep(clash, rules).columns == clash.columns
