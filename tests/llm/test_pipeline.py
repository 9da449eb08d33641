"""Every stage of the pipeline against brute force, on its own input."""

import random

import numpy as np
from llm_words import words
from pyspark.sql import functions as F
from test_middle_runs_join import grams, variants
from test_quality import brute
from test_simhash import brute_print, groups

import corpus_pipeline
from riskloom.llm import neardup, quality


def one_of_each(rows):
    """Least ids of groups by fingerprints within three bits or five-word shingle sets with a similarity of at least 0.8."""
    root = groups([brute_print(t) for _, t in rows])
    sets = [grams(t, 5) for _, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def test_near_duplicates_of_both_kinds(spark, odd_docs, no_docs):
    rng = random.Random(1)
    texts = variants(rng, 5, 12, 150, 6) + variants(rng, 3, 8, 40, 2) + ["", " ", "one two", "one two"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("component", F.lit("x")).withColumn("class", F.lit(1))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == one_of_each(rows)
    got = neardup.keep_one(odd_docs).collect()
    assert len(got) == len({(r["doc_id"], r["text"]) for r in got}) and None in {r["doc_id"] for r in got}
    assert neardup.keep_one(no_docs).count() == 0


def test_stages_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    kept = stages[0](spark, docs, sf).cache()
    rules = quality.fit(docs, labels)
    want = set()
    for d, r in rows.items():
        s = quality.text_statistics(r["text"])
        n, _, _, _, repeated = brute(r["text"])
        f = {"words": n, "symbol_share": s[2] / s[1] if s[1] else 0.0}
        assert {c[0] for rule in rules.rules for c in rule.conditions} <= set(f)
        rejected = any(all((f[x] > at) if above else (f[x] <= at) for x, above, at in rule.conditions) for rule in rules.rules)
        if n >= 50 and 100 * repeated <= 50 * n and not rejected:
            want.add(d)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns

    unique = stages[1](spark, kept, sf).cache()
    assert sorted(r["doc_id"] for r in unique.collect()) == one_of_each([(d, rows[d]["text"]) for d in sorted(want)])

    mixed = stages[2](spark, unique, sf).cache()
    assert mixed.columns == docs.columns
    times = mixed.toPandas().groupby(["source", "doc_id"]).size()
    assert times.max() <= 2
    longest = max(len(words(r["text"])) for r in unique.collect())
    for source, total in unique.toPandas().groupby("source")["text"].agg(lambda t: sum(len(words(x)) for x in t)).items():
        used = sum(k * len(words(rows[d]["text"])) for d, k in times[source].items())
        assert used <= 2 * total + longest

    packed = stages[3](spark, mixed, sf).toPandas()
    assert packed["length"].sum() == sum(len(words(r["text"])) + 1 for r in mixed.collect())
    assert (packed.groupby("bin")["length"].sum() <= packed.groupby("bin")["capacity"].first()).all()


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert len(out) and np.isfinite(out["bin_offset"]).all() and out["piece_text"].notna().all()


def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:3]:
            assert stage(spark, docs, sf).columns == docs.columns
            stage(spark, docs, sf).count()
        corpus_pipeline.STAGES[3][1](spark, docs, sf).count()
