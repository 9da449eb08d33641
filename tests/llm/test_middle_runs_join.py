import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_words import low, words
from pyspark.sql import functions as F

from riskloom.llm import countjoin, middle, periodic, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-the-middle -----------------------------------------------------------------------
def cut(doc_id, text, seed=7, rate=100, spm_rate=50, tags=("<P>", "<S>", "<M>")):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    if not text or any(t in text for t in tags) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text or ""
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    x, y, z = ("".join(part) for part in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = tags
    out = s + z + p + x + m + y if h4 % 100 < spm_rate else p + x + s + z + m + y
    return len(lines), "spm" if h4 % 100 < spm_rate else "psm", len(x), len(y), out


def test_middle_query_against_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_fill_in_middle"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, form, prefix, mid, out = cut(r["doc_id"], rows[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, prefix, mid, sha(out))
        assert r["restored_sha256"] == sha(rows[r["doc_id"]] or "")


@pytest.mark.parametrize("error", [1, 20, 126])
def test_index_gives_every_boundary_back(spark, error):
    rng = np.random.default_rng(error)
    texts = ["", "\n", "a", "\n\n\n", "no end", "x\ny", "\U0001f600\né \nz"] + [
        "".join("w" * int(k) + "\n" for k in rng.choice([0, 1, 7, 80, 3000], n)) for n in (1, 2, 40, 700)]
    for t in texts:
        at = middle.boundaries(t)
        ends = [0]
        for line in re.findall(r"[^\n]*\n|[^\n]+", t):
            ends.append(ends[-1] + len(line))
        assert at.tolist() == ends
        segments, residuals = middle.rank_index(at, error)
        assert np.abs(residuals.astype(int)).max() <= error + 1
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").withColumn("index", middle.indexed(F.col("t"), error))
    got = rows.select("t", F.transform(F.sequence(F.lit(0).cast("long"), middle.units(F.col("index"))), lambda k: middle.offset_at(F.col("index"), k)).alias("at"))
    assert all(r["at"] == middle.boundaries(r["t"]).tolist() for r in got.collect())


def test_segments_are_few_where_lines_are_alike():
    assert len(middle.fit_segments(np.arange(0, 10**6, 61))) == 1
    noisy = np.concatenate([[0], np.cumsum(60 + np.random.default_rng(0).integers(-5, 6, 20_000))])
    assert len(middle.fit_segments(noisy)) < 100


def test_middle_rates_sentinels_and_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumnsRenamed({"lang": "form", "source": "row", "n_chars": "index"})
    got = middle.fill_in_middle(clash, seed=3, rate=60, spm_rate=30, sentinels=("[pre]", "{suf}", "(mid)"))
    assert set(clash.columns) - {"form"} < set(got.columns)
    back = got.withColumn("back", middle.restored(F.col("output"), F.col("form"), ("[pre]", "{suf}", "(mid)"))).collect()
    assert len(back) == 12
    for r in back:
        want = cut(r["doc_id"], r["text"], 3, 60, 30, ("[pre]", "{suf}", "(mid)"))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want and r["back"] == (r["text"] or "")
    assert middle.fill_in_middle(no_docs).count() == 0
    with pytest.raises(ValueError):
        middle.fill_in_middle(odd_docs, sentinels=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        middle.fill_in_middle(odd_docs, sentinels=("<P<", "<S>", "<M>"))
    tricky = spark.createDataFrame([(i, f"a<\n<{t}\n<S\n<P\n<M") for i in range(20) for t in ("", "<")], "doc_id LONG, text STRING")
    got = middle.fill_in_middle(tricky).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    assert got.where("back <> text").count() == 0 and got.where("form <> 'plain'").count() == 40


# --- periodic runs ------------------------------------------------------------------------------
def brute_runs(w, least=12):
    """Every stretch that agrees with itself ``p`` further on, its smallest period only."""
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in best.items())


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_runs_query_against_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got) > len(rows) / 12
    for r in got:
        w = looped(r["doc_id"], words(rows[r["doc_id"]]))
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_random_words(spark):
    rng = random.Random(5)
    docs = []
    for i in range(400):
        w = [str(rng.randrange(rng.choice([1, 2, 3, 6]))) for _ in range(rng.choice([0, 1, 5, 12, 30, 70]))]
        if w and i % 2:
            a, p = rng.randrange(len(w)), 1 + rng.randrange(9)
            w = [x if k < a else w[min(a + (k - a) % p, k)] for k, x in enumerate(w)]
        docs.append((i, w))
    table = spark.createDataFrame(docs, "i INT, w ARRAY<STRING>")
    for least in (2, 3, 5, 12):
        got = table.withColumn("f", periodic.periodic_runs(F.col("w"), least)).select("w", "f.*").collect()
        for r in got:
            assert [tuple(x) for x in r["runs"]] == brute_runs(r["w"], least)
            kept = [i for k in r["kept"] for i in range(k["start"], k["start"] + k["length"])]
            gone = {i for s, n, p in brute_runs(r["w"], least) for i in range(s + p, s + n)}
            assert kept == [i for i in range(len(r["w"])) if i not in gone]


def test_suffix_arrays_and_children():
    rng = np.random.default_rng(2)
    key = np.concatenate([rng.integers(0, 3, 80), 10 + rng.integers(0, 2, 50)])
    ends = np.repeat([80, 130], [80, 50])
    order, place, shared = periodic.suffix_array(key, ends)
    suffixes = sorted(range(130), key=lambda i: key[i:ends[i]].tolist())
    assert order.tolist() == suffixes and (order[place] == np.arange(130)).all()
    for a, b, k in zip(suffixes, suffixes[1:], shared[1:]):
        x, y = key[a:ends[a]].tolist(), key[b:ends[b]].tolist()
        assert k == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    children = periodic.smaller_children(shared)
    sizes = children[:, 1] - children[:, 0] + 1
    assert (2 * sizes <= children[:, 3] - children[:, 2] + 1).all() and sizes.sum() < 130 * 8


def test_long_monotonous_texts_and_odd_words(spark):
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    cases = [["x"] * 50_000, list(fib[-1][:900]), None, [], [None] * 13, ["a"] * 11, [None, "a"] * 6]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(cases)], "i INT, w ARRAY<STRING>")
    got = {r["i"]: r for r in rows.withColumn("f", periodic.periodic_runs(F.col("w"))).select("i", "f.*", periodic.longest_run(F.col("f.runs")).alias("best")).collect()}
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 50_000, 1)] and [tuple(x) for x in got[0]["kept"]] == [(0, 1)]
    assert [tuple(x) for x in got[1]["runs"]] == brute_runs(cases[1])
    assert got[2]["runs"] == got[3]["runs"] == got[3]["kept"] == got[5]["runs"] == [] and got[2]["best"] is None
    assert [tuple(x) for x in got[4]["runs"]] == [(0, 13, 1)] and tuple(got[6]["best"]) == (0, 12, 2)
    assert rows.limit(0).select(periodic.periodic_runs(F.col("w"))).count() == 0


# --- count-vector join ----------------------------------------------------------------------------
def grams(text, k=3):
    w = words(low(text))
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def brute_classes(rows, percent=90):
    """component and number of links of each (id, text), pair by pair."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)], links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_join_query_against_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = queries.QUERIES["op13_count_vector_join"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_classes(rows)


def variants(rng, n_clusters, per, length, edits):
    out = []
    for c in range(n_clusters):
        base = [f"c{c}w{rng.randrange(10**6)}" if rng.random() < 0.7 else f"common{rng.randrange(5)}" for _ in range(length)]
        for _ in range(per):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                k = rng.randrange(len(w))
                w[k:k + rng.randrange(2)] = [f"n{rng.randrange(50)}"]
            out.append(" ".join(w))
            base = w if rng.random() < 0.3 else base  # chains, too
    return out


@pytest.mark.parametrize("options", [{"percent": 80}, {"block": 20, "block_grams": 3000}])
def test_dense_clusters_lose_no_link_and_no_count(spark, options):
    rng = random.Random(str(options))
    texts = variants(rng, 3, 90, 120, 4) + variants(rng, 4, 20, 11, 1) + variants(rng, 2, 6, 1500, 30)
    texts += rng.choices(texts, k=60)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = countjoin.jaccard_classes(spark.createDataFrame(rows, "doc_id LONG, text STRING"), **options).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_classes(rows, options.get("percent", 90))


def test_trees_keep_all_that_could_link():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in rng.integers(9, 900, 120)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.03], rng.integers(0, 1 << 63, len(s) // 40, dtype=np.uint64)])) for s in sets[:80]]
    sizes = np.array([len(s) for s in sets])
    forest = countjoin.Forest([countjoin.count_vector(s) for s in sets], sizes, 90)
    seen = 0
    for i, s in enumerate(sets):
        near = set(forest.near(i).tolist())
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            if 100 * both >= 90 * (len(s) + len(t) - both):
                assert j in near
        seen += len(near)
    assert seen < len(sets) * 8  # and leave most others out


def test_join_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumnsRenamed({"lang": "row", "source": "component_id", "n_chars": "h"})
    got = {(r["doc_id"], r["n_shingles"]): r for r in countjoin.jaccard_classes(clash).collect()}
    assert [(r["component_id"], r["n_links"]) for k, r in sorted(got.items(), key=str) if k[0] in (2, 3, 4)] == [(2, 0), (3, 0), (4, 0)]
    # Without line ends both texts are the same words over and over.
    assert (got[1, 5]["component_id"], got[7, 5]["component_id"], got[1, 5]["n_links"]) == (1, 1, 1)
    assert countjoin.jaccard_classes(clash).where("doc_id = 5 and n_links = 1").count() == 2
    nobody = [r for r in got.values() if r["doc_id"] is None]
    assert len(nobody) == 1 and nobody[0]["component_id"] is None and nobody[0]["n_shingles"] == 3
    assert countjoin.jaccard_classes(no_docs).count() == 0
