import numpy as np
import pytest
import xxhash
from llm_words import low, words

from riskloom.llm import components, queries, simhash


def brute_print(text):
    w = words(low(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Least index reachable from each fingerprint, pair by pair."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_against_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = queries.QUERIES["op7_simhash_near_duplicates"](spark, sf).toPandas().sort_values("doc_id")
    prints = [brute_print(t) for _, t in rows]
    assert got["fingerprint"].tolist() == [f"{p:016x}" for p in prints]
    assert got["component_id"].tolist() == [rows[i][0] for i in groups(prints)]


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_dense_clusters_lose_no_link(spark, block):
    rng = np.random.default_rng(block)
    prints = set()
    for center in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(50):
            p = center
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                p ^= 1 << bit
            prints.add(p)
        chain = center
        for bit in rng.permutation(64)[:24].reshape(-1, 3).tolist():  # a long chain of links of three bits
            for b in bit:
                chain ^= 1 << b
            prints.add(chain)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp LONG")
    links = simhash.near_links(frame, block=block)
    found = {r["node"] % (1 << 64): r["root"] for r in components.connected_components(links).collect()}
    got = {}
    for p in prints:
        got.setdefault(found.get(p, p if p < 1 << 63 else p - (1 << 64)), set()).add(p)
    want = {}
    for p, g in zip(prints, groups(prints)):
        want.setdefault(g, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_lower_bound_holds():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * s) & np.uint64(3)) for s in range(32)]).astype(int)
    assert (np.abs(counts(a) - counts(b)).sum(0) <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 901), (901, 900), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "x LONG, y LONG")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 500 for i in range(500, 560)) and got[901] == 900
    none = spark.createDataFrame([], "x LONG, y LONG")
    assert components.connected_components(none).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).toPandas()
    blank = got[got["doc_id"].isin([2, 3, 4])]
    assert len(got) == 12 and set(blank["fingerprint"]) == {"0" * 16} and set(blank["component_id"]) == {2}
    assert got[got["doc_id"].isna()]["component_id"].isna().all()
    clash = odd_docs.withColumnsRenamed({"lang": "component", "source": "row", "n_chars": "none"})
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(-1 if np.isnan(x) else int(x) for x in kept.toPandas()["doc_id"]) == [-1, 1, 2, 5, 6, 8, 9, 10]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
