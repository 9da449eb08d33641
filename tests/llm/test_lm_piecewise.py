import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_words import low, words
from pyspark.sql import functions as F

from riskloom.llm import common, lm, piecewise, queries


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def counts_and_base(rows):
    tokens = lambda t: [*words(low(t)), None]
    c = collections.Counter(w for d, t in rows if not is_held_out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, {d: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows}


@pytest.mark.parametrize("piece_tokens", [1 << 21, 3000])
def test_base_scores_against_brute_force(spark, sf, piece_tokens):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, want = counts_and_base(rows)
    if piece_tokens == 1 << 21:
        got = queries.QUERIES["op8_lm_scoring"](spark, sf)
    else:
        got = lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, piece_tokens=piece_tokens)
    got = got.toPandas().set_index("doc_id")
    assert len(got) == len(rows) and (got["train_tokens"] == n).all()
    for d, (tokens, known, base) in want.items():
        r = got.loc[d]
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (tokens, known, is_held_out(d))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-6)


def brute_scores(rows, base=1.25):
    """Scores of a bigram model that holds every pair, with quantised counts of pairs and histories."""
    tokens = lambda t: [*words(low(t)), None]
    train = [tokens(t) for d, t in rows if not is_held_out(d)]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip([None, *t], t))
    norm = sum(c.values()) + len(c) + 1
    middle = lambda n: base ** (math.floor(math.log(n) / math.log(base) + 1e-9) + 0.5) if n else 0.0

    def p(h, w):
        single = (c[w] + 1) / norm
        return 0.98 * middle(pairs[h, w]) / middle(c[h]) + 0.02 * single if c[h] else single

    return {d: sum(math.log10(p(h, w)) for h, w in zip([None, *tokens(t)], tokens(t))) for d, t in rows}


@pytest.mark.parametrize("piece_tokens", [1 << 21, 2000])
def test_scores_hold_every_pair_whatever_the_pieces(spark, sf, piece_tokens):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_scores(rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    # Bits enough that false positives do not count.
    got = lm.score_documents(docs.repartition(7), held, piece_tokens=piece_tokens, bits_per_entry=64, hashes=16).toPandas().set_index("doc_id")["score"]
    assert len(got) == len(want) and all(math.isclose(got[d], x, rel_tol=1e-7, abs_tol=1e-5) for d, x in want.items())
    # With the query's own bits only false positives differ: of a pair's next level, at most a few in a hundred.
    own = queries.QUERIES["op8_lm_scoring"](spark, sf).toPandas().set_index("doc_id")
    off = np.array([abs(own["score"][d] - x) / own["n_tokens"][d] for d, x in want.items()])
    assert np.median(off) < 0.02 and off.mean() < 0.04


def test_what_is_stored_and_shuffled_is_small():
    """Bytes of every stage, with the pieces that half a GB has: each is on disk when the last one ends."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    held = pa.array([is_held_out(d) for d in table["doc_id"].to_pylist()])
    docs = pa.table({"id": table["doc_id"], "held_out": held, "text": table["text"]}).to_batches(max_chunksize=200)
    size = lambda batches: sum(b.nbytes for b in batches)
    bodies = list(lm._bodies("bigint")[0](docs))
    chunk = pa.array(range(len(bodies)), pa.int64())
    bodies = [pa.RecordBatch.from_arrays([*b.columns, chunk.slice(i, 1)], [*b.schema.names, "chunk"]) for i, b in enumerate(bodies)]
    asked = list(lm._requests(64)[0](bodies))
    rows = pa.Table.from_batches(asked).sort_by("piece").combine_chunks().to_batches()
    answers = list(lm._answers(1.25, 12, 6)[0](rows))
    # Bodies and answers are stored and then shuffled.
    moved = 2 * size(bodies) + size(asked) + 2 * size(answers)
    assert sum(b["n"][0].as_py() for b in bodies) > 300_000
    assert moved < 4 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")


def test_chunks_hold_all_rows_in_order_whatever_the_batches(sf, monkeypatch):
    rows = pq.read_table(f"{sf}/documents.parquet").slice(0, 60).to_pylist()
    docs = [(r["doc_id"], r["text"], is_held_out(r["doc_id"])) for r in rows]
    whole = pa.RecordBatch.from_pydict({"id": [d for d, *_ in docs], "text": [t for _, t, _ in docs], "held_out": [h for *_, h in docs]})
    for rows, most in ((7, 1 << 20), (60, 900), (7, 900), (1, 1)):
        monkeypatch.setattr(lm, "CHUNK_TOKENS", most)
        got = list(lm._chunks(whole.slice(i, rows) for i in range(0, len(docs), rows)))
        assert [d for ids, *_ in got for d in ids.to_pylist()] == [d for d, *_ in docs]
        assert [h for _, held, *_ in got for h in held.to_pylist()] == [h for *_, h in docs]
        assert (np.concatenate([t for *_, t, _ in got]) == np.concatenate([lm.tokens(t) for _, t, _ in docs])).all()
        assert all(sizes.sum() == len(t) and t[:-int(sizes[-1])].size < most for *_, t, sizes in got)
        assert all(len(t) >= most for *_, t, _ in got[:-1])


def test_folded_numbers_come_back():
    rng = np.random.default_rng(2)
    wide = np.sort(rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64, endpoint=True))
    for x in (wide, wide[:1], wide[:0], wide[::-1], np.array([0, 0, 7, 2**64 - 1, 3], np.uint64)):
        back = common.unfolded_rising(common.folded_rising(x))
        assert back.dtype == np.uint64 and back.tolist() == x.tolist()
    for x in (np.array([], np.int64), np.array([0]), np.array([255, 256, 0]), rng.integers(0, 1 << 40, 500)):
        assert common.unfolded(common.folded(x)).tolist() == x.tolist()


def test_pairs_help_on_held_out_texts(spark):
    rng = np.random.default_rng(0)
    follow = {i: rng.choice(200, 4) for i in range(200)}

    def text():
        w, out = int(rng.integers(200)), []
        for _ in range(120):
            out.append(f"w{w}")
            w = int(rng.choice(follow[w]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id LONG, text STRING")
    got = lm.score_documents(docs, F.col("doc_id") % 5 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.5 * got[1]  # log probabilities are negative


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    key, n = np.arange(3000, dtype=np.uint64), rng.geometric(0.02, 3000)
    level = lm.levels_of(n, 1.25)
    f = lm.LogFrequencyFilter.of([(1, key, level), (3, key[:50], level[:50] * 0)], 12, 6)
    found = f.levels(key, 1)
    assert (found >= level).all() and np.mean(found == level) > 0.97
    assert (n <= lm.middle(level, 1.25) * 1.25).all() and (n >= lm.middle(level, 1.25) / 1.25).all()
    assert np.mean(f.levels(np.arange(10**6, 10**6 + 5000, dtype=np.uint64), 1) > 0) < 0.03
    assert np.mean(f.levels(key[:50], 3) > 0) < 0.2
    assert not lm.LogFrequencyFilter.of([], 12, 6).levels(key[:5], 1).any()


def test_lm_odd_rows(spark, odd_docs, no_docs):
    held = F.coalesce(F.col("doc_id") == 9, F.lit(False))
    got = lm.score_documents(odd_docs, held).toPandas()
    assert len(got) == 12 and (got[got["doc_id"].isin([2, 3, 4])]["n_tokens"] == 1).all()
    assert np.isfinite(got["score"]).all() and (got["score"] <= 0).all()
    assert lm.score_documents(no_docs, held).count() == 0
    none = lm.score_documents(odd_docs, F.lit(True)).toPandas()
    assert (none["train_tokens"] == 0).all() and (none["n_known"] == 0).all() and (none["score"] == none["base_score"]).all()


def brute_neighbours(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        yield d, t, t[:len(t) - k] + after[:k], after


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    if a == b:
        return 1.0
    (i, *x), (j, *y) = a.split(":"), b.split(":")
    near = lambda p, q: 1 - levenshtein(p, q) / max(len(p), len(q), 1) if p or q else 0.0
    gap = int(i) - int(j)
    return {0: max(near(x[0], y[0]), near(x[1], y[1])), 1: near(x[0], y[1]), -1: near(x[1], y[0])}.get(gap, 0.0)


def test_piecewise_query_against_brute_force(spark, sf):
    got = queries.QUERIES["op10_piecewise_fingerprints"](spark, sf).toPandas().set_index("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(rows)
    for k, (d, t, e, after) in enumerate(brute_neighbours(rows)):
        r = got.loc[d]
        mine = piecewise.fingerprint(t.encode())
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (mine, piecewise.fingerprint(e.encode()))
        if k % 10 == 0:
            assert math.isclose(r["near_edited"], likeness(mine, piecewise.fingerprint(e.encode())), abs_tol=1e-12)
            assert math.isclose(r["near_next"], likeness(mine, piecewise.fingerprint(after.encode())), abs_tol=1e-12)
    assert got["near_edited"].median() > 0.55 > 0.2 > got["near_next"].median()


def test_signatures_stay_short_and_local():
    rng = np.random.default_rng(4)
    for n in (0, 1, 6, 7, 40, 500, 5000, 300_000):
        raw = rng.integers(32, 127, n, dtype=np.uint8).tobytes()
        level, fine, coarse = piecewise.fingerprint(raw).split(":")
        assert len(fine) <= piecewise.LONGEST + 1 and len(coarse) <= len(fine)
        if n >= 500:
            assert len(fine) > piecewise.LONGEST / 3
            cut = piecewise.fingerprint(raw[:n // 2] + b"changed" + raw[n // 2:]).split(":")
            assert cut[0] == level and levenshtein(cut[1], fine) <= 4
    for raw in (b"a" * 100_000, b"ab" * 50_000, b"\0" * 3):
        assert len(piecewise.fingerprint(raw)) < 300


def test_repeated_passages_keep_their_boundaries(spark):
    rng = np.random.default_rng(7)
    line = lambda k: bytes(rng.integers(97, 123, k, dtype=np.uint8).tolist()) + b"\n"
    one, two, three = line(60), line(45), line(90)
    new = b"".join(line(50) for _ in range(300))
    monotonous = {"one": one * 400, "two": (one + two) * 300, "three": (three + one + two) * 500, "mixed": new + one * 900}
    prints = {k: piecewise.fingerprint(v) for k, v in monotonous.items()}
    for k, raw in monotonous.items():
        level, fine, coarse = prints[k].split(":")
        assert 10 < len(fine) <= piecewise.LONGEST + 1 and 4 < len(coarse) <= len(fine)
        cut = len(raw) - len(raw) // 3
        assert likeness(prints[k], piecewise.fingerprint(raw[:cut] + new[:len(raw) // 3])) > 0.5
        assert likeness(prints[k], piecewise.fingerprint(raw[:cut] + b"edited" + raw[cut:])) > 0.6
    # Other repetitive texts do not look alike, also where there is one piece only.
    assert all(likeness(prints[a], piecewise.fingerprint(line(70) * 400)) < 0.3 for a in prints)
    single = [piecewise.fingerprint(bytes([c]) * 9000) for c in range(97, 123)]
    assert len(set(single)) == 26 and max(likeness(a, b) for i, a in enumerate(single) for b in single[:i]) < 0.7
    assert single == [piecewise.fingerprint(bytes([c]) * 9000) for c in range(97, 123)]


def test_piecewise_odd_rows(spark, odd_docs, no_docs):
    got = piecewise.neighbour_fingerprints(odd_docs).toPandas()
    assert len(got) == 12 and got["edited_fingerprint"].notna().all() and got["next_fingerprint"].notna().all()
    assert got[got["doc_id"].isin([1, 7])]["fingerprint"].nunique() == 1
    assert piecewise.neighbour_fingerprints(no_docs).count() == 0
    one = piecewise.neighbour_fingerprints(odd_docs.where("doc_id = 9")).toPandas()
    assert one["next_fingerprint"].tolist() == one["fingerprint"].tolist()
