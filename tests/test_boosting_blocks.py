import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.operators import boosting


def drawn_table(seed, n):
    """A date's parts, a category's slots and a number, with few rows that are not repeated."""
    rng = np.random.default_rng(seed)
    day, kind = rng.integers(0, 30, n), rng.integers(0, 9, n)
    x = np.column_stack([day, day % 7, day // 7, kind[:, None] == np.arange(9), rng.integers(0, 4, n) / 4]).astype(float)
    return x, day * 0.1 + (kind == 3) * 2.0 - x[:, -1] * (kind > 5)


def entries(x, bins):
    row, slot = np.nonzero(x)
    order = np.lexsort([row, slot])
    at = bins.places(slot[order], x[row[order], slot[order]])
    keep = at != (bins.start[:-1] + bins.usual)[slot[order]]
    return row[order][keep], at[keep]


@pytest.mark.parametrize("most", [65_536, 5])
def test_block_sums_equal_row_by_row_sums(monkeypatch, most):
    """A row has a number for each bundle of slots, not one for each slot, and equal rows are worked out once."""
    monkeypatch.setattr(boosting, "MOST_PATTERNS", most)
    monkeypatch.setattr(boosting, "SEEN_ROWS", 50)
    x, y = drawn_table(1, 400)
    x, y = np.tile(x, (5, 1)), np.tile(y, 5)
    edges = [np.unique(c)[:-1] for c in x.T]
    start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    bins = boosting.Bins(edges, start, np.array([int(np.searchsorted(e, 0.0)) for e in edges]))
    key, setting = np.arange(len(x), dtype=np.int64), boosting.Setting(1, 1, 0.1, row_share=0.6)
    block = boosting._Block.of(len(x), *entries(x, bins), bins, y, np.ones(len(x)), key, 1)
    assert len(block.y) == len(np.unique(x, axis=0)) < len(x) / 4 and sorted(block.keys) == key.tolist()
    if most > 5:
        assert len(block.codes) < x.shape[1] / 2
    hit = boosting._drawn(key, 42, 0) < 0.6
    times = block.drawn(setting, 0)
    assert times.sum() == hit.sum()
    value = np.rint(block.y * 1000)
    half = np.arange(len(block.y)) % 2 == 0
    out = np.zeros((2, 2, bins.total + 1), np.int64)
    block.sums([value * times, times], [(1, np.flatnonzero(half)), (0, np.flatnonzero(~half))], out)
    table = out.sum(0)
    seen = np.add.reduceat(table[:, :-1], start[:-1], axis=1)
    table[:, start[:-1] + bins.usual] += table[:, -1:] - seen
    for slot, e in enumerate(edges):
        code = np.searchsorted(e, x[hit, slot])
        for side, v in enumerate([np.rint(y[hit] * 1000), np.ones(hit.sum())]):
            assert np.array_equal(table[side, start[slot]:start[slot + 1]], np.bincount(code, v, len(e) + 1))
    low = block.low(start, bins.usual)
    tree = boosting.Tree()
    tree.add(0.0, 0.0)
    for slot, e in enumerate(edges):
        tree.slot[0], tree.bin[0] = slot, len(e) // 2
        if len(e):
            assert low(tree, 0, None).sum() == len({tuple(r) for r in x[np.searchsorted(e, x[:, slot]) <= len(e) // 2].tolist()})


def test_trees_do_not_hang_on_blocks_or_on_how_vectors_are_stored(spark, monkeypatch):
    x, y = drawn_table(2, 300)
    x, y = np.tile(x, (4, 1)), np.tile(y, 4)
    width = x.shape[1]
    sparse = lambda r: Vectors.sparse(width, [(int(i), float(r[i])) for i in np.flatnonzero(r)])
    settings = [boosting.Setting(5, 3, 0.3, 0.7, 0.8), boosting.Setting(3, 2, 0.3)]
    found = []
    for block_rows, most, form in ((131_072, 65_536, 0), (131_072, 65_536, 1), (70, 4, 2)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(boosting, "MOST_PATTERNS", most)
        vectors = [sparse(r) if form == 1 or form == 2 and i % 2 else Vectors.dense(r) for i, r in enumerate(x)]
        rows = spark.createDataFrame([(i, v, float(a)) for i, (v, a) in enumerate(zip(vectors, y))], ["id", "features", "y"]).repartition(3)
        models = boosting.fit_many(rows, settings, boosting.SQUARED, "y", key=F.xxhash64("id"))
        found.append([(t.slot, t.bin, t.value) for m in models for t in m.trees])
    assert found[0] == found[1] == found[2]
