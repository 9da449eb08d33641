"""Second-order boosted trees with leaf penalties, grown on quantised features.

Rows are stored once in blocks and kept with the margins of every setting that is being fitted.  In a block
slots whose bins come in few patterns, as those of one category or of one date, are a bundle, of which a row has one number,
and rows that are equal in all of them take part once.  Each level of each tree takes the sums of gradients and hessians by (node,
feature bin): one job of a single stage serves the open levels of all settings at the same time.  Only those sums, one
table for each of a number of tasks that follows the cores, reach the driver, which picks the splits.  The smaller
child is counted and its sibling is what is left of the parent.  Sums are whole numbers in fixed point, so
partitioning and retries change nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LOGISTIC, SQUARED = "logistic", "squared"
#: Rounds after which the margins of all rows are kept anew, so that a level evaluates few trees.
REFRESH = 4
#: Refreshes after which the rows are stored with their margins, so that a lost executor costs few steps.
STORE = 16
LEAST_GAIN = 1e-6
#: Rows that predictions are made for at a time.
BATCH_ROWS = 16_384
#: Rows of a block, whose sums of 34 bits a row a double holds exactly; equal ones in it take part once.
BLOCK_ROWS = 131_072
#: Rows that a block's bundles are chosen by, about; any choice gives the same sums.
SEEN_ROWS = 4_096
#: Patterns that bundles are joined up to, and the most that 16 bits can number.
PATTERNS, MOST_PATTERNS = 1_024, 65_536
#: Rows of a task, where the cores alone would make larger ones.
TASK_ROWS = 2_000_000
#: Tasks above this number add up their sums among themselves first.
MOST_TABLES = 64


@dataclass(frozen=True)
class Setting:
    """How one ensemble is grown: L1 and L2 leaf penalties, the least hessian of a child, shares of rows and columns of a tree."""

    rounds: int
    depth: int
    rate: float
    row_share: float = 1.0
    feature_share: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_child_weight: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes of a tree, the root first; ``left`` is -1 in leaves, whose ``value`` includes the rate."""

    slot: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in zip((self.slot, self.bin, self.cut, self.left, self.right, self.value, self.gain, self.cover),
                             (-1, -1, 0.0, -1, -1, value, 0.0, cover)):
            column.append(x)
        return len(self.slot) - 1

    def leaves(self, low) -> list[tuple[int, np.ndarray]]:
        """Each leaf with its rows; ``low(node, rows)`` tells which rows go left."""
        out, stack = [], [(0, None)]
        while stack:
            node, rows = stack.pop()
            if self.left[node] < 0:
                out.append((node, rows))
                continue
            goes = low(node, rows)
            rows = np.arange(len(goes)) if rows is None else rows
            stack += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]
        return out


def _add_leaf_values(trees: Iterable[Tree], low, out: np.ndarray) -> np.ndarray:
    for tree in trees:
        for node, rows in tree.leaves(lambda n, r, t=tree: low(t, n, r)):
            out[slice(None) if rows is None else rows] += tree.value[node]
    return out


@dataclass
class BoostedTrees:
    """A fitted ensemble: ``base`` and the leaf values add up to the margin."""

    objective: str
    base: float
    width: int
    trees: list[Tree]
    features: str = "features"

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self._margins(len(x), x.T)

    def _margins(self, n: int, columns) -> np.ndarray:
        """Of ``n`` rows whose values ``columns`` has by slot."""
        low = lambda t, n, r: (columns[t.slot[n]] if r is None else columns[t.slot[n]][r]) <= t.cut[n]
        return _add_leaf_values(self.trees, low, np.full(n, self.base))

    def slots(self) -> list[int]:
        """Those that any tree tests."""
        return sorted({s for t in self.trees for s, left in zip(t.slot, t.left) if left >= 0})

    def margin(self, features: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            used = model.slots()
            for batch in batches:
                parts = [batch.slice(a, BATCH_ROWS) for a in range(0, len(batch), BATCH_ROWS)]
                yield pa.array(np.concatenate([model._margins(len(p), dict(zip(used, columns_of(p, model.width, used)))) for p in parts] or [np.zeros(0)]))

        return of(F.unwrap_udt(features))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, and for classifiers ``probability`` as a vector of both classes."""
        m = self.margin(F.col(self.features))
        if self.objective == SQUARED:
            return df.withColumn("prediction", m)
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return df.withColumn("_margin", m).withColumn("_p", p).withColumns(
            {"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") >= 0.5).cast("double")}
        ).drop("_margin", "_p")

    def gain_importance(self) -> np.ndarray:
        """Mean loss reduction of each slot's splits, adding up to one; 0 for slots without a split."""
        total, splits = np.zeros(self.width), np.zeros(self.width)
        for tree in self.trees:
            for slot, left, gain in zip(tree.slot, tree.left, tree.gain):
                if left >= 0:
                    total[slot] += gain
                    splits[slot] += 1
        mean = total / np.maximum(splits, 1)
        return mean / mean.sum() if mean.sum() else mean


# --- bins --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Bins:
    """Upper edges of all bins but the last of each slot; ``start`` is a slot's first bin among all."""

    edges: list[np.ndarray]
    start: np.ndarray
    usual: np.ndarray

    @property
    def total(self) -> int:
        return int(self.start[-1])

    def places(self, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bin, among all, of each value; slots in order.  A value on an edge is below it."""
        out, ends = np.empty(len(slot), np.int32), np.searchsorted(slot, np.arange(len(self.edges) + 1))
        for s, e in enumerate(self.edges):
            if ends[s] < ends[s + 1]:
                out[ends[s]:ends[s + 1]] = np.searchsorted(e, value[ends[s]:ends[s + 1]], "left") + self.start[s]
        return out


def stored_values(x: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of the numbers that unwrapped vectors store, by slot; what a sparse one leaves out is 0."""
    indices, values = x.field("indices"), x.field("values")
    counts = values.value_lengths().to_numpy(zero_copy_only=False)
    row, value = np.repeat(np.arange(len(x), dtype=np.int32), counts), values.flatten().to_numpy(zero_copy_only=False)
    if indices.null_count:
        slot, dense = np.empty(len(value), np.int32), np.repeat(indices.is_null().to_numpy(zero_copy_only=False), counts)
        slot[~dense] = indices.flatten().to_numpy(zero_copy_only=False)
        slot[dense] = np.tile(np.arange(width), indices.null_count)
    else:
        slot = indices.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(slot.astype(np.uint16) if width <= 65_536 else slot, kind="stable")
    return row[order], slot[order], value[order]


def columns_of(x: pa.StructArray, width: int, slots: Sequence[int]) -> np.ndarray:
    """The values of some slots of unwrapped vectors, a row for each slot."""
    row, slot, value = stored_values(x, width)
    out = np.zeros((len(slots), len(x)))
    for column, a, b in zip(out, np.searchsorted(slot, slots, "left"), np.searchsorted(slot, slots, "right")):
        column[row[a:b]] = value[a:b]
    return out


def _at(vector: Column, slot: int) -> Column:
    """A slot's value in an unwrapped vector."""
    place = F.nullif(F.array_position(vector["indices"], F.lit(slot)).cast("int"), F.lit(0))
    sparse = F.coalesce(F.element_at(vector["values"], place), F.lit(0.0))
    return F.when(vector["indices"].isNull(), F.get(vector["values"], F.lit(slot))).otherwise(sparse)


def fit_bins(rows: DataFrame, features: str, width: int, most: int = 256) -> Bins:
    """Edges at all values of slots with at most ``most`` of them, else at quantiles from a mergeable sketch."""
    x = rows.select(F.unwrap_udt(F.col(features)).alias("x"))

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            row, slot, value = stored_values(batch.column("x"), width)
            some = value != 0
            slot, value = slot[some], value[some]
            ends = np.searchsorted(slot, np.arange(width + 1))
            at, found = [], []
            for s in range(width):
                told = known.setdefault(s, set())
                if None in told:  # more than can be told of
                    continue
                new = set(np.unique(value[ends[s]:ends[s + 1]]).tolist())
                if ends[s + 1] - ends[s] < batch.num_rows:
                    new.add(0.0)
                new -= told
                if len(told) + len(new) > most:
                    new = {None}
                told |= new
                at += [s] * len(new)
                found += new
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found, pa.float64())], ["slot", "value"])

    seen = materialize(x.mapInArrow(values, "slot INT, value DOUBLE").distinct(), "seen")  # read twice
    # A task tells of ``most`` values of a slot at most, and a slot with more is cut by quantiles.
    crowded = seen.groupBy("slot").agg((F.count_if(F.col("value").isNull()) + F.count_if(F.col("value").isNotNull()) > most).alias("many"),
                                      F.count_if(F.col("value").isNull()).alias("left_out"))
    many = sorted(r["slot"] for r in crowded.where(F.col("many") | (F.col("left_out") > 0)).collect())
    edges = [np.zeros(0)] * width
    for r in seen.where(~F.col("slot").isin(many)).groupBy("slot").agg(F.array_sort(F.collect_set("value")).alias("v")).collect():
        edges[r["slot"]] = np.array(r["v"][:-1], float)
    if many:
        probs = [k / most for k in range(1, most)]
        cut = x.agg(*[F.percentile_approx(_at(F.col("x"), s), probs, 100_000).alias(f"s{s}") for s in many]).first()
        for s in many:
            edges[s] = np.unique(np.array(cut[f"s{s}"] or [], float))
    start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    usual = np.array([int(np.searchsorted(e, 0.0, "left")) for e in edges])
    return Bins(edges, start, usual)


# --- growing -------------------------------------------------------------------------------------
def _soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _score(g, h, s: Setting):
    return _soft(g, s.reg_alpha) ** 2 / np.maximum(h + s.reg_lambda, 1e-300)


def leaf_weight(g: float, h: float, s: Setting) -> float:
    """Best value of a leaf: -soft(G, alpha) / (H + lambda)."""
    return float(-_soft(g, s.reg_alpha) / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0


def _drawn(key: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A uniform number of each row key, another one each turn."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1342543DE82EF95) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


class _Grower:
    """One ensemble while it grows: finished trees since the last refresh, and the open tree."""

    def __init__(self, setting: Setting, bins: Bins):
        self.s, self.bins = setting, bins
        self.trees: list[Tree] = []
        self.stored = 0
        self.begin()

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.s.rounds

    @property
    def recent(self) -> list[Tree]:
        return self.trees[self.stored:]

    def begin(self) -> None:
        self.turn, width = len(self.trees), len(self.bins.edges)
        rng = np.random.default_rng([self.s.seed, self.turn])
        chosen = rng.permutation(width)[:max(1, int(self.s.feature_share * width))]
        self.allowed = np.zeros(width, bool)
        self.allowed[chosen] = True
        self.tree, self.level = Tree(), 0
        self.tree.add(0.0, 0.0)
        self.open, self.sums = [0], {}
        self.counted, self.sibling = [0], {}

    def grow(self, found: dict[int, tuple[np.ndarray, np.ndarray]], scale: tuple[float, float]) -> None:
        """Splits of the open level, from the sums of the nodes that were counted."""
        s, tree, last = self.s, self.tree, self.bins.start[1:] - 1
        for node in self.counted:
            self.sums[node] = found.get(node, (np.zeros(self.bins.total, np.int64), np.zeros(self.bins.total, np.int64)))
        for node, (parent, other) in self.sibling.items():
            self.sums[node] = tuple(a - b for a, b in zip(parent, self.sums[other]))
        following, counted, sibling = [], [], {}
        slot_of = np.repeat(np.arange(len(last)), np.diff(self.bins.start))
        for node in self.open:
            exact = self.sums[node]
            # Whole numbers until the last step, so that equal parts of rows have equal gains; every slot adds up to the node.
            total_g, total_h = (float(v[:self.bins.start[1]].sum() / k) for v, k in zip(exact, scale))
            if node == 0:
                tree.cover[0], tree.value[0] = total_h, s.rate * leaf_weight(total_g, total_h, s)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in exact]
            begin, end = self.bins.start[:-1][slot_of], self.bins.start[1:][slot_of]
            low_g, low_h = ((v[1:] - v[begin]) / k for v, k in zip(sums, scale))
            high_g, high_h = ((v[end] - v[1:]) / k for v, k in zip(sums, scale))
            fits = self.allowed[slot_of] & (low_h >= s.min_child_weight) & (high_h >= s.min_child_weight) & (low_h > 0) & (high_h > 0)
            fits[last] = False
            if not fits.any():
                continue
            gain = np.where(fits, _score(low_g, low_h, s) + _score(high_g, high_h, s) - _score(total_g, total_h, s), -np.inf)
            best = int(np.argmax(gain))
            if gain[best] < LEAST_GAIN:
                continue
            slot = int(slot_of[best])
            tree.slot[node], tree.bin[node] = slot, best - int(self.bins.start[slot])
            tree.cut[node] = float(self.bins.edges[slot][tree.bin[node]])
            tree.gain[node] = float(gain[best])
            children = [tree.add(s.rate * leaf_weight(x, y, s), float(y)) for x, y in ((low_g[best], low_h[best]), (high_g[best], high_h[best]))]
            tree.left[node], tree.right[node] = children
            small, big = children if low_h[best] <= high_h[best] else children[::-1]
            following += children
            counted.append(small)
            sibling[big] = (exact, small)
        self.level += 1
        self.open, self.counted, self.sibling, self.sums = following, counted, sibling, {}
        if not following or self.level >= s.depth:
            self.trees.append(tree)
            if not self.done:
                self.begin()


def _gradients(objective: str, margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == SQUARED:
        return (margin - y) * weight, weight
    p = 1.0 / (1.0 + np.exp(-margin))
    return (p - y) * weight, np.maximum(p * (1.0 - p), 1e-16) * weight


def _joint(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> tuple[np.ndarray, int]:
    """Numbers, from 0 without gaps, of the pairs of two columns of numbers below ``n_a`` and ``n_b``."""
    pair = a * n_b + b
    if n_a * n_b > max(1 << 16, 8 * len(a)):
        values, of = np.unique(pair, return_inverse=True)
        return of, len(values)
    number = np.zeros(n_a * n_b, np.intp)
    number[pair] = 1
    np.cumsum(number, out=number)
    return (number - 1)[pair], int(number[-1]) if len(number) else 0


class _Levels:
    """The bins of some rows by slot, as small numbers: 0 where the bin is the usual one."""

    def __init__(self, n: int, row: np.ndarray, at: np.ndarray, bins: Bins):
        self.n, self.row, self.at, self.start = n, row, at, bins.start
        self.ends = np.searchsorted(at, bins.start)  # entries are in the order of their slots

    def of(self, slot: int) -> tuple[np.ndarray, int]:
        a, b = self.ends[slot:slot + 2]
        out = np.zeros(self.n, np.intp)
        seen = self.at[a:b] - self.start[slot]
        used = np.zeros(int(self.start[slot + 1] - self.start[slot]), np.intp)
        used[seen] = 1
        number = np.cumsum(used)
        out[self.row[a:b]] = number[seen]
        return out, int(number[-1]) + 1

    def held(self) -> np.ndarray:
        return np.flatnonzero(self.ends[1:] > self.ends[:-1])


def _bundles(levels: _Levels) -> list[list[int]]:
    """Slots that few patterns of bins are found in together, by some of the rows; any choice gives the same sums.

    A slot joins the bundle that it adds least patterns to, if those are no more than it has bins of its own: slots
    of one category, or of one date.  Then bundles are joined while their patterns stay at most ``PATTERNS``.
    """
    found: list[tuple[np.ndarray, int, list[int]]] = []
    for slot in levels.held().tolist():
        code, n = levels.of(slot)
        best = None
        for k, (other, m, _) in enumerate(found):
            joined, total = _joint(other, m, code, n)
            if total - m < n and (best is None or total - m < best[2]):
                best = k, joined, total - m
                if total == m:
                    break
        if best is None:
            found.append((code, n, [slot]))
        else:
            k, joined, more = best
            found[k] = joined, found[k][1] + more, [*found[k][2], slot]
    out: list[tuple[np.ndarray, int, list[int]]] = []
    for code, n, slots in sorted(found, key=lambda f: -f[1]):
        best = None
        for k, (other, m, _) in enumerate(out):
            if m < PATTERNS:
                joined, total = _joint(other, m, code, n)
                if total <= PATTERNS and (best is None or total < best[2]):
                    best = k, joined, total
        if best is None:
            out.append((code, n, slots))
        else:
            k, joined, total = best
            out[k] = joined, total, out[k][2] + slots
    return [slots for _, _, slots in out]


@dataclass
class _Block:
    """Distinct rows: the pattern of each in every bundle of slots, the bins of the patterns, and what rows carry.

    Pattern numbers of a bundle go from 0 and are told apart by ``first``, the bundle's first number among all.  ``pattern`` has those in
    each bin but the usual one of its slot, bins in order.  ``keys`` are of all rows; those of a distinct one begin at ``begin``.
    """

    codes: list[np.ndarray]
    first: np.ndarray
    bundle: np.ndarray
    pattern: np.ndarray
    ends: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    margins: np.ndarray

    @classmethod
    def of(cls, n: int, row: np.ndarray, at: np.ndarray, bins: Bins, y: np.ndarray, weight: np.ndarray, key: np.ndarray, settings: int) -> "_Block":
        """From the bins of rows where they are not the usual ones, by slot."""
        levels = _Levels(n, row, at, bins)
        step = max(1, n // SEEN_ROWS)
        some = row % step == 0
        codes: list[np.ndarray] = []
        slots_of = _bundles(_Levels(-(-n // step), row[some] // step, at[some], bins))
        shown = {s for slots in slots_of for s in slots}
        rest = [s for s in levels.held().tolist() if s not in shown]
        if rest:  # none of the chosen rows has more than the usual bin of them
            slots_of.append(rest)
        bundle, first, patterns, places = np.zeros(len(bins.edges), np.int32), [0], [], []

        def close(code: np.ndarray, count: int, slots: list[int]) -> None:
            example = np.zeros(count, np.int32)
            example[code] = np.arange(n, dtype=np.int32)
            for s in slots:
                a, b = levels.ends[s:s + 2]
                r = row[a:b]
                is_example = example[code[r]] == r
                patterns.append(code[r[is_example]] + first[-1])
                places.append(at[a:b][is_example])
            bundle[slots] = len(codes)
            codes.append(code.astype(np.uint16))
            first.append(first[-1] + count)

        for slots in slots_of:
            code, count, taken = np.zeros(n, np.intp), 1, []
            for s in slots:
                joined, total = _joint(code, count, *levels.of(s))
                if total > MOST_PATTERNS:
                    close(code, count, taken)
                    taken = []
                    joined, total = levels.of(s)
                code, count = joined, total
                taken.append(s)
            close(code, count, taken)
        # Equal rows take part once, with their number.
        order = np.lexsort([*codes, weight, y])
        new = np.ones(n, bool)
        for v in (y, weight, *codes):
            v = v[order]
            new[1:] &= v[1:] == v[:-1]
        new[1:] = ~new[1:]
        begin = np.flatnonzero(new)
        rows = order[begin]
        at_all, pattern = (np.concatenate(v) if v else np.zeros(0, np.int32) for v in (places, patterns))
        by_bin = np.argsort(at_all, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at_all, minlength=bins.total))]).astype(np.int32)
        return cls([c[rows] for c in codes], np.array(first), bundle, pattern[by_bin].astype(np.int32), ends, y[rows], weight[rows],
                   key[order], begin, np.zeros((settings, len(rows))))

    def low(self, start: np.ndarray, usual: np.ndarray):
        """Which rows go left at a node of a tree."""
        def goes(tree: Tree, node: int, rows: np.ndarray | None) -> np.ndarray:
            slot, cut = tree.slot[node], tree.bin[node]
            first, middle, last = self.ends[[start[slot], start[slot] + cut + 1, start[slot + 1]]]
            if first == last:
                return np.full(len(self.y) if rows is None else len(rows), usual[slot] <= cut)
            b = self.bundle[slot]
            left = np.full(self.first[b + 1] - self.first[b], usual[slot] <= cut)
            if usual[slot] <= cut:
                left[self.pattern[middle:last] - self.first[b]] = False
            else:
                left[self.pattern[first:middle] - self.first[b]] = True
            return left[self.codes[b] if rows is None else self.codes[b][rows]]

        return goes

    def drawn(self, setting: Setting, turn: int) -> np.ndarray | None:
        """How many of the rows that each distinct one stands for are drawn for a tree; None where each is one."""
        alone = len(self.keys) == len(self.y)
        if setting.row_share >= 1:
            return None if alone else np.diff(np.append(self.begin, len(self.keys))).astype(float)
        hit = _drawn(self.keys, setting.seed, turn) < setting.row_share
        return hit.astype(float) if alone else np.add.reduceat(hit, self.begin, dtype=np.int32).astype(float)

    def sums(self, v: Sequence[np.ndarray], nodes: Sequence[tuple[int, np.ndarray | None]], out: np.ndarray) -> None:
        """Add the sums of gradients and hessians ``v`` by bin to ``out``, for each place's rows; behind the bins, of all its rows."""
        k = len(out)
        if nodes[0][1] is None:
            rows, place = slice(None), 0
            whole = [np.array([x.sum()]) for x in v]
        else:
            rows = np.concatenate([r for _, r in nodes])
            place = np.repeat([p for p, _ in nodes], [len(r) for _, r in nodes])
            v = [x[rows] for x in v]
            whole = [np.bincount(place, weights=x, minlength=k) for x in v]
        held = np.flatnonzero(self.ends[1:] > self.ends[:-1])
        found = np.empty((2, k, self.first[-1]))
        for code, a, b in zip(self.codes, self.first, self.first[1:]):
            at = code[rows]
            if k > 1:
                at = at + place * (b - a)
            for side, x in enumerate(v):
                found[side, :, a:b] = np.bincount(at, weights=x, minlength=k * (b - a)).reshape(k, b - a)
        # Sums of a block are whole numbers that a double holds exactly; those of a task may not be.
        for side in range(2):
            if len(held):
                out[:, side, held] += np.add.reduceat(found[side][:, self.pattern], self.ends[held], axis=1).astype(np.int64)
            out[:, side, -1] += whole[side].astype(np.int64)


def _level_sums(state: RDD, growers: list[_Grower], bins: Bins, objective: str, scale: tuple[float, float]) -> dict:
    """Sums of gradients and hessians by bin for the counted nodes of all growers."""
    # Only what the tasks need travels with them.
    work = [(i, g.recent, g.tree, {node: k for k, node in enumerate(g.counted)}, g.turn, g.s) for i, g in enumerate(growers) if not g.done]
    width, start, usual = bins.total + 1, bins.start, bins.usual

    def run(blocks: Iterable[_Block]) -> Iterator[list[np.ndarray]]:
        sums = [np.zeros((len(counted), 2, width), np.int64) for _, _, _, counted, _, _ in work]
        for block in blocks:
            low = block.low(start, usual)
            for held, (i, recent, tree, counted, turn, s) in zip(sums, work):
                nodes = [(counted[n], r) for n, r in tree.leaves(lambda n, r: low(tree, n, r)) if n in counted]
                if not nodes:
                    continue
                g, h = _gradients(objective, _add_leaf_values(recent, low, block.margins[i].copy()), block.y, block.weight)
                v = [np.rint(g * scale[0]), np.rint(h * scale[1])]
                times = block.drawn(s, turn)
                block.sums(v if times is None else [x * times for x in v], nodes, held)
        yield sums

    def both(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [x + y for x, y in zip(a, b)]

    tables = state.mapPartitions(run)
    if state.getNumPartitions() > MOST_TABLES:
        summed = tables.treeReduce(both)
    else:
        summed = [sum(parts) for parts in zip(*tables.collect())]
    out: dict = {}
    for held, (i, _, _, counted, _, _) in zip(summed, work):
        for node, place in counted.items():
            table = held[place]
            # Rows whose bin is the usual one are what is left of the node.
            seen = np.add.reduceat(table[:, :-1], start[:-1], axis=1)
            table[:, start[:-1] + usual] += table[:, -1:] - seen
            out[i, node] = (table[0, :-1], table[1, :-1])
    return out


def fit_many(
    rows: DataFrame, settings: Sequence[Setting], objective: str, target: str, features: str = "features", weight: Column | None = None,
    key: Column | None = None, most_bins: int = 256,
) -> list[BoostedTrees]:
    """One ensemble for each setting, all grown side by side on the same rows.

    ``features`` is a vector without nulls; rows with a null target are left out.  Rows are drawn for a tree by a hash
    of ``key`` (by default of all columns), so reruns agree and equal keys go together.
    The start is the mean for squared errors, and for the logistic loss the margin that one
    Newton step from zero gives.  Rows are kept in executor memory, or on their disks; every few refreshes they are stored in the shared folder, so a
    lost executor costs at most the refreshes since.
    """
    if any(s.depth < 1 or s.rounds < 0 or s.depth > 14 for s in settings):
        raise ValueError("depth goes from 1 to 14")
    first = rows.select(F.size(vector_to_array(F.col(features))).alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    width, n_settings = first["n"], len(settings)
    bins = fit_bins(rows, features, width, most_bins)
    h = F.xxhash64(*[c for c in rows.columns if c != features]) if key is None else key
    plain = rows.where(F.col(target).isNotNull()).select(
        F.unwrap_udt(F.col(features)).alias("x"), F.col(target).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"), h.cast("long").alias("key"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Equal rows come into one block, or, where they are more than it holds, into some.
    parts = max(cores, -(-rows.count() * 5 // (4 * BLOCK_ROWS)))
    plain = plain.repartitionByRange(parts, F.xxhash64("x", "y", "weight"), "key")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list) -> pa.RecordBatch:
            n = [len(p[2]) for p in parts]
            row = np.concatenate([p[0] + a for p, a in zip(parts, np.cumsum([0, *n[:-1]]))])
            at, y, weight, key = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
            by_slot = np.argsort(at.astype(np.uint16) if bins.total <= 65_536 else at, kind="stable")
            made = _Block.of(sum(n), row[by_slot], at[by_slot], bins, y, weight, key, n_settings)
            whole = pa.array([0, sum(n)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([pickle.dumps(made, 5)], pa.binary()), *[pa.ListArray.from_arrays(whole, pa.array(v)) for v in (y, weight)]],
                ["block", "y", "weight"])

        parts, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                if n and n + part.num_rows > BLOCK_ROWS:
                    yield block(parts)
                    parts, n = [], 0
                row, slot, value = stored_values(part.column("x"), width)
                at = bins.places(slot, value)
                unusual = at != (bins.start[:-1] + bins.usual)[slot]
                parts.append((row[unusual], at[unusual], *[part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "key")]))
                n += part.num_rows
        if n:
            yield block(parts)

    coded = materialize(plain.mapInArrow(encode, "block BINARY, y ARRAY<DOUBLE>, weight ARRAY<DOUBLE>"), "binned")
    y, w = F.col("y"), F.col("weight")
    # Sums in fixed point, and the bounds that the scale follows from.
    stats = coded.select(F.inline(F.arrays_zip("y", "weight"))).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y * w).cast("decimal(38,12)")).cast("double").alias("yw"),
        F.sum(w.cast("decimal(38,12)")).cast("double").alias("w"), F.max(w).alias("most_w"), F.max(F.abs(y)).alias("most_y")).first()
    if not stats["n"]:
        raise ValueError("no rows to fit on")
    mean = stats["yw"] / stats["w"] if stats["w"] else 0.0
    base = mean if objective == SQUARED else 4.0 * (mean - 0.5)
    bits = max(8, min(34, 61 - int(stats["n"]).bit_length()))
    most_w = stats["most_w"] or 1.0
    most_g = most_w * (4.0 * (stats["most_y"] or 1.0) if objective == SQUARED else 1.0)
    scale = (2.0**bits / most_g, 2.0**bits / most_w)

    def begin(block: _Block) -> _Block:
        block.margins = np.full((n_settings, len(block.y)), float(base))
        return block

    tasks = cores * -(-int(stats["n"]) // (TASK_ROWS * cores))
    kept = [_blocks(coded.select("block").repartition(tasks)).map(begin).persist(StorageLevel.MEMORY_AND_DISK)]
    growers = [_Grower(s, bins) for s in settings]
    refreshes = 0
    try:
        while not all(g.done for g in growers):
            found = _level_sums(kept[-1], growers, bins, objective, scale)
            while len(kept) > 1:  # what the kept rows came from
                kept.pop(0).unpersist()
            for i, g in enumerate(growers):
                if not g.done:
                    g.grow({node: v for (j, node), v in found.items() if j == i}, scale)
            if any(len(g.recent) >= REFRESH and not g.done for g in growers):
                refreshes += 1
                fresh = _with_margins(kept[-1], growers, bins)
                if refreshes % STORE == 0:
                    stored = rows.sparkSession.createDataFrame(fresh.map(lambda b: (pickle.dumps(b, 5),)), "block BINARY")
                    fresh = _blocks(materialize(stored, "margins").repartition(tasks))
                kept.append(fresh.persist(StorageLevel.MEMORY_AND_DISK))
                for g in growers:
                    g.stored = len(g.trees)
    finally:
        for rdd in kept:
            rdd.unpersist()
    return [BoostedTrees(objective, float(base), width, g.trees, features) for g in growers]


def _blocks(stored: DataFrame) -> RDD:
    return stored.rdd.map(lambda row: pickle.loads(row[0]))


def _with_margins(state: RDD, growers: list[_Grower], bins: Bins) -> RDD:
    recent, start, usual = [g.recent for g in growers], bins.start, bins.usual

    def run(block: _Block) -> _Block:
        low = block.low(start, usual)
        block.margins = np.stack([_add_leaf_values(trees, low, m.copy()) for trees, m in zip(recent, block.margins)])
        return block

    return state.map(run)
