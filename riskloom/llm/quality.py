"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text are taken in Arrow batches.  The list is grown from labelled
texts: each rule is a conjunction of thresholds grown on two thirds of the rows that are left
and pruned on the other third; rows that it covers leave, and the next rule is grown.  The
result is an ordered list of Spark conditions, applied without any Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_names, short_batches

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "longest_word", "n_digits", "n_upper", "n_marked_lines", "n_bytes",
)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The STATISTICS of one text; null and empty texts give zeros."""
    raw = (text or "").encode()
    words = raw.split()  # on bytes: exactly the six ASCII white-space characters
    n = len(words)
    n_repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first, inside = {}, bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    inside[i:i + 3] = b"\1\1\1"
                    inside[j:j + 3] = b"\1\1\1"
            n_repeat = sum(inside)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        n, len(text or "") - gone(SPACES), gone(SYMBOLS), len(lines) - len(set(lines)), n_repeat, len(lines),
        len(set(words)), max(map(len, words), default=0), gone(b"0123456789"), gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        sum(x.rstrip()[-1:] in b".!?" for x in lines), len(raw),
    )


@F.pandas_udf(StructType([StructField(n, LongType()) for n in STATISTICS]))
def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_statistics(t) for t in batch], columns=STATISTICS, dtype="int64")


def _share(a: str, b: str):
    return lambda s: F.coalesce(F.try_divide(s[a].cast("double"), s[b].cast("double")), F.lit(0.0))


#: What rules may test: name -> expression over the statistics.
FEATURES = {
    "words": lambda s: s["n_words"].cast("double"),
    "word_length": _share("word_chars", "n_words"),
    "symbol_share": _share("n_symbols", "word_chars"),
    "repeated_line_share": _share("n_dup_lines", "n_lines"),
    "repeated_word_share": _share("n_repeat_words", "n_words"),
    "distinct_word_share": _share("n_distinct_words", "n_words"),
    "longest_word": lambda s: s["longest_word"].cast("double"),
    "digit_share": _share("n_digits", "word_chars"),
    "upper_share": _share("n_upper", "word_chars"),
    "marked_line_share": _share("n_marked_lines", "n_lines"),
    "words_per_line": _share("n_words", "n_lines"),
}


def with_statistics(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct of STATISTICS of each whole text."""
    return short_batches(docs).withColumn(name, _statistics(F.col(text)))


def base_failed(stats: Column) -> Column:
    """Too few words, or over half of them inside repeated three-word windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, is_above, threshold) holds; counts are of the pruning rows."""

    conditions: tuple[tuple[str, bool, float], ...]
    rejected: int
    kept: int

    def column(self, stats: Column) -> Column:
        test = F.lit(True)
        for feature, above, at in self.conditions:
            x = FEATURES[feature](stats)
            test = test & ((x > at) if above else (x <= at))
        return test

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit, names = np.ones(len(x), bool), list(FEATURES)
        for feature, above, at in self.conditions:
            v = x[:, names.index(feature)]
            hit &= (v > at) if above else (v <= at)
        return hit


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def verdict(self, stats: Column) -> Column:
        """True where the first rule that fits, or else the default, keeps the text."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(stats), False) if out is None else out.when(rule.column(stats), False)
        return F.lit(True) if out is None else out.otherwise(True)


def _candidates(x: np.ndarray, steps: int) -> np.ndarray:
    """Thresholds between neighbouring values, at most ``steps`` of them, spread by rank."""
    values = np.unique(x)
    if len(values) < 2:
        return values[:0]
    at = np.unique(np.linspace(0, len(values) - 2, min(steps, len(values) - 1)).astype(int))
    ranks = np.unique(np.quantile(x, np.linspace(0, 1, steps), method="lower"))
    return np.unique(np.concatenate([(values[at] + values[at + 1]) / 2, ranks[:-1]]))


def _grow(x: np.ndarray, bad: np.ndarray, steps: int, most: int) -> list[tuple[int, bool, float]]:
    """Add the condition of the highest information gain until only bad rows are covered."""
    rows, chosen = np.arange(len(x)), []
    while len(chosen) < most and len(rows) and not bad[rows].all():
        p, n = bad[rows].sum(), len(rows)
        best = (1e-9, None)
        for f in range(x.shape[1]):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            hits = np.concatenate([[0], np.cumsum(bad[rows][order])])
            for at in _candidates(v, steps):
                below = np.searchsorted(v[order], at, "right")
                for above, k, q in ((False, below, hits[below]), (True, n - below, p - hits[below])):
                    if q and k < n and (gain := q * (np.log2(q / k) - np.log2(p / n))) > best[0]:
                        best = (gain, (f, above, float(at)))
        if best[1] is None:
            break
        f, above, at = best[1]
        v = x[rows, f]
        at = float(v[v <= at].max() + v[v > at].min()) / 2  # as far from either side as the rows allow
        chosen.append((f, above, at))
        rows = rows[(x[rows, f] > at) if above else (x[rows, f] <= at)]
    return chosen


def learn(
    x: np.ndarray, bad: np.ndarray, *, steps: int = 48, max_conditions: int = 4, max_rules: int = 24,
    min_precision: float = 0.9, min_cover: int = 3,
) -> DecisionList:
    """Sequential covering over labelled feature rows (columns as in FEATURES).

    A rule counts only if, on rows it was not grown on, at least ``min_precision`` of what
    it covers is bad; its last conditions are pruned as long as that does not fall.  No rows,
    or rows of one class only, give an empty list, which keeps everything.
    """
    names, rules = list(FEATURES), []
    # Thirds by rank of the row within its class: the same rows whatever their partitions were.
    order = np.lexsort((*x.T[::-1], bad))
    x, bad = x[order], bad[order].astype(bool)
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and bad[left].any() and not bad[left].all():
        g, q = left & ~prune, left & prune
        conditions = [(names[f], above, at) for f, above, at in _grow(x[g], bad[g], steps, max_conditions)]
        worth = []
        for k in range(1, len(conditions) + 1):
            hit = Rule(tuple(conditions[:k]), 0, 0).covers(x[q])
            p, n = int(bad[q][hit].sum()), int((~bad[q])[hit].sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        if not worth:
            break
        _, k, p, n = max(worth)
        if p < min_cover or p / (p + n) < min_precision:
            break
        rule = Rule(tuple(conditions[:-k]), p, n)
        rules.append(rule)
        left &= ~rule.covers(x)
    return DecisionList(tuple(rules))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality",
    max_labelled: int = 20_000, **options,
) -> DecisionList:
    """Learn a list from at most ``max_labelled`` labelled texts, chosen by a hash of their id.

    Rows without an id or label, and those that the base rule rejects anyway, are not
    learned from; an id labelled both ways counts as bad.
    Only the sample's numbers reach the driver, and the sample's ids, whose number is
    bounded by the parameter, are all that is broadcast.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull())
    named = named.groupBy(F.col(id_col).alias("_id")).agg((F.min(quality) == 0).alias("_bad"))
    sample = named.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    bounded = docs.sparkSession.createDataFrame(sample.collect(), named.schema)
    # An id may have several texts; the first by hash is used, so that the bound holds for texts too.
    texts = (
        docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
        .join(F.broadcast(bounded), "_id")
        .groupBy("_id", "_bad").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    )
    stats = with_statistics(texts, "_stats", "_text")
    stats = stats.where(~base_failed(F.col("_stats")))
    seen = stats.select("_bad", *[f(F.col("_stats")).alias(n) for n, f in FEATURES.items()]).toPandas()
    return learn(seen[list(FEATURES)].to_numpy(float), seen["_bad"].to_numpy(bool), **options)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept`` (these names replace equal ones)."""
    docs = docs.drop(*[c for c in [*STATISTICS, "base_failed", "kept"] if c != text])
    (stats,) = free_names(docs, "_stats")
    s = F.col(stats)
    return with_statistics(docs, stats, text).withColumns(
        {**{n: s[n] for n in STATISTICS}, "base_failed": base_failed(s), "kept": ~base_failed(s) & rules.verdict(s)}
    ).drop(stats)


def keep(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they were."""
    (stats,) = free_names(docs, "_stats")
    s = F.col(stats)
    return with_statistics(docs, stats, text).where(~base_failed(s) & rules.verdict(s)).drop(stats)
