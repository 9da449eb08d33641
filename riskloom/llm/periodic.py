"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A square (a word sequence twice in a row) of period d at i is branching if the word behind it
breaks the period.  Then the suffixes i and i + d lie in different children of the LCP interval
of depth d, so it is enough to take each suffix of all children but the largest and to ask the inverse suffix array
whether the suffixes d before and d behind it lie in the same interval.  Every run ends in one
branching square of its smallest period; rotating the square to the left as far as the words
repeat gives the run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of documents that are sorted together; a longer document goes alone.
CHUNK_WORDS = 1 << 17
#: Suffixes that are tested at a time.
BLOCK = 1 << 20
_FOUND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, kept: array<struct<start: bigint, length: bigint>>>"


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, the first place of each one's group in it, and which groups have several members."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(len(key), np.int64)
    rank[order] = first[group]
    several = np.zeros(len(key), bool)
    several[order] = np.diff(np.append(first, len(key)))[group] > 1
    return order, rank, several


def repeats(key: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """Positions whose next ``words`` words occur again in the same document; ``ends`` holds each one's end."""
    rank, at, done = key, np.arange(len(key)), 0
    ranks = {}
    for step in (1 << b for b in range(words.bit_length())):
        # ranks of ``step`` words, of positions that may still count
        if step == 1:
            _, rank, several = _rank(key)
        else:
            at = at[at + step <= ends[at]]
            half = ranks[step // 2]
            at = at[(half[at] >= 0) & (half[at + step // 2] >= 0)]
            found = np.full(len(key), -1, np.int64)
            if not len(at):
                return at
            _, part, several = _rank(half[at] * (len(key) + 1) + half[at + step // 2])
            found[at] = part
            rank = found
        rank = rank.copy()
        rank[at[~several]] = -1
        at = at[several]
        ranks[step] = rank
        done = step
    if done < words:
        at = at[at + words <= ends[at]]
        rest = ranks[done][at + words - done]
        at = at[rest >= 0]
        if not len(at):
            return at
        _, _, several = _rank(ranks[done][at] * (len(key) + 1) + ranks[done][at + words - done])
        at = at[several]
    return at


def suffix_array(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the place of each, and the words each shares with the one before it.

    Suffixes stop at the end of their document, and no two documents share a key.  Ranks of
    1, 2, 4... words are refined where they tie, and their levels give the shared words.
    """
    n = len(key)
    order, rank, several = _rank(key)
    levels, step = [rank.astype(np.int32)], 1
    todo = np.flatnonzero(several[order])
    while len(todo):
        at = order[todo]
        ahead = at + step
        inside = ahead < ends[at]
        behind = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        both = rank[at] * (n + 1) + behind + 1
        by = np.argsort(both, kind="stable")
        order[todo] = at[by]
        new = np.concatenate([[True], both[by][1:] != both[by][:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank = rank.copy()
        rank[order[todo]] = todo[first][group]
        todo = todo[np.diff(np.append(first, len(todo)))[group] > 1]
        levels.append(rank.astype(np.int32))
        step *= 2
    shared = np.zeros(n + 1, np.int64)
    slots = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[slots - 1], order[slots]
    deep = np.zeros(len(slots), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + deep, b + deep
        fits = (x < ends[a]) & (y < ends[b])
        same = fits & (levels[k][np.where(fits, x, 0)] == levels[k][np.where(fits, y, 0)])
        deep[same] += 1 << k
    shared[slots] = deep
    return order, rank, shared


def smaller_children(shared: np.ndarray) -> np.ndarray:
    """``first, last, left, right, depth`` of all children but the largest, of each LCP interval [left, right].

    ``shared`` has a 0 at its end.  The stack holds open intervals only, no tree is built.
    """
    out = []

    def close(depth: int, left: int, cuts: list[int], right: int) -> None:
        edges = [left, *cuts, right + 1]
        if len(edges) == 3:
            cut = cuts[0]
            first, last = (left, cut - 1) if cut - left <= right + 1 - cut else (cut, right)
            out.append((first, last, left, right, depth))
            return
        sizes = [y - x for x, y in zip(edges, edges[1:])]
        largest = sizes.index(max(sizes))
        out.extend((x, y - 1, left, right, depth) for k, (x, y) in enumerate(zip(edges, edges[1:])) if k != largest)

    stack: list[tuple[int, int, list[int]]] = []
    useful = np.flatnonzero((shared[1:] > 0) | (shared[:-1] > 0)) + 1  # and the zeros that end them
    for slot, depth in zip(useful.tolist(), shared[useful].tolist()):
        left = slot - 1
        while stack and stack[-1][0] > depth:
            deep, left, cuts = stack.pop()
            close(deep, left, cuts, slot - 1)
        if not depth:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(slot)
        else:
            stack.append((depth, left, [slot]))
    return np.array(out, np.int64).reshape(-1, 5)


def branching_squares(key: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``start, period`` of all branching squares, by period and start."""
    order, place, shared = suffix_array(key, ends)
    children = smaller_children(shared)
    sizes = children[:, 1] - children[:, 0] + 1
    found, cut = [], 0
    heads = np.concatenate([[0], np.cumsum(sizes)])
    while cut < len(children):
        stop = max(cut + 1, int(np.searchsorted(heads, heads[cut] + BLOCK, "right")) - 1)
        first, last, left, right, depth = np.repeat(children[cut:stop], sizes[cut:stop], axis=0).T
        slot = first + np.arange(len(first)) - np.repeat(heads[cut:stop] - heads[cut], sizes[cut:stop])
        at = order[slot]
        for other, start, inside in ((at + depth, at, at + depth < ends[at]), (at - depth, at - depth, at - depth >= begins[at])):
            there = place[np.where(inside, other, 0)]
            hit = inside & (there >= left) & (there <= right) & ((there < first) | (there > last))
            found.append(np.stack([depth[hit], start[hit]], 1))
        cut = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 1], both[:, 0]


def _rotated(key: np.ndarray, begin: int, start: int, period: int) -> int:
    """How far left a square can start so that the words before it keep the period."""
    step = 16
    while start > begin:
        m = min(step, start - begin)
        other = np.flatnonzero(key[start - m:start] != key[start - m + period:start + period])
        if len(other):
            return start - m + int(other[-1]) + 1
        start -= m
        step *= 2
    return start


def runs_of(key: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of at least ``least`` words, by start and period."""
    start, period = branching_squares(key, begins, ends)
    # A square that is shorter must at least be rotated by what it lacks.
    for d in range(1, -(-least // 2)):
        mine = np.flatnonzero(period == d)
        drop = np.zeros(len(mine), bool)
        for k in range(1, least - 2 * d + 1):
            before = start[mine] - k
            inside = before >= begins[start[mine]]
            safe = np.where(inside, before, 0)
            drop |= ~(inside & (key[safe] == key[np.where(inside, safe + d, 0)]))
        lasting = np.ones(len(start), bool)
        lasting[mine[drop]] = False
        start, period = start[lasting], period[lasting]
    out, by_end = [], defaultdict(list)
    for i, d in zip(start.tolist(), period.tolist()):
        known = by_end[i + 2 * d]
        # Inside a run of a shorter period that divides this one: the same run again.
        if any(d % p == 0 and s <= i for s, p in known):
            continue
        s = _rotated(key, int(begins[i]), i, d)
        known.append((s, d))
        if i + 2 * d - s >= least:
            out.append((s, i + 2 * d - s, d))
    return sorted((s, n, p) for s, n, p in out)


def _kept(runs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """``start, length`` of stretches of words that no run repeats."""
    out, at = [], 0
    for a, b in sorted((s + p, s + m) for s, m, p in runs):
        if a > at:
            out.append((at, a - at))
        at = max(at, b)
    if n > at:
        out.append((at, n - at))
    return out


def _chunk(words: pa.Array, sizes: np.ndarray, least: int) -> list[tuple[list, list]]:
    """Runs and kept stretches of the documents whose words stand one behind the other."""
    none = [([], [(0, n)] if n else []) for n in sizes.tolist()]
    # Words are numbered, each document's apart from all others'.
    code = words.dictionary_encode(null_encoding="encode")
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)
    if not len(doc):
        return none
    key = doc * (len(code.dictionary) + 1) + code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A run of ``least`` words repeats half of them at least: others have none.
    again = repeats(key, end[doc], -(-least // 2))
    chosen = np.zeros(len(sizes), bool)
    chosen[doc[again]] = True
    if not chosen.any():
        return none
    at = np.flatnonzero(chosen)
    mine = chosen[doc]
    sub_end = np.cumsum(sizes[at])
    sub_begin = sub_end - sizes[at]
    of = np.repeat(np.arange(len(at)), sizes[at])
    for start, length, period in runs_of(key[mine], sub_begin[of], sub_end[of], least):
        k = of[start]
        none[at[k]][0].append((start - int(sub_begin[k]), length, period))
    return [(runs, _kept(runs, n)) if runs else (runs, kept) for (runs, kept), n in zip(none, sizes.tolist())]


def periodic_runs(words: Column, least: int = 12) -> Column:
    """``runs`` (start, length, period) of an array of words, and the stretches ``kept`` when repetitions go.

    A run is a stretch of at least ``least`` words and at least twice its smallest period, that no
    neighbouring word extends; runs come by start, then period.  A word goes if a run has it behind its first period.
    Null or no words give none of either; null words are equal to each other.  Documents do not touch
    each other: repeated rows give equal results, and an empty table gives none.  A document is
    worked on in one task, in memory that grows with its words times the logarithm of the
    longest passage that it repeats.
    """
    if least < 2:
        raise ValueError("a run has at least two words")

    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.array([0 if s is None else s for s in batch.value_lengths().to_pylist()], np.int64)
            flat, heads, found, a = batch.flatten(), np.concatenate([[0], np.cumsum(sizes)]), [], 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(heads, heads[a] + CHUNK_WORDS, "right")) - 1)
                found += _chunk(flat.slice(heads[a], heads[b] - heads[a]), sizes[a:b], least)
                a = b
            yield pa.array(
                [{"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "kept": [dict(zip(("start", "length"), k)) for k in kept]}
                 for runs, kept in found],
                pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                           ("kept", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length")])))]))

    return find(words)


def without_repetitions(words: Column, kept: Column) -> Column:
    """The words of the kept stretches, in order."""
    return F.flatten(F.transform(kept, lambda k: F.slice(words, (k["start"] + 1).cast("int"), k["length"].cast("int"))))


def longest_run(runs: Column) -> Column:
    """The longest run; of equal ones that of the smallest start, then period.  Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
