"""Best-fit packing into bins of several permitted capacities.

Items are placed longest first, each in the open bin that it leaves the least room in.  If it
fits in none, a bin is opened at the capacity whose cost for each token that it can be filled
with is least, judged by the lengths that are still to come.  At the end every bin shrinks to
the least permitted capacity that holds what it got.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, cols, free_names, short_batches

CAPACITIES = (256, 512, 1024, 2048, 4096)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bin_cost(capacity: int) -> float:
    """Cost of training on a bin: its tokens, padding included, and a fixed share for each bin."""
    return capacity + 64.0


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost):
    """Bin number, offset in the bin and bin capacity for each length.

    Lengths of 0 take no room: bin -1, capacity 0.  Equal lengths are placed in the given
    order.  No length may exceed the greatest capacity.
    """
    capacities = sorted(capacities)
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and lengths.max() > capacities[-1]:
        raise ValueError("longer than the greatest capacity")
    bins, offsets = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    left = np.bincount(lengths, minlength=1).tolist()  # how many of each length are still to come
    coming = sum(1 << n for n, k in enumerate(left) if k and n)  # as a bit set of lengths
    rooms: dict[int, list[int]] = {}  # free room -> open bins
    free = 0  # bit set of free rooms
    sizes, used = [], []
    fits = {}  # least capacity that holds so much

    def held_by(n: int) -> int:
        if n not in fits:
            fits[n] = next(c for c in capacities if c >= n)
        return fits[n]

    def opening(n: int) -> int:
        best = None
        for c in capacities:
            if c < n:
                continue
            room, below = c - n, coming
            while room > 0 and (below := below & ((1 << (room + 1)) - 1)):
                longest = below.bit_length() - 1
                room -= longest * min(left[longest], room // longest)
                below &= (1 << longest) - 1
            full = c - room
            price = (cost(held_by(full)) / full, -c)
            if best is None or price < best:
                best = price
        return -best[1]

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n == 0:
            break
        left[n] -= 1
        if not left[n]:
            coming &= ~(1 << n)
        roomy = free >> n
        if roomy:
            room = n + (roomy & -roomy).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
        else:
            room, b = opening(n), len(sizes)
            sizes.append(room)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            rooms.setdefault(room, []).append(b)
            free |= 1 << room
    final = np.array([held_by(n) for n in used] + [0], np.int64)
    return bins, offsets, final[bins]


def _repeats_apart(hashes: list[int], part: int, seen: dict[int, int]) -> list[int]:
    """Row hashes of partition ``part``, changed for the second and further rows of one hash.

    Which hashes come out does not hang on the order of rows, so a retried task gives the
    same ones.  First rows keep theirs in the first 1,024 partitions, and share a change in
    each 1,024 more, so at most that many rows of one hash stay together.
    """
    out = []
    for h in hashes:
        k = seen[h]
        seen[h] = k + 1
        salt = (part, k) if k else (part >> 10, 0)
        out.append(xxhash.xxh64_intdigest(struct.pack("<3q", h, *salt)) - (1 << 63) if any(salt) else h)
    return out


def pieces(docs: DataFrame, text: str, keep: Sequence[str], longest: int, with_text: bool, apart: bool = False) -> DataFrame:
    """Documents cut to pieces of at most ``longest`` tokens: words, and an end behind the last one.

    Columns: ``keep``, ``piece``, ``start`` (first token), ``length`` and, if asked for,
    ``piece_text``; the pieces of a text add up to the whole text.  A null or empty text
    has one piece, its end.  With ``apart`` the last of ``keep`` is a hash of the row, in
    which repeated rows are told apart; a task holds the hashes of its rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(int)
        for batch in batches:
            if apart:
                changed = _repeats_apart(batch.column(names[-1]).to_pylist(), TaskContext.get().partitionId(), seen)
                batch = batch.set_column(len(names) - 1, names[-1], pa.array(changed, pa.int64()))
            row, start, length, piece, texts = [], [], [], [], []
            for i, value in enumerate(batch.column("_text")):
                t = value.as_py() or ""
                n = len(t.encode().split()) + 1
                cuts = range(0, n, longest)
                row += [i] * len(cuts)
                start += cuts
                piece += range(len(cuts))
                length += [min(longest, n - a) for a in cuts]
                if with_text:
                    if len(cuts) == 1:
                        texts.append(t)
                    else:
                        begins = [m.start() for k, m in enumerate(_WORD.finditer(t)) if k % longest == 0 and k]
                        edges = [0, *begins, len(t)]
                        parts = [t[a:b] for a, b in zip(edges, edges[1:])]
                        texts += parts + [""] * (len(cuts) - len(parts))
            out = batch.select(names).take(pa.array(row, pa.int64()))
            more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            more += [pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*out.columns, *more], [*names, "piece", "start", "length", *(["piece_text"] if with_text else [])])

    plain = short_batches(docs).select(*[c.alias(f"k{i}") for i, c in enumerate(cols(keep))], F.col(f"`{text}`").alias("_text"))
    names = plain.columns[:-1]
    ddl = [f"{n} {t}" for n, t in plain.dtypes[:-1]] + ["piece INT", "start LONG", "length LONG"] + (["piece_text STRING"] if with_text else [])
    return plain.mapInArrow(run, ", ".join(ddl))


def pack_documents(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), *, with_text: bool = False,
    capacities: Sequence[int] = CAPACITIES, rows_per_bucket: int = 4096,
) -> DataFrame:
    """One row for each piece of each document: ``keep``, piece, start, length, bin, capacity, bin_offset(, piece_text).

    Documents are dealt by a hash of their kept columns and text to buckets of bounded
    size, which are packed on their own; the more documents, the more buckets.  Rows
    repeated in a partition are dealt apart, by their number in it.  Null and
    empty texts are one end token.  Repeated rows are packed each; an empty table gives
    no bins.  The names of the result must not be among ``keep``.
    """
    if clash := {"piece", "start", "length", "bin", "capacity", "bin_offset", "piece_text"} & set(keep):
        raise ValueError(f"rename {sorted(clash)}")
    buckets = bucket_count(docs.count(), rows_per_bucket)
    h = F.xxhash64(*cols(keep), F.col(f"`{text}`"))
    (mark,) = free_names(docs, "_h")
    dealt = pieces(docs.withColumn(mark, h), text, [*keep, mark], max(capacities), with_text, apart=True)
    names = [f"k{i}" for i in range(len(keep))]
    last = f"k{len(keep)}"
    dealt = dealt.withColumn("bucket", bucket_of(F.col(last), buckets))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", last, "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, capacity = pack(rows["length"].to_numpy(), capacities)
        return rows.assign(bin=(rows["bucket"].to_numpy(np.int64) << 32) + bins, capacity=capacity, bin_offset=offsets).drop(columns=["bucket", last])

    types = dict(dealt.dtypes)
    out = [*names, "piece", "start", "length", *(["piece_text"] if with_text else [])]
    ddl = [f"{n} {types[n]}" for n in out] + ["bin LONG", "capacity LONG", "bin_offset LONG"]
    packed = dealt.groupBy("bucket").applyInPandas(fill, ", ".join(ddl))
    return packed.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], *[F.col(c) for c in [*out[len(names):], "bin", "capacity", "bin_offset"]])
