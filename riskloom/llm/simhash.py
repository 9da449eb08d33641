"""Near duplicates by SimHash, joined in a grid of segment bit counts.

Fingerprints of 64 bits are embedded as the bit counts of their segments.  A differing bit
changes one count by one, so the Manhattan distance of two embeddings is a lower bound of the
Hamming distance: links lie within a small Manhattan ball.  The embedding is cut in parts;
of a distance of at most ``radius`` over all parts, one part has at most ``radius // parts``.
For each part, a fingerprint stands in the grid cell of its counts and looks up the cells next
to it; whoever meets there is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, short_batches
from .components import connected_components

BITS, SEED = 64, 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, A-Z in lower case, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)


def simhash(text: str | None, words: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, words)
    counts, block = np.zeros(BITS, np.int64), 1 << 16
    for i in range(0, len(hashes), block):  # bounded memory for very long texts
        raw = hashes[i:i + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        # Bytes of one place are summed bit by bit: 256-bin counts times the bits of each value.
        for place in range(8):
            counts[8 * place:8 * place + 8] += np.bincount(raw[:, place], minlength=256) @ _BYTE_BITS
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


_BYTE_BITS = np.array([[value >> bit & 1 for bit in range(8)] for value in range(256)], np.int64)


def fingerprints(docs: DataFrame, text: str, name: str, keep: list[Column], words: int = 3) -> DataFrame:
    """``keep`` columns and the fingerprint of each whole text as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, words) for t in batch], np.uint64).view(np.int64))

    return short_batches(docs).select(*keep, of(col(text)).alias(name))


def segment_counts(fingerprint: Column, segments: range, width: int) -> list[Column]:
    """Bit counts of the given segments, each of ``width`` bits."""
    mask = F.lit((1 << width) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(fingerprint, s * width).bitwiseAND(mask)) for s in segments]


def cells(prints: DataFrame, radius: int = 3, width: int = 2, parts: int = 2) -> DataFrame:
    """``part``, ``cell``, ``looks`` and the fingerprint, a row for each cell that it stands in or looks into.

    Two embeddings at most one apart in a part either share a cell or differ by one in a
    single count; the lesser one then looks into the cell of the greater.
    """
    if radius // parts > 1:
        raise ValueError("more parts are needed for this radius")
    per = BITS // width // parts
    out = []
    for p in range(parts):
        counts = segment_counts(F.col("fp"), range(p * per, (p + 1) * per), width)
        bits = (width + 1).bit_length()
        place = [F.lit(1 << (bits * i)).cast("long") for i in range(per)]
        here = sum((F.shiftleft(c.cast("long"), bits * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
        next_to = [F.when(c < width, F.lit(place[i])) for i, c in enumerate(counts)] if radius // parts else []
        steps = F.array_compact(F.array(F.lit(0).cast("long"), *next_to))
        out.append(F.struct(F.lit(p).alias("part"), here.alias("here"), steps.alias("steps")))
    stands = prints.select("fp", F.inline(F.array(*out)))
    return stands.select("fp", "part", "here", F.explode("steps").alias("step")).select(
        "fp", "part", (F.col("here") + F.col("step")).alias("cell"), (F.col("step") > 0).alias("looks")
    )


def _near_in_cells(radius: int):
    """Links within each cell: rows arrive sorted by cell, so a cell's rows are neighbours.

    Only links that connect something new inside a cell are put out (a spanning forest), so
    that the output grows with the rows and not with their pairs.
    """

    def forest(stand: np.ndarray, look: np.ndarray) -> list[tuple[int, int]]:
        nodes = np.unique(np.concatenate([stand, look]))
        parent = np.arange(len(nodes))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        own = np.searchsorted(nodes, stand)
        for k, i in enumerate(own.tolist()):  # one row against all others at a time
            others = np.concatenate([stand[k + 1:], look])
            apart = np.bitwise_count(others ^ stand[k])
            for other in others[(apart <= radius) & (apart > 0)].tolist():
                a, b = root(i), root(int(np.searchsorted(nodes, np.uint64(other))))
                if a != b:
                    parent[b] = a
                    links.append((int(stand[k]), other))
        return links

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def cut(fp, looks, key):
            """Rows of whole cells to links."""
            border = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            begins = np.concatenate([[0], border])
            ends = np.concatenate([border, [len(fp)]])
            stands = np.add.reduceat((~looks).astype(np.int64), begins)
            found = []
            for i in np.flatnonzero((stands > 0) & (ends - begins > 1)).tolist():
                rows, mark = fp[begins[i]:ends[i]], looks[begins[i]:ends[i]]
                found += forest(rows[~mark], rows[mark])
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            looks = batch.column("looks").to_numpy(zero_copy_only=False).astype(bool)
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "cell", "block")], 1)
            if held:
                fp, looks, key = (np.concatenate(x) for x in zip(held, (fp, looks, key)))
            if not len(fp):
                continue
            last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1) if (key != key[-1]).any() else 0
            if last:
                yield cut(fp[:last], looks[:last], key[:last])
            held = (fp[last:], looks[last:], key[last:])
        if held:
            yield cut(*held)

    return run


def near_links(prints: DataFrame, radius: int = 3, width: int = 2, parts: int = 2, block: int = 2048) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other.

    A cell with more than ``block`` fingerprints is dealt as pairs of blocks, each to a
    task of its own: every fingerprint goes to all pairs that its block is in, so no pair
    is missed and no task holds more than two blocks of those standing or looking.
    """
    rows = cells(prints, radius, width, parts)
    crowded = rows.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    rows = rows.join(crowded, ["part", "cell"], "left")
    n = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    # Pair of blocks (i <= j) as i * n + j.
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.least(k, own) * n + F.greatest(k, own))
    rows = rows.withColumn("block", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)))
    dealt = rows.select("part", "cell", "block", "looks", "fp").repartition("part", "cell", "block")
    return dealt.sortWithinPartitions("part", "cell", "block").mapInArrow(_near_in_cells(radius), "a LONG, b LONG").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), *,
    words: int = 3, radius: int = 3, width: int = 2, parts: int = 2, block: int = 2048,
) -> DataFrame:
    """One row for each document: its id, ``fingerprint`` and ``component_id``, and the ``keep`` columns.

    The component is the least id that can be reached by links; equal fingerprints are
    linked, and texts without words (null and empty ones too) share fingerprint 0.  Null
    ids take part, but name a component only if all its ids are null.  Repeated rows stay.
    Fingerprints are taken once and stored; beyond that only distinct ones are compared,
    so thousands of copies weigh as much as one.
    """
    stored = materialize(fingerprints(docs, text, "fp", [col(id_col).alias("id"), *[col(k).alias(f"k{i}") for i, k in enumerate(keep)]], words), "simhash")
    distinct = materialize(stored.groupBy("fp").agg(F.min("id").alias("least")), "distinct-prints")
    rooted = connected_components(near_links(distinct, radius, width, parts, block))
    rooted = materialize(rooted, "components")
    named = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    # A hot fingerprint's rows are many on one side and one row on the other: such a join can be split.
    return stored.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("root").alias("component"), *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)],
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of near duplicates, with all its columns as they were.

    The one of the least id stays, nulls last, then the least hash of the text; of rows
    repeated with the same id and text one stays.  Texts are shuffled once, by their key.
    """
    keyed = docs.select(
        F.struct("*").alias("row"), col(id_col).alias("id"), col(text).alias("text"),
        F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("h"),
    )
    found = near_duplicates(keyed, "id", "text", ("h",), **options)
    # A struct orders nulls first: ids are wrapped so that rows with an id come before others.
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    chosen = found.groupBy("component").agg(F.min(first).alias("first")).select(
        F.col("first.none").alias("none"), F.coalesce("first.id", F.lit(0)).alias("id"), F.col("first.h").alias("h")
    )
    rows = keyed.select("row", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h")
    kept = rows.join(chosen, ["none", "id", "h"], "left_semi").dropDuplicates(["none", "id", "h"])
    return kept.select("row.*")
