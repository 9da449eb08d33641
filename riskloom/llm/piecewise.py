"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes marks boundaries wherever it is extreme; the bytes between two
boundaries give one letter each.  The boundary density halves from level to level, and a
text takes the finest level at which its signature fits.  A fingerprint has the letters of
that level and of the next coarser one, so that texts of up to twice the length compare.
An edit only changes the letters of the pieces that it touches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Letters of a signature, by the low six bits of a piece's checksum.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LONGEST, FINEST = 7, 128, 2
_FACTORS = np.array([pow(0x9E3779B1, WINDOW - 1 - j, 1 << 32) for j in range(WINDOW)], np.uint32)
_SCRAMBLE = np.array([(i * 0x85EBCA6B + 0x27D4EB2F) % (1 << 32) for i in range(256)], np.uint32)
_SCRAMBLE ^= _SCRAMBLE >> np.uint32(15)


def _rolling(raw: bytes) -> np.ndarray:
    """Hash of each seven-byte window, evenly spread over 32 bits; none for shorter texts."""
    v = _SCRAMBLE[np.frombuffer(raw, np.uint8)]
    n = len(v) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = v[:n] * _FACTORS[0]
    for j in range(1, WINDOW):
        h += v[j:j + n] * _FACTORS[j]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return h


def _letters(raw: bytes, ends: np.ndarray) -> str:
    """A letter for each piece; a text that is a single piece has five, so that such texts seldom look alike by chance."""
    view, begin, out = memoryview(raw), 0, []
    for end in ends.tolist():
        out.append(LETTERS[zlib.crc32(view[begin:end]) & 63])
        begin = end
    if not out and raw:
        check = zlib.crc32(raw)
        return "".join(LETTERS[check >> 6 * i & 63] for i in range(5))
    if begin < len(raw):
        out.append(LETTERS[zlib.crc32(view[begin:]) & 63])
    return "".join(out)


def _strength(h: np.ndarray) -> np.ndarray:
    """Level up to which each window is a boundary.

    The leading ones of its hash, and for windows that have come before in the text the factors of two in how often:
    the second, fourth, ... of equal windows last one, two, ... levels longer.
    """
    bits = lambda x: np.frexp(x.astype(np.float64))[1].astype(np.int64)  # noqa: E731 - bit length
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = np.flatnonzero(new)
    turn = np.empty(len(h), np.int64)
    turn[order] = np.arange(len(h)) - first[np.cumsum(new) - 1] + 1
    return 32 - bits(~h) + bits(turn & -turn) - 1


def fingerprint(raw: bytes) -> str:
    """``level:letters:coarser letters`` of a whole text; the empty text gives ``2::``.

    A level-k boundary follows a window whose hash is among the highest 1/2^k; boundaries
    of a level are also those of all finer ones.  The level is the least from FINEST on
    with at most LONGEST boundaries, so no text loses any of its bytes, however long or monotonous it is.
    In a passage that repeats itself all boundaries have equal hashes; half of them go from level to level there, too,
    so it keeps its share of the letters.
    """
    h = _rolling(raw)
    at = np.flatnonzero(h >= np.uint32((1 << 32) - (1 << (32 - FINEST))))
    if not len(at):
        return f"{FINEST}:{_letters(raw, at)}:{_letters(raw, at)}"
    strength = _strength(h[at])
    # Boundaries of each level and all above it.
    count = np.cumsum(np.bincount(strength)[::-1])[::-1]
    level = max(FINEST, int(np.argmax(np.append(count, 0) <= LONGEST)))
    fine, coarse = at[strength >= level], at[strength > level]
    return f"{level}:{_letters(raw, fine + WINDOW)}:{_letters(raw, coarse + WINDOW)}"


def likeness(a: Column, b: Column) -> Column:
    """Likeness 0..1 of two fingerprints: 1 - edit distance / longer signature.

    Signatures of one level are compared, the best if there are two; 0 if levels are more
    than one apart, 1 for equal fingerprints, null if one is null.
    """
    x, y = F.split(a, ":"), F.split(b, ":")
    of = lambda parts, i: F.try_element_at(parts, F.lit(i))
    gap = of(x, 1).cast("int") - of(y, 1).cast("int")

    def near(p: Column, q: Column) -> Column:
        longer = F.greatest(F.length(p), F.length(q))
        return F.when(longer == 0, 0.0).otherwise(1.0 - F.levenshtein(p, q) / longer)

    best = (
        F.when(gap == 0, F.greatest(near(of(x, 2), of(y, 2)), near(of(x, 3), of(y, 3))))
        .when(gap == 1, near(of(x, 2), of(y, 3)))
        .when(gap == -1, near(of(x, 3), of(y, 2)))
        .otherwise(0.0)
    )
    return F.when(a == b, 1.0).otherwise(best)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()),
    # Only for the rows at a slice's ends, whose neighbours are in other slices:
    ("part", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("text", pa.string()),
])
_DDL = (
    "doc_id LONG, n_chars LONG, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
    "next_fingerprint STRING, part INT, is_first BOOLEAN, is_last BOOLEAN, text STRING"
)


def edited(text: str, following: str) -> str:
    """The last third of the text's characters replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _pair(text: str, following: str) -> tuple[str, str]:
    raw = edited(text, following).encode()
    return hashlib.sha256(raw).hexdigest(), fingerprint(raw)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slice in order; each but the last is edited with the row that follows it."""
    rows, before, part, first = [], None, None, True

    def flush():
        nonlocal rows
        out = pa.RecordBatch.from_pylist(rows, _OUT)
        rows = []
        return out

    def finish(row, following=None):
        doc_id, text, own, is_first = row
        out = dict(doc_id=doc_id, n_chars=len(text), fingerprint=own, is_first=is_first, is_last=following is None)
        if following:
            sha, ours = _pair(text, following[1])
            out |= dict(edited_sha256=sha, edited_fingerprint=ours, next_fingerprint=following[2])
        if following is None or is_first:
            out |= dict(part=part, text=text)
        rows.append(out)

    for batch in batches:
        for doc_id, text, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
            row = (doc_id, text, fingerprint(text.encode()), first)
            part, first = p, False
            if before:
                finish(before, row)
            before = row
        if rows:
            yield flush()
    if before:
        finish(before)
        yield flush()


def _last_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_pair(*x) for x in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_chars"), pa.array([d[0] for d in done], pa.string()),
             batch.column("fingerprint"), pa.array([d[1] for d in done], pa.string()), batch.column("next_fingerprint")],
            schema=pa.schema(list(_OUT)[:6]),
        )


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each whole text, of the text edited with its successor, and of the successor.

    Documents follow each other by descending id (null ids last, equal ids by a hash of the
    text); the last is followed by the first, a single one by itself.  A null text is empty, and an empty table
    gives an empty result.  Ids are cast to longs.  A very long text is worked on whole, in memory that grows with it.
    Texts are range-partitioned once.  Each slice is walked in order, holding two texts; the
    ends of slices, two texts each, meet their neighbours in a second, small step.
    """
    h = F.xxhash64("text")
    ordered = [F.desc_nulls_last("doc_id"), h]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    walked = (
        plain.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        .withColumn("part", F.spark_partition_id()).mapInArrow(_walk, _DDL)
    )
    stored = materialize(walked, "piecewise")
    inner = stored.where(~F.col("is_last")).select(*[f.name for f in list(_OUT)[:6]])

    # One row for each slice that has rows: its number and that of the next one, round about.
    numbers = stored.where("is_first").select("part")
    along = Window.orderBy("part")
    numbers = numbers.select(
        "part", F.coalesce(F.lead("part").over(along), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    heads = stored.where("is_first").select(
        F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_fingerprint")
    )
    lasts = stored.where("is_last").drop("next_fingerprint").join(numbers, "part").join(heads, "next_part")
    ends = lasts.select("doc_id", "n_chars", "text", "following", "fingerprint", "next_fingerprint")
    return inner.unionByName(ends.mapInArrow(_last_pairs, ", ".join(_DDL.split(", ")[:6])))
