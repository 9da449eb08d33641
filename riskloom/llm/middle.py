"""Fill-in-the-middle: texts cut at line boundaries that a learned rank index finds.

The offsets of all line boundaries of a text grow with their rank.  Line segments are fitted to
them so that none lies further than ``error`` characters from its prediction, and what remains
is stored, a byte for each boundary.  A cut at rank k is then the prediction of the segment that
covers k plus the stored residual: the exact offset, without looking at the text again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cols, short_batches

#: Farthest that a boundary may lie from its prediction; residuals of rounded ones still fit a byte.
ERROR = 100
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_INDEX = "struct<segments: array<struct<rank: int, offset: bigint, slope: double>>, residuals: array<tinyint>>"


def boundaries(text: str | None) -> np.ndarray:
    """Code-point offsets of the start of the text and of the end of each of its lines."""
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends]).astype(np.int64)


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> list[tuple[int, int, float]]:
    """``rank, offset, slope`` of segments that together predict every offset within ``error``.

    A segment starts in a boundary and runs on while some slope serves all that it covers.
    """
    out, start, n = [], 0, len(offsets)
    while start < n:
        low, high, at, reach = -np.inf, np.inf, start + 1, 32
        while at < n:
            run = np.arange(at - start, min(at + reach, n) - start)
            rise = offsets[at:at + len(run)] - offsets[start]
            lows = np.maximum(low, np.maximum.accumulate((rise - error) / run))
            highs = np.minimum(high, np.minimum.accumulate((rise + error) / run))
            fit = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(run)
            if fit:
                low, high = lows[fit - 1], highs[fit - 1]
            at += fit
            if fit < len(run):
                break
            reach *= 2
        out.append((start, int(offsets[start]), float((low + high) / 2) if at > start + 1 else 0.0))
        start = at
    return out


def rank_index(offsets: np.ndarray, error: int = ERROR) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Segments of all offsets, and what each offset differs from its prediction."""
    segments = fit_segments(offsets, error)
    starts = np.array([s[0] for s in segments])
    of = np.repeat(np.arange(len(segments)), np.diff(np.append(starts, len(offsets))))
    slopes = np.array([s[2] for s in segments])[of]
    predicted = offsets[starts][of] + np.floor(slopes * (np.arange(len(offsets)) - starts[of]) + 0.5).astype(np.int64)
    return segments, (offsets - predicted).astype(np.int8)


def indexed(text: Column, error: int = ERROR) -> Column:
    """The rank index of the line boundaries of each text."""
    if not 1 <= error <= 126:
        raise ValueError("residuals are stored in a byte: error goes from 1 to 126")

    @F.arrow_udf(_INDEX)
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            segments, residuals = [], []
            for value in batch:
                found, rest = rank_index(boundaries(value.as_py()), error)
                segments.append(found)
                residuals.append(rest)
            ends = lambda parts: pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
            rank, offset, slope = zip(*[s for part in segments for s in part]) if len(segments) else ((), (), ())
            flat = pa.StructArray.from_arrays(
                [pa.array(rank, pa.int32()), pa.array(offset, pa.int64()), pa.array(slope, pa.float64())], ["rank", "offset", "slope"])
            rest = pa.array(np.concatenate(residuals) if residuals else np.zeros(0, np.int8), pa.int8())
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends(segments), flat), pa.ListArray.from_arrays(ends(residuals), rest)], ["segments", "residuals"])

    return build(text)


def units(index: Column) -> Column:
    """Number of lines of an indexed text."""
    return (F.size(index["residuals"]) - 1).cast("long")


def offset_at(index: Column, rank: Column) -> Column:
    """Exact offset of the boundary behind ``rank`` lines: prediction and correction."""
    segment = F.element_at(F.filter(index["segments"], lambda s: s["rank"] <= rank), -1)
    predicted = segment["offset"] + F.floor(segment["slope"] * (rank - segment["rank"]).cast("double") + 0.5)
    return predicted + F.get(index["residuals"], rank.cast("int"))


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    p, s, m = sentinels
    if len({p, s, m}) < 3 or not all((p, s, m)):
        raise ValueError("three different sentinels are needed")
    firsts = {x[0] for x in (p, s, m)}
    if any(c in firsts for x in (p, s, m) for c in x[1:]):
        raise ValueError("a sentinel's first character may stand nowhere else in a sentinel")
    return p, s, m


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text before the transformation, from output and form alone."""
    p, s, m = _checked(sentinels)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    back, front, mid = parts(s, p)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(front, mid, back)).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, seed: int = 7, rate: int = 100, spm_rate: int = 50,
    sentinels: Sequence[str] = SENTINELS, error: int = ERROR,
) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Two cuts between lines and the form are drawn from the sha256 of ``seed:id``, so reruns agree and equal
    ids are cut alike.  ``rate`` percent of documents are transformed, ``spm_rate`` percent
    of them with the suffix first.  Empty texts and those that hold a sentinel stay as they
    are: form plain, no numbers of characters.  A null text is empty, a null id is no digits; repeated
    rows come out each, an empty table as an empty one.  Very long texts need four bytes a
    character and an index byte a line.  The result names replace columns of the same names.
    Nothing is shuffled.
    """
    p, s, m = _checked(sentinels)
    docs = docs.drop(*[c for c in ("n", "form", "prefix_chars", "middle_chars", "output") if c not in (id_col, text)])
    if {id_col, text} & {"n", "form", "prefix_chars", "middle_chars", "output"}:
        raise ValueError("rename the id or text column: it has the name of a result")
    plain = short_batches(docs).select(
        F.struct(*cols(docs.columns)).alias("row"), F.coalesce(col(text), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256).alias("drawn"),
    )
    h = [F.conv(F.substring("drawn", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    found = plain.withColumn("index", indexed(F.col("text"), error)).withColumn("n", units(F.col("index")))
    holds = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when((F.length("text") == 0) | holds | (h[2] % 100 >= rate), PLAIN).when(h[3] % 100 < spm_rate, SPM).otherwise(PSM)
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    cut = found.select(
        "row", "text", "n", form.alias("form"),
        offset_at(F.col("index"), F.least(a, b)).alias("first"), offset_at(F.col("index"), F.greatest(a, b)).alias("second"),
    )
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle = F.substring(F.col("text"), F.lit(1), first), F.substring(F.col("text"), first + 1, second - first)
    suffix = F.substring(F.col("text"), second + 1, F.length("text"))
    output = (
        F.when(F.col("form") == PSM, F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("form") == SPM, F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(F.col("text"))
    )
    moved = F.col("form") != PLAIN
    return cut.select(
        "row.*", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"),
        F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"),
    )
