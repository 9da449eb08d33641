"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spans(text: Column) -> Column:
    """What stands between single white-space characters; empty between two of them."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ", -1)


def words_of(text: Column) -> Column:
    """The words of a text in order; none of a null one."""
    return F.array_remove(_spans(text), "")


def n_words(text: Column) -> Column:
    """Number of words of a text as long; null counts as no words."""
    return F.size(F.array_remove(_spans(text), "")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word, 1 at least; the whole text if it has fewer."""
    places = F.filter(F.transform(_spans(text), lambda s, i: F.when(s != "", i + 1)), lambda i: i.isNotNull())
    last = F.try_element_at(places, n.cast("int"))
    upto = F.length(F.array_join(F.slice(_spans(text), F.lit(1), last), " "))
    return F.when(last.isNull(), text).otherwise(F.substring(text, F.lit(1), upto))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until no column of ``df`` has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its plain name, even with dots in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``rows`` rows.

    Whole texts are kilobytes each, so the default of 10,000 rows makes Python workers
    hold hundreds of megabytes, which they keep while later stages run.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def bucket_count(rows: int, rows_per_bucket: int = 2048) -> int:
    """Buckets for ``rows`` rows; grows with the input so that no bucket does."""
    return max(1, -(-rows // rows_per_bucket))


def unit(hash64: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(hash64, 12).cast("double") + 0.5) / float(1 << 52)


def bucket_of(hash64: Column, buckets: int) -> Column:
    return F.floor(unit(hash64) * buckets).cast("int")


def prefix_sums(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], value: str, name: str
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, along ``bucket`` and then ``order``.

    ``group`` and ``bucket`` columns must not be null.  Windows over rows only span a
    bucket, whose size the caller bounds; the window over a whole group sees one row per
    bucket.  Rows that tie on ``order`` should be alike, as either may come first.  Rows whose ``bucket`` is told by
    what they hold share one if they are equal in all of it.
    """
    keys = [*group, bucket]
    total, start, inside_ = free_names(df, "_total", "_start", "_inside")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.sum(value).alias(total)).select(
        *keys, F.coalesce(F.sum(total).over(along), F.lit(0)).alias(start)
    )
    summed = df.withColumn(inside_, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, keys).withColumn(name, F.col(start) + F.col(inside_)).drop(start, inside_)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of at least 0 in the fewest bytes for each, and how many those are."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or numbers.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def folded(numbers: np.ndarray) -> bytes:
    """Numbers of at least 0, compressed: first the low bytes of all, then the next ones, in as many bytes as the largest needs."""
    width = next(w for w in range(1, 9) if w == 8 or int(numbers.max(initial=0)) < 1 << 8 * w)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unfolded(raw: bytes) -> np.ndarray:
    """The numbers that ``folded`` was given, as unsigned 64-bit ones."""
    width, n = raw[0], int.from_bytes(raw[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[5:], width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def folded_rising(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as the gaps between them, which are small where they rise; a fall wraps around."""
    return folded(np.diff(numbers, prepend=numbers.dtype.type(0)))


def unfolded_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unfolded(raw), dtype=np.uint64)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted rows cut into tables of whole groups, of about ``rows`` rows or one group."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            last = key(held[-1], held[-1].num_rows - 1)
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            other = np.flatnonzero((values != np.array(last)).any(axis=1))
            cut = int(other[0]) if len(other) else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [batch.slice(cut)], batch.num_rows - cut
            continue
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
