"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

Sequences are numbered.  A keyed Feistel network with cycle-walking permutes the numbers, so
the place of a sequence in the training order takes a few integer operations, and no shuffle
list is kept.  Sequences are dealt to shards by ranges of that place and written as 16-bit
tokens at a fixed stride: slot s is at byte (s - first slot of its shard) * stride * 2, so a
run can resume anywhere and read on sequentially.
"""

from __future__ import annotations

import base64
import re
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256
#: Most shards that one task writes.
SHARDS_PER_TASK = 32
#: Pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Encoder:
    """Byte-level BPE of a whole text to little-endian 16-bit tokens."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        out = array("H", self.bpe.encode_ordinary(text))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(vocabulary)


def permuted(index: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..size-1: a balanced Feistel network, walked until it lands inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), np.asarray(index, np.uint64).copy()

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(rounds):
            f = (b + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        todo = np.arange(len(out))
        while len(todo):  # the domain is less than four times as large, so few rounds are needed
            out[todo] = once(out[todo])
            todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, str, int, pa.RecordBatch, int]]:
    """Rows with whether they start a run: rows of one file, one behind the other."""
    at = (None, None)
    for batch in batches:
        files, rows = batch.column("file").to_pylist(), batch.column("place").to_pylist()
        for i, here in enumerate(zip(files, rows)):
            yield here != at, *here, batch, i
            at = (here[0], here[1] + 1)


def qualified(spark, path: str) -> str:
    """``path`` with its scheme, so that executors write where Spark reads a path without one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _fs(uri: str):
    """File system and folder of a qualified path; Hadoop writes local ones with a single slash."""
    return pyarrow.fs.FileSystem.from_uri("file://" + uri[5:] if re.match("file:/(?!/)", uri) else uri)


def write_training_order(
    path: str, out: str, spark, id_col: str = "doc_id", text: str = "text", *, key: int = 20240229, stride: int = 512,
    shard_bytes: int = 16 << 20, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Write the documents of a Parquet table as shards ``out/shard-<number>.bin``; index of all sequences.

    Each document is tokenised, ended with END and cut to sequences of ``stride`` tokens, the
    last filled up with END.  A null or empty text is one sequence of ENDs, repeated rows are written each, and an
    empty table has no shards and an empty index.  Other columns are not read.  The index has
    ``slot, shard, place, id, seq, n_tokens`` (END of the document included); ``place`` counts
    from 0 in each shard, ``slot`` in the whole order.

    Byte-level tokens are never more than bytes, so a document reserves the numbers that
    its bytes could need.  That takes no tokenising, and the permutation runs over all
    reserved numbers; those in use, in the order of their images, have the slots.  Every
    shard covers an equal range of images and so holds about as many sequences as any
    other, ``shard_bytes`` at most.

    Both passes read the same splits; if they should not, the second one stops, as its
    stretches of rows are looked up by file and row.  That table has a name for each file and two
    numbers for each split, and is all that is broadcast: some ten megabytes for 100 TB in files of a
    gigabyte.  Shards are written under another name and moved, and
    always have the same bytes, so a task that runs again does no harm.
    """
    out = qualified(spark, out)
    # The columns of both passes are read alike, so that the same rows make a stretch.
    docs = spark.read.parquet(path).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    )
    reserve = F.ceil((F.octet_length("text") + 1) / stride).cast("long")

    def count(batches):
        runs = []
        for new, file, place, batch, i in _runs(batches):
            if new:
                runs.append([file, place, 0])
            runs[-1][2] += batch.column("n")[i].as_py()
        columns = zip(*runs) if runs else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["file", "place", "n"])

    stretches = docs.select("file", "place", reserve.alias("n")).mapInArrow(count, "file STRING, place LONG, n LONG")
    total, begins = 0, {}
    for r in materialize(stretches, "stretches").groupBy("file").agg(
            F.array_sort(F.collect_list(F.struct("place", "n"))).alias("parts")).orderBy("file").toLocalIterator():
        places, sizes = (np.array([p[c] for p in r["parts"]], np.int64) for c in ("place", "n"))
        begins[r["file"]] = places, total + np.cumsum(sizes) - sizes
        total += int(sizes.sum())
    begins = spark.sparkContext.broadcast(begins)
    per_shard = max(1, shard_bytes // (2 * stride))
    shards = max(1, -(-total // per_shard))
    # A task writes several shards, one behind the other, but never so many that cores stay idle.
    per_task = max(1, min(SHARDS_PER_TASK, shards // (2 * spark.sparkContext.defaultParallelism)))
    end = np.array([END], "<u2").tobytes()

    def sequences(batches):
        encode, number, held = encoder(vocabulary), None, []

        def flush():
            n, ids, seqs, sizes, blobs = zip(*held)
            image = permuted(np.array(n), total, key)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(image), pa.array((image // per_shard).astype(np.int32)), pa.array(ids, pa.int64()),
                 pa.array(seqs, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())],
                ["image", "shard", "id", "seq", "n_tokens", "tokens"],
            )

        for new, file, place, batch, i in _runs(batches):
            if new:
                places, starts = begins.value[file]
                known = int(np.searchsorted(places, place))
                if known == len(places) or places[known] != place:
                    raise RuntimeError(f"{file} was split otherwise before")
                number = int(starts[known])
            value = batch.column("text")[i].as_py()
            t = encode(value) + end
            for seq, a in enumerate(range(0, len(t), 2 * stride)):
                part = t[a:a + 2 * stride]
                held.append((number + seq, batch.column("id")[i].as_py(), seq, len(part) // 2, part))
            number += -(-(len(value.encode()) + 1) // stride)
            if len(held) >= 2000:
                yield flush()
        if held:
            yield flush()

    def write(batches):
        fs, folder = _fs(out)
        fs.create_dir(folder)
        shard, stream, name, place = None, None, None, 0

        def close():
            if stream:
                stream.close()
                fs.move(name, f"{folder}/shard-{shard:08d}.bin")

        for batch in batches:
            places = []
            for s, part in zip(batch.column("shard").to_pylist(), batch.column("tokens")):
                if s != shard:
                    close()
                    shard, name, place = s, f"{folder}/.writing-{uuid.uuid4().hex}", 0
                    stream = fs.open_output_stream(name)
                raw = part.as_py()
                stream.write(raw + end * (stride - len(raw) // 2))
                places.append(place)
                place += 1
            rest = batch.select(["shard", "id", "seq", "n_tokens"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(places, pa.int64())], [*rest.schema.names, "place"])
        close()

    rows = docs.mapInArrow(sequences, "image LONG, shard INT, id LONG, seq INT, n_tokens INT, tokens BINARY")
    dealt = F.floor(F.col("shard") / per_task).cast("int")
    ranged = rows.repartitionById(-(-shards // per_task), dealt).sortWithinPartitions("image")
    index = materialize(ranged.mapInArrow(write, "shard INT, id LONG, seq INT, n_tokens INT, place LONG"), "token-index")
    starts = first_slots(index.groupBy("shard").agg(F.count(F.lit(1)).alias("n")))
    return index.join(starts, "shard").select((F.col("first_slot") + F.col("place")).alias("slot"), "shard", "place", "id", "seq", "n_tokens")


def first_slots(sizes: DataFrame) -> DataFrame:
    """``shard``, ``first_slot`` from ``shard``, ``n``; the window sees one row per shard."""
    along = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first_slot"))


def read_training_order(spark, out: str, stride: int = 512, first_slot: int = 0) -> DataFrame:
    """``slot``, ``tokens`` (binary, fixed stride) of all sequences from ``first_slot`` on.

    Where shards begin follows from the lengths of the files, which are listed first; shards
    before ``first_slot`` are not read.
    """
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(out)
    number = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("int")
    listed = shards.select(number.alias("shard"), F.floor(F.col("length") / (2 * stride)).alias("n"))
    # One pair of numbers for each shard, which is megabytes of tokens.
    starts = {r["shard"]: r["first_slot"] for r in first_slots(listed).collect()}
    first_shard = max((s for s, at in starts.items() if at <= first_slot), default=0)
    starts = spark.sparkContext.broadcast(starts)

    def cut(batches):
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("content")):
                raw, step = raw.as_buffer(), 2 * stride
                n = raw.size // step
                slots = starts.value[shard] + np.arange(n)
                parts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(step), n, [None, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(slots), parts], ["slot", "tokens"]).filter(pa.array(slots >= first_slot))

    return shards.where(number >= first_shard).select(number.alias("shard"), "content").mapInArrow(cut, "slot LONG, tokens BINARY")


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
