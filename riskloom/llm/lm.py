"""Language-model scoring with a log-frequency Bloom filter.

A count is quantised to a level on a logarithmic scale, and an n-gram of level q is put into
the filter q times, as (n-gram, 1) to (n-gram, q).  Probing levels until one is missing gives
the level back.

The filter holds every n-gram of the training texts, so it grows with them.  It is cut into pieces of
bounded size by the n-grams' hash, and each worker gets the pieces and the probes that belong
together: texts are worked on in chunks, and a chunk asks each piece once for each of its
distinct n-grams.  The training counts ride with these requests, so one shuffle brings what a piece is
built from and what is looked up in it.  Answers, a byte or so each, go back to the chunk.  No
word or pair is treated unlike another, at any size.

What is stored or shuffled is compressed before: keys as the gaps between them, tokens as places among the
chunk's words, of which common ones come first.  Chunks are of a million tokens, in about 100 MB of a worker's
memory, as the distinct n-grams of a long stretch are fewer for each of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, folded, folded_rising, short_batches, unfolded, unfolded_rising, whole_groups

#: The token that ends each text and stands before its first word.
END = np.uint64(xxhash.xxh64_intdigest(b"\0end of text"))
CHUNK_TOKENS = 1 << 20
BLOCK_BITS = 1 << 19
WORD_KIND, PAIR_KIND = 1, 3
#: Share of single words in what follows a history.
BACKOFF = 0.02
#: Bytes of a pair's hash that travel with a request; its first three bytes tell the piece.
PAIR_BYTES = 5


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case, and the end.

    Words are told apart by these hashes: among a billion distinct words the odds that
    any two share one are about 1 in 40.
    """
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Ids, held-out marks, tokens and token counts of rows, cut so that a chunk has few tokens but for its last text's."""
    rows, texts, size = [], [], 0

    def chunk():
        ids, held = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("id", "held_out"))
        return ids, held, np.concatenate(texts), np.array([len(x) for x in texts])

    for batch in batches:
        begin = 0
        for i, value in enumerate(batch.column("text")):
            texts.append(tokens(value.as_py()))
            size += len(texts[-1])
            if size >= CHUNK_TOKENS:
                rows.append(batch.slice(begin, i + 1 - begin))
                yield chunk()
                rows, texts, size, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin).select(["id", "held_out"]))
    if rows:
        yield chunk()


def _before(t: np.ndarray, sizes: np.ndarray, first) -> np.ndarray:
    """What stands before each token of its text; ``first`` before the first one."""
    out = np.empty_like(t)
    out[1:] = t[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = first
    return out


def _mixed(key: np.ndarray, kind: int, level=0) -> np.ndarray:
    """64 well-mixed bits of (n-gram, level)."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) * np.uint64(4) + np.uint64(kind) + np.asarray(level, np.uint64) * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """63 well-mixed bits of two word hashes, as a negative long."""
    return (_mixed(before, PAIR_KIND, word) | np.uint64(1 << 63)).view(np.int64)


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(before, PAIR_KIND, word)


def _bits(x: np.ndarray, i: int) -> np.ndarray:
    """The i-th bit of an entry inside its block."""
    return (((x & np.uint64(0xFFFFFFFF)) + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def levels_of(n: np.ndarray, base: float) -> np.ndarray:
    """Level of each count: 0 for none, 1 from one on, and one more each time it grows by ``base``."""
    return np.where(n > 0, 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(base) + 1e-9), 0).astype(np.int64)


def middle(level: np.ndarray, base: float) -> np.ndarray:
    """Count that a level stands for."""
    return np.where(level > 0, base ** (level - 0.5), 0.0)


@dataclass(frozen=True)
class LogFrequencyFilter:
    """A piece: ``bitmap`` is a row of blocks, and an n-gram has all its bits in one of them."""

    bitmap: np.ndarray
    blocks: int
    hashes: int
    highest: int

    @classmethod
    def of(cls, kinds: Iterable[tuple[int, np.ndarray, np.ndarray]], bits_per_entry: int, hashes: int) -> "LogFrequencyFilter":
        """From the keys of each kind and their levels; keys of level 0 are left out."""
        kinds = [(kind, key[level > 0], level[level > 0]) for kind, key, level in kinds]
        entries = sum(int(level.sum()) for *_, level in kinds)
        blocks = max(1, -(-entries * bits_per_entry // BLOCK_BITS))
        bitmap = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        for kind, key, level in kinds:
            block = (_mixed(key, kind) % np.uint64(blocks)).astype(np.int64) * BLOCK_BITS
            for q in range(1, int(level.max(initial=0)) + 1):
                mine = level >= q
                x = _mixed(key[mine], kind, q)
                for i in range(hashes):
                    at = block[mine] + _bits(x, i)
                    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return cls(bitmap, blocks, hashes, max((int(level.max(initial=0)) for *_, level in kinds), default=0))

    def levels(self, key: np.ndarray, kind: int) -> np.ndarray:
        """Level of each n-gram, 0 for those that are not there.

        Never below the true level; above it with the odds of a false positive.
        """
        level, alive = np.zeros(len(key), np.int64), np.arange(len(key))
        block = (_mixed(key, kind) % np.uint64(self.blocks)).astype(np.int64) * BLOCK_BITS
        for q in range(1, self.highest + 1):
            x, start = _mixed(key[alive], kind, q), block[alive]
            hit = np.ones(len(alive), bool)
            for i in range(self.hashes):
                at = start + _bits(x, i)
                hit &= (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            if not len(alive):
                break
            level[alive] = q
        return level


def _common_first(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and each token's place among them.

    Words seen about as often lie together in rising order, the most common first, so most places are small numbers.
    """
    words, at, n = np.unique(t, return_inverse=True, return_counts=True)
    order = np.argsort(-np.floor(np.log2(n)), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return words[order], place[at]


# --- chunks ----------------------------------------------------------------------------------
def _bodies(kind: str):
    """Chunks of texts: ids, held-out marks and lengths of their documents, distinct words, and each token's word."""
    names = ["ids", "held", "sizes", "words", "tokens", "n", "n_train"]

    def run(batches):
        for ids, held, t, sizes in _chunks(batches):
            words, at = _common_first(t)
            one = pa.array([0, len(ids)], pa.int32())
            out = held.to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, held),
                 pa.array([folded(sizes)]), pa.array([folded_rising(words)]), pa.array([folded(at)]),
                 pa.array([len(t)]), pa.array([int(sizes[~out].sum())])], names)

    return run, f"ids ARRAY<{kind}>, held ARRAY<BOOLEAN>, sizes BINARY, words BINARY, tokens BINARY, n LONG, n_train LONG"


@dataclass
class _Chunk:
    """A chunk's tokens as places among its distinct words and pairs, and who asks which piece for what."""

    sizes: np.ndarray
    held: np.ndarray
    words: np.ndarray
    at: np.ndarray
    pair: np.ndarray
    pair_words: tuple[np.ndarray, np.ndarray]
    pair_key: np.ndarray
    word_order: np.ndarray
    word_piece: np.ndarray
    pair_order: np.ndarray
    pair_piece: np.ndarray

    @classmethod
    def of(cls, held: list, sizes: bytes, words: bytes, tokens_: bytes, pieces: int) -> "_Chunk":
        sizes, words, at = unfolded(sizes).astype(np.int64), unfolded_rising(words), unfolded(tokens_).astype(np.int64)
        end = int(np.flatnonzero(words == END)[0])
        code, pair = np.unique(_before(at, sizes, end) * len(words) + at, return_inverse=True)
        pair_words = np.divmod(code, len(words))
        pair_hash = _pair_hash(*(words[x] for x in pair_words))
        piece = lambda h: ((h >> np.uint64(40)).astype(np.int64) * pieces) >> 24
        word_piece, pair_piece = piece(_mixed(words, WORD_KIND)), piece(pair_hash)
        pair_key = pair_hash & np.uint64((1 << 8 * PAIR_BYTES) - 1)
        word_order, pair_order = np.lexsort((words, word_piece)), np.lexsort((pair_key, pair_piece))
        return cls(sizes, np.array(held, bool), words, at, pair, pair_words, pair_key,
                   word_order, word_piece[word_order], pair_order, pair_piece[pair_order])

    def requests(self, chunk: int) -> pa.RecordBatch:
        """One row for each piece: the keys it is asked for, rising, with their counts in the chunk's training texts."""
        train = np.repeat(~self.held, self.sizes)
        word_n = np.bincount(self.at[train], minlength=len(self.words))[self.word_order]
        pair_n = np.bincount(self.pair[train], minlength=len(self.pair_key))[self.pair_order]
        words, pairs = self.words[self.word_order], self.pair_key[self.pair_order]
        pieces = np.unique(np.concatenate([self.word_piece, self.pair_piece]))
        a, b = (np.searchsorted(x, pieces, "left") for x in (self.word_piece, self.pair_piece))
        c, d = (np.searchsorted(x, pieces, "right") for x in (self.word_piece, self.pair_piece))
        spans = list(zip(a.tolist(), c.tolist(), b.tolist(), d.tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(pieces), pa.array(np.full(len(pieces), chunk)), pa.array([folded_rising(words[i:j]) for i, j, _, _ in spans]),
             pa.array([folded(word_n[i:j]) for i, j, _, _ in spans]), pa.array([folded_rising(pairs[i:j]) for _, _, i, j in spans]),
             pa.array([folded(pair_n[i:j]) for _, _, i, j in spans])],
            ["piece", "chunk", "words", "word_n", "pairs", "pair_n"])


def _requests(pieces: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, *body = (batch.column(c)[i].as_py() for c in ("chunk", "held", "sizes", "words", "tokens"))
                yield _Chunk.of(*body, pieces).requests(chunk)

    return run, "piece LONG, chunk LONG, words BINARY, word_n BINARY, pairs BINARY, pair_n BINARY"


def _answers(base: float, bits_per_entry: int, hashes: int):
    """Build each piece from its requests and look every request up in it.

    Words get exact counts beside the level that probing finds; pairs get the level.
    """

    def answer(table: pa.Table) -> pa.RecordBatch:
        def totals(keys: list[np.ndarray], counts: str):
            values, of = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate([unfolded(x.as_py()).astype(np.int64) for x in table.column(counts)])
            return values, of, np.bincount(of, weights=n, minlength=len(values)).astype(np.int64)

        words, pairs = ([unfolded_rising(x.as_py()) for x in table.column(c)] for c in ("words", "pairs"))
        word, word_of, word_n = totals(words, "word_n")
        pair, pair_of, pair_n = totals(pairs, "pair_n")
        piece = LogFrequencyFilter.of(
            [(WORD_KIND, word, levels_of(word_n, base)), (PAIR_KIND, pair, levels_of(pair_n, base))], bits_per_entry, hashes)
        word_level, pair_level = piece.levels(word, WORD_KIND)[word_of], piece.levels(pair, PAIR_KIND)[pair_of]
        exact = word_n[word_of]
        i, j = (np.concatenate([[0], np.cumsum([len(x) for x in part])]).tolist() for part in (words, pairs))
        known = np.zeros(table.num_rows, np.int64)
        known[0] = (word_n > 0).sum()
        return pa.RecordBatch.from_arrays(
            [table.column("piece").combine_chunks(), table.column("chunk").combine_chunks(),
             pa.array([folded(exact[a:b]) for a, b in zip(i, i[1:])]), pa.array([folded(word_level[a:b]) for a, b in zip(i, i[1:])]),
             pa.array([folded(pair_level[a:b]) for a, b in zip(j, j[1:])]), pa.array(known)],
            ["piece", "chunk", "word_n", "word_level", "pair_level", "known"])

    def run(batches):
        for table in whole_groups(batches, ["piece"], 1):
            piece = table.column("piece").to_numpy()
            cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
            for a, b in zip(cuts, cuts[1:]):
                yield answer(table.slice(a, b - a))

    return run, "piece LONG, chunk LONG, word_n BINARY, word_level BINARY, pair_level BINARY, known LONG"


def _scores(pieces: int, total: int, distinct: int, base: float, kind: str):
    """Sums of each document over its tokens, from the answers to its chunk."""
    norm = float(total + distinct + 1)

    def score(ids: pa.Array, held: list, sizes: bytes, words: bytes, tokens_: bytes, answers: list[dict]) -> pa.RecordBatch:
        chunk = _Chunk.of(held, sizes, words, tokens_, pieces)
        answers.sort(key=lambda a: a["piece"])
        joined = lambda c: np.concatenate([unfolded(a[c]).astype(np.int64) for a in answers])
        count, word_level = np.empty((2, len(chunk.words)), np.int64)
        count[chunk.word_order], word_level[chunk.word_order] = joined("word_n"), joined("word_level")
        pair_level = np.empty(len(chunk.pair_key), np.int64)
        pair_level[chunk.pair_order] = joined("pair_level")
        single = (count + 1.0) / norm
        before, word = chunk.pair_words
        past, alone = middle(word_level, base)[before], single[word]
        share = np.minimum(middle(pair_level, base) / np.maximum(past, 1.0), 1.0) * (1.0 - BACKOFF)
        p = np.where(past > 0, share + BACKOFF * alone, alone)
        owner = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        sums = lambda x: pa.array(np.bincount(owner, weights=x, minlength=len(chunk.sizes)))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(chunk.held), pa.array(chunk.sizes),
             sums(count[chunk.at] > 0).cast(pa.int64()), sums(np.log10(single)[chunk.at]), sums(np.log10(p)[chunk.pair])],
            ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body = (batch.column(c)[i].as_py() for c in ("held", "sizes", "words", "tokens", "answers"))
                yield score(batch.column("ids")[i].values, *body)

    return run, f"id {kind}, held_out BOOLEAN, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE"


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", *,
    base: float = 1.25, bits_per_entry: int = 12, hashes: int = 6, piece_tokens: int = 1 << 21,
) -> DataFrame:
    """One row for each document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from all documents that are not held out.  ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over words and the end, with exact counts c.  ``score`` sums
    log10 of p(w | h) = 0.98 * c(hw) / c(h) + 0.02 * (c(w) + 1) / (N + V + 1), and of the last
    part without its factor for a history h that was never seen; c(hw) and c(h) are quantised and come from
    probing the filter.  Quantised counts make the sum over w differ from one by a few percent, but no p exceeds one.

    Null and empty texts have one token, the end.  Repeated rows count and are scored each.
    An empty table, or nothing to learn from, gives N = 0 and uniform scores.  Other columns are not read, so no name
    clashes.  A very long text ends its chunk, in memory that grows with it.  There is a filter piece
    for each ``piece_tokens`` tokens of the corpus; it holds about that many distinct pairs at most, and a hot word is
    asked for once by each chunk.  Chunks and answers are stored, so a lost executor costs the tasks it had.
    """
    plain = docs.select(col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    run, ddl = _bodies(kind)
    bodies = materialize(short_batches(plain).mapInArrow(run, ddl).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    size, total = bodies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    pieces = max(1, -(-size // piece_tokens))

    run, ddl = _requests(pieces)
    asked = bodies.select("chunk", "held", "sizes", "words", "tokens").mapInArrow(run, ddl)
    run, ddl = _answers(base, bits_per_entry, hashes)
    answers = materialize(asked.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, ddl), "answers")
    distinct = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]

    back = answers.groupBy("chunk").agg(F.collect_list(F.struct("piece", "word_n", "word_level", "pair_level")).alias("answers"))
    run, ddl = _scores(pieces, total, distinct, base, kind)
    scored = bodies.join(back, "chunk").select("ids", "held", "sizes", "words", "tokens", "answers").mapInArrow(run, ddl)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score"))
