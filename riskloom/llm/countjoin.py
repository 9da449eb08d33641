"""Jaccard join of word n-gram sets, through R-trees of count vectors.

The n-grams of a set are hashed into groups, and the numbers in each group make the set a point.
What two sets share is at most the sum, over the groups, of the lesser of both numbers; of a box of
points it is at most that with the upper corner.  R-trees packed over such points leave out
whole boxes, then points, that cannot reach the overlap that the similarity asks for.

Trees are local to tiles.  Two sets that link share one of the rarest n-grams of each (of a set of n,
the n - ceil(0.9 n) + 1 rarest hold one), so there is a tile for each n-gram that several sets have
among their rarest, cut where sizes leave a gap that no link spans; tiles of the same sets are one.
Within tiles only a spanning forest of the surviving pairs is put out.
Its components hold every link; each component's sets meet once, in a tree of their own, and
the pairs that survive there are verified on the n-grams themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, packed, short_batches, unpacked, whole_groups
from .components import connected_components
from .simhash import shingle_hashes

#: Buckets that n-grams are counted in to tell rare ones from frequent ones: a broadcast of half a megabyte.
FREQUENCY_BITS = 16
#: Bits of the filter that texts are chosen by before they are shuffled: a broadcast of eight megabytes.
CHOICE_BITS = 26
#: Groups of a count vector, a power of two that grows with the set.
LEAST_GROUPS, MOST_GROUPS, PER_GROUP = 32, 1024, 16
LEAF = 64


def ngram_set(text: str | None, words: int) -> np.ndarray:
    """Distinct n-grams of a whole text as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, words))


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Numbers of n-grams in each group; halving the groups adds neighbours up."""
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and groups * PER_GROUP < len(grams):
        groups *= 2
    shift = np.uint64(64 - (groups.bit_length() - 1))
    return np.bincount((grams >> shift).astype(np.int64), minlength=groups).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(1)


def least_partner(n, percent: int):
    """Fewest n-grams of a set that can link with one of ``n``, and fewest that they must share."""
    return -(-percent * n // 100)


class CountTree:
    """Packed R-tree of points of one resolution: boxes of ``LEAF`` points, boxes of boxes, and so on."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        # Slabs by size, and within a slab along the coordinate that differs most.
        by_size = np.argsort(sizes, kind="stable")
        widest = counts[:, int(np.argmax(counts.var(axis=0)))] if len(counts) else np.zeros(0, np.int32)
        slab = np.empty(len(sizes), np.int64)
        slab[by_size] = np.arange(len(sizes)) // (LEAF * 8)
        self.order = np.lexsort((widest, slab))
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            upper, least, most = self.levels[-1]
            at = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def near(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Points whose bounds leave a link with the given point possible."""
        p, at = self.percent, np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = (x[at] for x in self.levels[depth])
            partner = np.maximum(least, least_partner(size, p))
            fits = (partner <= most) & (p * partner <= 100 * size)
            at, upper, partner = at[fits], upper[fits], partner[fits]
            at = at[(100 + p) * np.minimum(upper, counts).sum(1) >= p * (size + partner)]
            if not depth:
                return self.order[at]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.levels[depth - 1][1])]


class Forest:
    """Trees for each resolution; a tree of g groups has the points of g and, folded, of 2 g groups.

    Sets that can link differ little in size, so their resolutions are equal or neighbours.
    """

    def __init__(self, counts: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.counts, self.sizes = counts, sizes
        self.groups = np.array([len(c) for c in counts])
        self.trees = {}
        for g in np.unique(self.groups).tolist():
            at = np.flatnonzero((self.groups == g) | (self.groups == 2 * g))
            self.trees[g] = at, CountTree(np.stack([folded(counts[i], g) for i in at.tolist()]), sizes[at], percent)

    def near(self, i: int) -> np.ndarray:
        """All points that may link with point ``i``, itself included."""
        g, out = int(self.groups[i]), []
        at, tree = self.trees[g]
        out.append(at[tree.near(self.counts[i], int(self.sizes[i]))])
        if g // 2 in self.trees:
            at, tree = self.trees[g // 2]
            found = at[tree.near(folded(self.counts[i], g // 2), int(self.sizes[i]))]
            out.append(found[self.groups[found] == g // 2])
        return np.concatenate(out)


class Roots:
    """Union-find; ``join`` tells whether it connected something new."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _meeting(percent: int):
    """Of rows sorted by n-gram and size, those next to one of a size that can link: ``gram, chain, place, row``.

    A chain is a stretch of rows in which each may link with the next by size; its number is its first row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, with its chain, its place in it, and whether the row before that may link with it
        for batch in batches:
            gram, n, row = (batch.column(c).to_numpy() for c in ("gram", "n", "row"))
            if not len(row):
                continue
            if last:
                gram, n, row = (np.concatenate([[x], y]) for x, y in zip(last, (gram, n, row)))
            follows = np.concatenate([[False], (gram[1:] == gram[:-1]) & (100 * n[:-1] >= percent * n[1:])])
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(row))))
            chain, place = row[first], np.arange(len(row)) - first
            if last:  # what belongs to the chain of the row before
                mine = first == 0
                chain[mine], place[mine] = last[3], place[mine] + last[4]
                follows[0] = last[5]
            meets = follows[:-1] | follows[1:]
            out = [pa.array(x[:-1][meets]) for x in (gram, chain, place.astype(np.int64), row)]
            last = tuple(int(x[-1]) for x in (gram, n, row, chain, place)) + (bool(follows[-1]),)
            yield pa.RecordBatch.from_arrays(out, ["gram", "chain", "place", "row"])
        if last and last[5]:
            yield pa.RecordBatch.from_arrays([pa.array([last[k]], pa.int64()) for k in (0, 3, 4, 2)], ["gram", "chain", "place", "row"])

    return run


def _small_tile_pairs(tile: np.ndarray, counts: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of places within tiles of one leaf or less whose bounds leave a link possible; many tiles at a time."""
    groups = np.array([len(c) for c in counts])
    found = []
    for g in np.unique(groups).tolist():
        at = np.flatnonzero((groups == g) | (groups == 2 * g))
        points = np.stack([folded(counts[i], g) for i in at.tolist()])
        own, t, n = groups[at], tile[at], sizes[at]
        for apart in range(1, LEAF):
            i = np.flatnonzero(t[apart:] == t[:-apart])
            if not len(i):
                break
            j = i + apart
            few, many = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fits = (100 * few >= percent * many) & ((own[i] == g) | (own[j] == g))
            i, j, both = i[fits], j[fits], (few + many)[fits]
            step = (1 << 21) // g
            for a in range(0, len(i), step):
                x, y = i[a:a + step], j[a:a + step]
                shared = np.minimum(points[x], points[y]).sum(1)
                ok = (100 + percent) * shared >= percent * both[a:a + step]
                found.append(np.stack([at[x[ok]], at[y[ok]]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _tiles(percent: int):
    """A spanning forest of the pairs that survive in each tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gram", "chain", "block"], 10_000):
            gram, chain, block, row, sizes = (table.column(c).to_numpy() for c in ("gram", "chain", "block", "row", "n"))
            counts = [unpacked(raw.as_py()).astype(np.int32) for raw in table.column("counts")]
            sizes = sizes.astype(np.int64)
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (chain[1:] != chain[:-1]) | (block[1:] != block[:-1])])
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(row))
            tile = np.cumsum(new) - 1
            small = (ends - begins <= LEAF)[tile]
            at = np.flatnonzero(small)
            nodes, of = np.unique(row, return_inverse=True)
            roots, out = Roots(len(nodes)), []
            if len(at):
                pairs = at[_small_tile_pairs(tile[at], [counts[i] for i in at.tolist()], sizes[at], percent)]
                # The same two sets meet in a tile for each rare n-gram that they share.
                pairs = np.unique(np.sort(of[pairs], axis=1), axis=0) if len(pairs) else pairs
                out += [(a, b) for a, b in pairs.tolist() if roots.join(a, b)]
            for a, b in zip(begins[ends - begins > LEAF].tolist(), ends[ends - begins > LEAF].tolist()):
                forest = Forest(counts[a:b], sizes[a:b], percent)
                waiting, left = np.ones(b - a, bool), list(range(b - a))
                # Whoever is reached is not looked for again, so a cluster of copies takes one search to clear.
                while left:
                    todo = [left.pop()]
                    if not waiting[todo[0]]:
                        continue
                    waiting[todo[0]] = False
                    while todo:
                        i = todo.pop()
                        reached = forest.near(i)
                        reached = reached[waiting[reached]]
                        waiting[reached] = False
                        for j in reached.tolist():
                            if roots.join(int(of[a + i]), int(of[a + j])):
                                out.append((int(of[a + i]), int(of[a + j])))
                        todo += reached.tolist()
            ends_ = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[ends_[:, 0]]), pa.array(nodes[ends_[:, 1]])], ["a", "b"])

    return run


def _verified(percent: int, words: int):
    """Links that connect each cluster, and what each set's links weigh; all from the n-grams themselves."""

    def cluster(part: pa.Table):
        row, copies, own = (part.column(c).to_numpy() for c in ("row", "copies", "own"))
        grams = [ngram_set(t.as_py(), words) for t in part.column("text")]
        sizes = np.array([len(g) for g in grams], np.int64)
        forest = Forest([count_vector(g) for g in grams], sizes, percent)
        values, code = np.unique(np.concatenate(grams), return_inverse=True)
        heads = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(values), bool)
        across = part.column("across")[0].as_py()
        weight, roots, links = np.zeros(len(row), np.int64), Roots(len(row)), []
        for i in range(len(row)):
            near = forest.near(i)
            near = np.sort(near[near > i])
            if across:  # pairs within one block are another task's
                near = near[own[near] != own[i]]
            if not len(near):
                continue
            mine = code[heads[i]:heads[i + 1]]
            mark[mine] = True
            if 2 * sizes[near].sum() > heads[-1]:
                shared = np.add.reduceat(mark[code], heads[:-1], dtype=np.int64)[near]
            else:
                spans = np.concatenate([code[heads[j]:heads[j + 1]] for j in near.tolist()])
                shared = np.add.reduceat(mark[spans], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            mark[mine] = False
            near = near[100 * shared >= percent * (sizes[i] + sizes[near] - shared)]
            weight[i] += copies[near].sum()
            weight[near] += copies[i]
            links += [(int(row[i]), int(row[j])) for j in near.tolist() if roots.join(i, j)]
        a = np.array([*[x for x, _ in links], *row.tolist()], np.int64)
        b = np.array([*[y for _, y in links], *row.tolist()], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.append(np.zeros(len(links), np.int64), weight))], ["a", "b", "weight"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["root", "block"], 1):
            root, block = table.column("root").to_numpy(), table.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(root)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    yield cluster(table.slice(a, b - a))

    return run


def _dealt(rows: DataFrame, keys: list[str], parts: Column, own: Column) -> DataFrame:
    """``rows`` with ``own``, ``block`` and ``across``: each goes to all pairs of blocks that its own one is in."""
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(
        (F.least(k, own) * parts + F.greatest(k, own)).alias("block"), (k != own).alias("across")))
    out = rows.withColumn("own", own).select("*", F.inline(pairs))
    return out.repartition(*keys, "block").sortWithinPartitions(*keys, "block")


def gram_frequencies(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many sets have an n-gram of each bucket; counted in each task before anything is shuffled."""

    def run(batches):
        total = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount((ngram_set(value.as_py(), words) & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = short_batches(docs).select(col(text).alias("text")).mapInArrow(run, "bucket INT, n LONG")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _profiles(docs: DataFrame, frequencies, words: int, percent: int) -> DataFrame:
    """``id, h, n, node, counts, rare`` of each document: its set's size, digest, count vector and rarest n-grams."""

    def run(batches):
        often = frequencies.value
        for batch in batches:
            n, node, counts, rare = [], [], [], []
            for value in batch.column("text"):
                grams = ngram_set(value.as_py(), words)
                size = len(grams)
                n.append(size)
                node.append(xxhash.xxh3_128_digest(grams.tobytes()))
                # Below this size only equal sets are similar enough.
                linkable = size * (100 - percent) >= percent
                rarest = np.lexsort((grams, often[(grams & np.uint64(len(often) - 1)).astype(np.int64)]))
                rare.append(grams[rarest[:size - least_partner(size, percent) + 1]].view(np.int64) if linkable else np.zeros(0, np.int64))
                counts.append(packed(count_vector(grams)) if linkable else None)
            ends = lambda parts: pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(counts, pa.binary()),
                 pa.ListArray.from_arrays(ends(rare), pa.array(np.concatenate(rare)))],
                ["id", "h", "n", "node", "counts", "rare"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, h LONG, n LONG, node BINARY, counts BINARY, rare ARRAY<LONG>")


def _row_key() -> list[Column]:
    """Id and text hash in a form that joins, nulls too."""
    return [F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h"]


def _chosen(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text hash a bitmap of the members' ones has: all that are wanted, and few others.

    The bitmap has the same size whatever the corpus.
    """
    spark, pages = docs.sparkSession, 1 << (CHOICE_BITS - 15)
    at = F.shiftrightunsigned("h", 64 - CHOICE_BITS)
    page = members.select((at / 32768).cast("int").alias("page"), (at % 32768).alias("bit"))
    page = page.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bits = np.zeros((pages, 4096), np.uint8)
    for number, raw in zip(page.column("page").to_pylist(), page.column("bits")):
        bits[number] = np.frombuffer(raw.as_buffer(), np.uint8)
    sent = spark.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - CHOICE_BITS)).astype(np.int64)
            yield batch.filter(pa.array((sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, words: int = 3, percent: int = 90, block: int = 2048,
    block_grams: int = 1 << 18, with_class: bool = False,
) -> DataFrame:
    """One row for each document: its id, ``n_shingles``, ``component_id`` and ``n_links``.

    ``with_class`` adds ``class``, a number that the rows of a component share, also where they have no id, null for texts
    without words, and ``h``, a hash of the text.

    Documents link when their sets of distinct word n-grams (A-Z in lower case; of fewer words,
    all of them as one) have a Jaccard similarity of at least ``percent`` hundredths.
    ``component_id`` is the least id that links reach, ``n_links`` the number of other rows that a row links with.
    Texts without words, null or empty, link with nothing.  Repeated rows are rows of their own that link.  Null ids
    take part, but name a component only if all its ids are null.  An empty table gives an empty result.
    Very long texts are worked on one at a time, with eight bytes for each of their n-grams.

    Equal sets are one set with a number of copies.  A tile of more than ``block`` sets, or a
    cluster of more than ``block_grams`` n-grams, is dealt as pairs of blocks, so that none
    is missed and no task holds more than two.  N-grams are told apart by 64-bit hashes, sets by 128 bits.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent goes from 50 to 100")
    spark = docs.sparkSession
    plain = short_batches(docs).select(col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("h"), col(text).alias("text"))
    sent = spark.sparkContext.broadcast(gram_frequencies(docs, text, words))
    profiles = materialize(_profiles(plain, sent, words, percent).withColumn("row", F.monotonically_increasing_id()), "set-profiles")
    sets = profiles.where(F.col("n") > 0).groupBy("node").agg(
        F.min("row").alias("row"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets, "distinct-sets")

    # One row of each set that can link at all, and the tiles of n-grams that several sets have.
    firsts = profiles.where(F.col("counts").isNotNull()).join(sets.select("row"), "row", "left_semi")
    grams = firsts.select("row", "n", F.explode("rare").alias("gram")).repartition("gram").sortWithinPartitions("gram", "n", "row")
    met = materialize(grams.select("gram", "n", "row").mapInArrow(_meeting(percent), "gram LONG, chain LONG, place LONG, row LONG"), "shared-grams")
    tiles = met.groupBy("gram", "chain").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    tiles = tiles.groupBy("m", "x", "y").agg(F.min(F.struct("gram", "chain")).alias("tile")).select("tile.*", "m")
    points = materialize(met.join(tiles, ["gram", "chain"]), "tiles").join(firsts.select("row", "n", "counts"), "row")
    parts = F.ceil(F.col("m") / block).cast("int")
    dealt = _dealt(points, ["gram", "chain"], parts, F.floor(F.col("place") * parts / F.col("m")).cast("int"))
    dealt = dealt.select("gram", "chain", "block", "row", "n", "counts")
    candidates = dealt.mapInArrow(_tiles(percent), "a LONG, b LONG").distinct()
    clusters = connected_components(candidates)

    # Each cluster's sets meet once, with the texts they come from.
    members = clusters.withColumnRenamed("node", "row").join(sets.select("row", "copies"), "row").join(
        profiles.select("row", "id", "h", "n"), "row")
    members = materialize(members, "clusters")
    weights = members.groupBy("root").agg(F.sum("n").alias("grams"))
    parts = F.ceil(F.col("grams") / block_grams).cast("int")
    wanted = members.join(weights, "root").select(*_row_key(), "row", "root", "copies", parts.alias("parts"))
    # Rows of equal ids and texts are one set: any of their texts will do.
    wanted = wanted.join(_chosen(plain, members).select(*_row_key(), "text"), ["none", "id", "h"])
    wanted = materialize(wanted.dropDuplicates(["row"]).drop("none", "id", "h"), "cluster-texts")
    dealt = _dealt(wanted, ["root"], F.col("parts"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    dealt = dealt.select("root", "block", "across", "own", "row", "copies", "text")
    found = materialize(dealt.mapInArrow(_verified(percent, words), "a LONG, b LONG, weight LONG"), "verified-links")

    rooted = connected_components(found.select("a", "b"))
    weight = found.where(F.col("weight") > 0).groupBy(F.col("a").alias("row")).agg(F.sum("weight").alias("weight"))
    named = sets.join(rooted.withColumnRenamed("node", "row"), "row", "left").join(weight, "row", "left")
    named = named.withColumn("root", F.coalesce("root", "row"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select(
        "node", "component", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("root").alias("class"))
    # Many rows of one hot set meet one row: such a join can be split.
    extra = [F.col("class"), F.col("h")] if with_class else []
    return profiles.select("id", "n", "node", "h").join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), *extra,
    )
