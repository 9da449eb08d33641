"""URL filters: cascades of Bloom filters, with DataFrame functions only.

The first level encodes the listed keys; keys of the corpus that pass it by mistake are
encoded in the second level, listed keys that pass that one by mistake in the third, and so
on until nobody passes by mistake.  As the levels are built over every key that the corpus
has, membership of those keys is exact, and it is an expression on the row: no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, UPPER, free_names

#: Bits in one row of Spark's bitmap aggregate.
_CHUNK = 32768


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path; both empty without ``://`` or for null."""
    there = F.instr(url, "://")
    rest = F.when(there > 0, F.substring(url, there + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    bitmap: bytes

    def positions(self, key: Column, number: int) -> list[Column]:
        return _positions(key, number, self.bits, self.hashes)

    def passes(self, key: Column, number: int) -> Column:
        """Whether all the key's bits are set."""
        out = F.lit(True)
        for at in self.positions(key, number):
            byte = F.conv(F.hex(F.substring(F.lit(self.bitmap), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1)
        return out


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    one, two = F.xxhash64(F.lit(f"level {number} a"), key), F.xxhash64(F.lit(f"level {number} b"), key)
    # Double hashing in 31-bit halves, so that sums stay far from overflow.
    a, b = (F.shiftrightunsigned(h, 33) for h in (one, two))
    return [F.pmod(a + b * i, F.lit(bits).cast("long")) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that it was built over; null is not contained."""
        # The first level that a key does not pass decides; one that passes all was encoded in the last.
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            out = F.when(self.levels[number - 1].passes(key, number), out).otherwise(number % 2 == 0)
        return F.coalesce(out & key.isNotNull(), F.lit(False))

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bitmap) for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = 64 << 20, max_levels: int = 64) -> Cascade:
    """A cascade for one-column tables of ``listed`` keys and all keys of the corpus.

    Repeated and null keys do no harm; listed keys outside the universe are encoded too.
    The bitmaps take about 1.44 log2(universe / listed) + 4 bits for each listed key and
    are the only thing that reaches the driver and, in the plan, the workers; a list whose
    first level would take over ``max_bytes`` is refused: cut it by a hash of the key and
    use one cascade for each part.  No listed key gives a cascade that contains nothing.
    """
    name = lambda df: df.select(F.col(f"`{df.columns[0]}`").alias("key")).where("key is not null").distinct()
    inside = materialize(name(listed), "listed-keys")
    outside = materialize(name(universe).join(inside, "key", "left_anti"), "other-keys")
    levels, include, against = [], inside, outside
    while (n := include.count()) and len(levels) < max_levels:
        number = len(levels) + 1
        rate = 0.5
        if number == 1:
            rate = min(0.5, max(n / math.sqrt(2) / max(1, against.count()), 2.0**-30))
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, 8 * math.ceil(n * hashes / math.log(2) / 8))
        if bits > 8 * max_bytes:
            raise ValueError(f"{n} keys need {bits // 8} bytes; the bound is {max_bytes}")
        at = include.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
        chunks = at.groupBy(F.floor(F.col("at") / _CHUNK).alias("chunk")).agg(
            F.bitmap_construct_agg(F.col("at") % _CHUNK).alias("bitmap")
        ).collect()  # at most bits / 32768 rows
        whole = bytearray(-(-bits // _CHUNK) * _CHUNK // 8)
        for row in chunks:
            whole[row["chunk"] * _CHUNK // 8:(row["chunk"] + 1) * _CHUNK // 8] = row["bitmap"]
        level = Level(bits, hashes, bytes(whole[:bits // 8]))
        levels.append(level)
        wrong = materialize(against.where(level.passes(F.col("key"), number)), "passed-by-mistake")
        include, against = wrong, include
    if n:
        raise RuntimeError(f"still {n} keys pass by mistake after {max_levels} levels")
    return Cascade(tuple(levels))


@dataclass(frozen=True)
class UrlRule:
    """``action`` (allow or block) for a host with its subdomains and paths that start with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host.lower() + self.path


def rule_candidates(host: Column, path: Column, rules: Sequence[UrlRule]) -> list[Column]:
    """Every key that a rule for this URL could have, by the shapes (labels, path length) that rules have; null if too short."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    return [
        F.when(F.length(path) >= length, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))
        for labels, length in shapes
    ]


def judge_urls(pages: DataFrame, url: str, rules: Sequence[UrlRule], blocked_hosts: DataFrame) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (these names replace equal ones).

    Rules and blocked hosts are both looked up in cascades.  The longest rule that fits
    wins, of equal ones that of the longer host, of one key's rules the first.  Without a
    rule, hosts of the one-column table ``blocked_hosts`` are blocked and others allowed.
    Null, empty and odd URLs have an empty host, which no rule fits.
    """
    spark = pages.sparkSession
    first = {r.key: r for r in reversed(rules)}
    judged = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    h_, p_, r_ = free_names(pages, "_host", "_path", "_rule")
    host, path = host_and_path(F.col(f"`{url}`"))
    keys = pages.select(host.alias("host"), path.alias("path")).distinct()
    out_rule, blocks = F.lit(None).cast("string"), F.lit(False)
    if first:
        candidates = keys.select(F.explode(F.array_compact(F.array(*rule_candidates(F.col("host"), F.col("path"), rules)))).alias("key"))
        of = lambda action: [(k,) for k, r in first.items() if action in (r.action, None)]
        known = build_cascade(spark.createDataFrame(of(None), "key STRING"), candidates)
        blocking = build_cascade(spark.createDataFrame(of("block"), "key STRING"), spark.createDataFrame(of(None), "key STRING"))
        fits = [
            F.when(known.contains(c), F.struct(F.length(c).alias("n"), F.instr(c, "/").alias("host_n"), c.alias("key")))
            for c in rule_candidates(F.col(h_), F.col(p_), rules)
        ]
        out_rule = F.array_max(F.array(*fits))["key"]
        blocks = blocking.contains(F.col(r_))
    listed = build_cascade(blocked_hosts, keys.select("host"))
    judged = judged.withColumns({h_: host, p_: path}).withColumn(r_, out_rule)
    verdict = F.when(F.col(r_).isNotNull(), blocks).otherwise(listed.contains(F.col(h_)))
    return judged.withColumns({
        "host": F.col(h_), "path": F.col(p_), "rule": F.col(r_), "verdict": F.when(verdict, "block").otherwise("allow"),
    }).drop(h_, p_, r_)
