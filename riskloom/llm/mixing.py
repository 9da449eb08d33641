"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a budget of words and a weight schedule over training time 0..1.  The
integral of the schedule, scaled to the budget, is the source's cumulative demand D(t).  Its
documents, in an order drawn by hash and repeated in passes, lie one behind the other on the
axis of demand; a document that starts at o is trained on at the time t where D(t) = o.  Sorting
all documents by t gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import bucket_count, col, cols, first_words, free_names, n_words, prefix_sums

#: Knots (time, weight) per place in the cycle of weights: heavy sources fade, light ones come late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WEIGHTS = (5.0, 2.0, 1.0)


def demand_inverse(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which ``share`` (0..1) of a piecewise linear schedule's integral is reached."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("knots go from time 0 to 1 with weights of at least 0")
    pieces = [(t0, t1 - t0, w0, w1) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    areas = [d * (w0 + w1) / 2 for _, d, w0, w1 in pieces]
    total = before = sum(areas)
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    out = None
    for (t0, d, w0, w1), area in zip(pieces[::-1], areas[::-1]):
        end, before = before, before - area
        part = share * total - before
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / d) * part, F.lit(0.0)))
        time = F.when(part <= 0, F.lit(t0)).otherwise(F.lit(t0) + F.lit(2.0) * part / (F.lit(w0) + root))
        out = time if out is None else F.when(share * total < end, time).otherwise(out)
    return out


def _targets(sizes: DataFrame, weights: Sequence[float], ratio: float, cap: float) -> DataFrame:
    """``_class``, ``target`` for each source (``_null``, ``_src``, ``_size``): water-filling in closed form.

    The windows see one row per source.
    """
    place = F.row_number().over(Window.orderBy("_null", "_src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_class") + 1)
    rows = sizes.withColumn("_class", F.pmod(place, F.lit(len(weights)))).withColumn("_weight", weight)
    rows = rows.withColumns({"_cap": F.lit(float(cap)) * F.col("_size"), "_all": F.sum("_size").over(Window.partitionBy())})
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "_null", "_src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_weight").over(Window.partitionBy()) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)),
    })
    # Sources with the lowest caps for their weight are full first; the rest share what is left.
    level = (F.lit(float(ratio)) * F.col("_all") - F.col("_caps")) / F.col("_rest")
    full = F.col("_cap") / F.col("_weight") <= level  # the first that is not has the level of all that follow
    level = F.max(F.when(~full, level)).over(Window.partitionBy())
    target = F.least(F.col("_cap"), F.coalesce(F.col("_weight") * level, F.col("_cap")))
    return rows.withColumn("target", target).select("_null", "_src", "_class", "target", F.col("_size").alias("source_size"))


def plan_mix(
    docs: DataFrame, source: str, size: Column, key: Sequence[Column], *, weights: Sequence[float] = WEIGHTS,
    ratio: float = 1.5, cap: float = 2.0, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    store: bool = True,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``uses``.

    ``uses`` has a struct (position, words) for each time that the mix takes a row, in order
    of passes; ``words`` is less than ``size`` only where a source's budget ends inside a
    document.  ``taken`` sums them.  ``key`` columns fix the order within a source: it hangs
    on their md5 alone, so reruns agree; rows of equal keys should be alike.

    Null sources are one source, ordered last; rows of no words are never taken; a source
    without words gets target 0; empty input gives an empty plan.  The result names replace
    columns of the same names.  Documents are numbered in buckets of bounded size, so that
    a source with a third of all rows is spread; only windows over one row per source or
    per bucket see a whole source.  Rows that are equal in all of ``key`` share a bucket, however many they are.
    ``store`` keeps the input as a table in the shared
    folder, for narrow inputs whose sizes are dear.
    """
    docs = docs.drop("source_size", "target", "taken", "uses", *(["size"] if "size" != source else []))
    kept = docs.columns
    hashed = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]).cast("binary"))
    # All columns in one, so that no helper's name can clash with theirs.
    rows = docs.select(
        F.struct(*cols(kept)).alias("_row"), size.cast("long").alias("size"), hashed.alias("_key"), col(source).isNull().alias("_null"),
        F.coalesce(col(source), F.lit("")).alias("_src"))
    rows = materialize(rows, "mix") if store else rows
    buckets = bucket_count(rows.count() if store else docs.count())
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(at * buckets / float(1 << 32)).cast("int"))
    order = [F.col("_key"), F.col("size")]
    placed = prefix_sums(rows, ["_null", "_src"], "_bucket", order, "size", "_from")

    # Targets go to the rows by (source, bucket), the key that rows are already dealt by.
    spans = rows.groupBy("_null", "_src", "_bucket").agg(F.sum("size").alias("_part"))
    targets = _targets(spans.groupBy("_null", "_src").agg(F.sum("_part").alias("_size")), weights, ratio, cap)
    spans = spans.drop("_part").join(targets, ["_null", "_src"])
    placed = placed.join(spans, ["_null", "_src", "_bucket"])

    demand = F.floor(F.col("target") + 0.5)
    uses = []
    for k in range(math.ceil(cap)):
        start = F.col("source_size") * k + F.col("_from")
        words = F.greatest(F.least(demand - start, F.col("size")), F.lit(0)).cast("long")
        share = start / demand
        time = F.lit(None).cast("double")
        for i in range(len(weights)):
            time = F.when(F.col("_class") == i, demand_inverse(share, schedules[i % len(schedules)])).otherwise(time)
        uses.append(F.struct(time.alias("position"), words.alias("words")))
    placed = placed.withColumn("uses", F.filter(F.array(*uses), lambda u: u["words"] > 0))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    return placed.withColumn("taken", taken).select("_row.*", "size", "source_size", "target", "taken", "uses")


def training_order(planned: DataFrame) -> DataFrame:
    """The planned rows once for each use, with its ``words`` and ``position``, range-sorted by ``position``.

    These add up to ``taken``: of a document that its source's budget ends in, only the
    first ``words`` words are used.
    """
    use, words, position = free_names(planned, "_use", "words", "position")
    used = planned.select(*cols(c for c in planned.columns if c != "uses"), F.explode("uses").alias(use))
    used = used.withColumns({words: F.col(f"{use}.words"), position: F.col(f"{use}.position")}).drop(use)
    # Rows of every source are spread over time, and a hash parts rows of one position.
    spread = [F.col(position), F.xxhash64("size", "source_size")]
    return used.repartitionByRange(*spread).sortWithinPartitions(*spread)


def mix_documents(docs: DataFrame, source: str = "source", text: str = "text", key: Sequence[str] = ("doc_id", "text"), **options) -> DataFrame:
    """The mixed corpus in training order: documents, repeated as planned, with the columns of ``docs``.

    A document that its source's budget ends in is cut behind the last word that the plan
    takes of it, so that a source's words add up to its target; its other columns stay.
    Texts are shuffled twice, by bucket of their source and by position, and never stored.
    """
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no name can clash
    name = dict(zip(docs.columns, plain.columns))
    planned = plan_mix(
        plain, name[source], n_words(col(name[text])), cols(name[k] for k in key), store=False, **options
    )
    out = dict(name) | {text: "_cut"}
    cut = F.when(F.col("words") < F.col("size"), first_words(F.col(name[text]), F.col("words"))).otherwise(F.col(name[text]))
    return training_order(planned).withColumn("_cut", cut).select(*[F.col(v).alias(c) for c, v in out.items()])
