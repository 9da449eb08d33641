"""K-means on the two decision signals, as optional context to the segments.

All restarts of all cluster counts move together: one aggregation a step serves every setting.
Silhouettes are in plain Euclidean distance, from sums of distances to summarised cells: a
point's mean distance to the members of a cell lies between its distance r to their mean and
sqrt(r^2 + s^2), s^2 their variance, which gives an estimate and a bound of its error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N
from ..session import materialize
from .ordering import exact_quantiles

CLUSTER = "ao3_kmeans_cluster"
# FIXED VALUES: adoption rules.
MIN_SHARE, DUPLICATE_SHARE, UNCLEAR_SHARE, MIN_SILHOUETTE, MEANINGFUL_SHARE = 0.01, 0.90, 0.60, 0.25, 0.10
CLUSTER_COUNTS = (3, 4, 5)


def signal_vectors(df: DataFrame, signals: Sequence[str] = (N.RISK, N.MARGIN)) -> DataFrame:
    """Imputed and standardized decision signals, stored once for all fits."""
    raw = [f"_r{i}" for i in range(len(signals))]
    filled = [f"_f{i}" for i in range(len(signals))]
    # Three fits and the result read the rows, so they are joined and scored once.
    rows = materialize(df.withColumns({r: F.col(s).cast("double") for r, s in zip(raw, signals)}), "unscaled")
    pipeline = Pipeline(stages=[
        Imputer(strategy="median", relativeError=1e-4, inputCols=raw, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_signals"),
        StandardScaler(withMean=True, withStd=True, inputCol="_signals", outputCol="signals"),
    ])
    return materialize(pipeline.fit(rows).transform(rows).select(*df.columns, "signals"), "signals")


#: Cells along each of the first two signals, cut at their quantiles: the summary has at most the square of it for each cluster.
CELLS = 128
#: A cell counts as one when the width of its bounds is at most this share of the distance.
NARROW = 0.01
#: Halvings of the cells that points are worked on together in.
TOGETHER = 2
MOST_STEPS = 300
#: Movement of centres, as a share of the mean variance, at which a restart ends.
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Clustering:
    """Centres in the order of their coordinates, so that cluster numbers do not hang on the start."""

    centers: np.ndarray
    cost: float
    sizes: np.ndarray

    @property
    def k(self) -> int:
        return len(self.centers)

    def transform(self, df: DataFrame, vectors: str = "signals") -> DataFrame:
        """``df`` with the number of each row's nearest centre; the lower one of equally near ones."""
        return self._assigned(df.withColumn("_x", vector_to_array(F.col(vectors)))).drop("_x")

    def _assigned(self, df: DataFrame, x: str = "_x") -> DataFrame:
        far = [sum(((F.get(x, F.lit(d)) - float(v)) ** 2 for d, v in enumerate(c)), F.lit(0.0)) for c in self.centers]
        best = F.array_min(F.array(*[F.struct(f.alias("far"), F.lit(i).alias("i")) for i, f in enumerate(far)]))["i"]
        return df.withColumn(CLUSTER, best)


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _covariance(second: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """From second moments; nothing where only rounding is left of it, as where all points are one."""
    out = second - mean[:, :, None] * mean[:, None, :]
    out[np.trace(out, axis1=1, axis2=2) < 1e-12 * (1 + (mean**2).sum(1))] = 0.0
    return out


@dataclass(frozen=True)
class Summary:
    """Number, mean, covariance and box of the points of each cell and cluster; cells lie between quantile edges."""

    edges: list[np.ndarray]
    cell: np.ndarray
    cluster: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, points: DataFrame, edges: list[np.ndarray]) -> "Summary":
        """From ``x`` (an array of doubles), ``cluster`` and ``n``, how many points a row stands for."""

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _points(batch)
                key = cls._place(edges, x) * 65536 + batch.column("cluster").to_numpy(zero_copy_only=False)
                keys, of = np.unique(key, return_inverse=True)
                pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                order = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[order], np.arange(len(keys)))
                parts = [np.bincount(of, weights=n * v, minlength=len(keys)) for v in (np.ones(len(x)), *x.T, *pairs.T)]
                values = np.hstack([np.stack(parts, 1), np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)])
                ends = pa.array(np.arange(len(keys) + 1) * values.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], ["key", "v"])

        width = len(points.select("x").first()[0])
        partial = points.select("x", F.col("cluster").cast("long").alias("cluster"), "n").mapInArrow(sums, "key LONG, v ARRAY<DOUBLE>")
        m = 1 + width + width * width
        how = [F.sum] * m + [F.min] * width + [F.max] * width
        total = partial.groupBy("key").agg(*[f(F.get("v", F.lit(i))).alias(f"v{i}") for i, f in enumerate(how)]).orderBy("key").toArrow()
        key = total.column("key").to_numpy()
        v = np.stack([total.column(f"v{i}").to_numpy() for i in range(len(how))], 1)
        mean = v[:, 1:1 + width] / v[:, :1]
        return cls(edges, key // 65536, key % 65536, v[:, 0], mean, _covariance((v[:, 1 + width:m] / v[:, :1]).reshape(-1, width, width), mean),
                   v[:, m:m + width], v[:, m + width:])

    @staticmethod
    def edges_of(points: DataFrame, cells: int = CELLS) -> list[np.ndarray]:
        """Quantiles of the first two signals of ``x``, over all points."""
        probs = [i / cells for i in range(1, cells)]
        cut = points.agg(*[F.percentile_approx(F.get("x", F.lit(d)), probs, 10_000).alias(f"e{d}") for d in range(2)]).first()
        return [np.unique(np.array(cut[f"e{d}"] or [0.0], float)) for d in range(2)]

    @staticmethod
    def _place(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        a, b = (np.searchsorted(e, x[:, d], "left") for d, e in enumerate(edges))
        return a * 65536 + b

    def levels(self) -> list["Summary"]:
        """Ever coarser summaries, down to one cell for each cluster; each merges two by two cells of the one before."""
        out = [self]
        while len(np.unique(out[-1].cell)) > 1:
            s = out[-1]
            parent = (s.cell // 65536 // 2) * 65536 + s.cell % 65536 // 2
            keys, of = np.unique(parent * 65536 + s.cluster, return_inverse=True)
            n = np.bincount(of, weights=s.n)
            add = lambda v: np.stack([np.bincount(of, weights=s.n * c) for c in v.reshape(len(v), -1).T], 1) / n[:, None]
            mean = add(s.mean)
            width = mean.shape[1]
            second = add(s.spread + s.mean[:, :, None] * s.mean[:, None, :]).reshape(-1, width, width)
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(len(keys)))
            out.append(Summary(s.edges, keys // 65536, keys % 65536, n, mean, _covariance(second, mean),
                               np.minimum.reduceat(s.low[order], starts), np.maximum.reduceat(s.high[order], starts)))
        return out


def equal_points(points: DataFrame) -> DataFrame:
    """Each distinct row of ``x`` and what stands beside it, with the number ``n`` of rows like it; stored, as it is read often."""
    return materialize(points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("n")), "points")


class _Distances:
    """Mean distances to clusters, through the levels of a summary."""

    def __init__(self, summary: Summary):
        self.levels = summary.levels()[::-1]
        self.clusters = np.unique(summary.cluster)
        self.sizes = np.array([summary.n[summary.cluster == c].sum() for c in self.clusters])
        # Rows of the next level that belong to each row of a level.
        self.children = []
        for coarse, fine in zip(self.levels, self.levels[1:]):
            parent = ((fine.cell // 65536 // 2) * 65536 + fine.cell % 65536 // 2) * 65536 + fine.cluster
            of = np.searchsorted(coarse.cell * 65536 + coarse.cluster, parent)
            order = np.argsort(of, kind="stable")
            self.children.append((order, np.searchsorted(of[order], np.arange(len(coarse.cell) + 1))))
        self.variance = [np.trace(s.spread, axis1=1, axis2=2) for s in self.levels]
        # Points of a cell of this level look at the same cells, whatever batch they come in.
        self.together = min(TOGETHER, len(self.levels) - 1)
        level = self.levels[-1 - self.together]
        self.boxes, of = np.unique(level.cell, return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(self.boxes)))
        self.low, self.high = np.minimum.reduceat(level.low[order], starts), np.maximum.reduceat(level.high[order], starts)

    def box_of(self, x: np.ndarray) -> np.ndarray:
        cell = Summary._place(self.levels[-1].edges, x)
        return np.searchsorted(self.boxes, (cell // 65536 >> self.together) * 65536 + (cell % 65536 >> self.together))

    def sums(self, x: np.ndarray, box: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of distances from points of one box to the members of each cluster, and the widths of their bounds."""
        total, width = (np.zeros((len(x), len(self.clusters))) for _ in range(2))
        low, high = self.low[box], self.high[box]
        rows = np.arange(len(self.levels[0].cell))
        for depth, level in enumerate(self.levels):
            mean, var = level.mean[rows], self.variance[depth][rows]
            near = (np.maximum(np.maximum(low - mean, mean - high), 0.0) ** 2).sum(1)  # squared distance to the box of the points
            done = (var <= 2 * NARROW * near) | (depth == len(self.levels) - 1)
            at = rows[done]
            apart = [x[:, d, None] - level.mean[at, d] for d in range(x.shape[1])]
            square = sum(a * a for a in apart)
            r = np.sqrt(square)
            safe = np.maximum(r, 1e-150)
            v = self.variance[depth][at]
            along = sum(a * sum(b * level.spread[at, i, j] for j, b in enumerate(apart)) for i, a in enumerate(apart)) / safe**2
            most = np.sqrt(square + v)
            # Across the line of sight the spread adds to the distance; never beyond the bounds.
            guess = np.clip(r + np.maximum(v - along, 0.0) / (2 * np.maximum(safe, np.sqrt(v))), r, most)
            guess = np.where(square > v, guess, (r + most) / 2)
            members = (level.cluster[at][:, None] == self.clusters) * level.n[at][:, None]
            total += guess @ members
            width += (most - r) @ members
            if depth < len(self.levels) - 1:
                order, starts = self.children[depth]
                rows = np.concatenate([order[starts[i]:starts[i + 1]] for i in rows[~done].tolist()] or [np.zeros(0, np.int64)])
        return total, width


def silhouette(
    df: DataFrame, vectors: str = "signals", cluster: str = CLUSTER, cells: int = CELLS, edges: list[np.ndarray] | None = None
) -> tuple[float, float]:
    """Mean Euclidean silhouette of an assignment and a bound of its error.

    Distances are summed over cells of at most ``cells`` squared places for each cluster, a
    broadcast of bounded size; a cell is opened while its bounds are wide for its distance.
    Cells of one distinct point are exact, and so is the result when all are.  A cluster of
    one point has silhouette 0, as has an assignment to a single cluster.  Equal points of a cluster are worked out once.
    """
    rows = df.select(vector_to_array(F.col(vectors)).alias("x"), F.col(cluster).cast("long").alias("cluster"))
    if edges is None:
        rows = materialize(rows, "clustered")  # read for the edges and for the points
        edges = Summary.edges_of(rows, cells)
    return _silhouette(equal_points(rows), edges)


def _silhouette(points: DataFrame, edges: list[np.ndarray]) -> tuple[float, float]:
    """Of distinct points ``x`` of a ``cluster`` with their number ``n``."""
    distances = _Distances(Summary.of(points, edges))
    if len(distances.clusters) < 2:
        return 0.0, 0.0
    sent = points.sparkSession.sparkContext.broadcast(distances)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _points(batch), np.searchsorted(d.clusters, batch.column("cluster").to_numpy(zero_copy_only=False))
            box = d.box_of(x)
            order = np.argsort(box, kind="stable")
            total, width = (np.zeros((len(x), len(d.clusters))) for _ in range(2))
            for at in np.split(order, np.flatnonzero(np.diff(box[order])) + 1):
                for a in range(0, len(at), 256):
                    total[at[a:a + 256]], width[at[a:a + 256]] = d.sums(x[at[a:a + 256]], int(box[at[0]]))
            rows = np.arange(len(x))
            others = np.maximum(d.sizes[own] - 1, 1)
            inside, wide_in = total[rows, own] / others, width[rows, own] / others
            mean, wide = total / d.sizes, width / d.sizes
            mean[rows, own] = np.inf
            outside, wide_out = mean.min(1), np.where(np.isfinite(mean), wide, 0.0).max(1)
            largest = np.maximum(inside, outside)
            alone = (d.sizes[own] < 2) | (largest == 0)
            value = np.where(alone, 0.0, (outside - inside) / np.where(largest > 0, largest, 1.0))
            # (b - a) / max(a, b) moves by at most twice the relative change of a and b.
            error = np.where(alone, 0.0, 2 * (wide_in + wide_out) / np.where(largest > 0, largest, 1.0))
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            found = (n.sum(), (n * value).sum(), (n * np.minimum(error, 2.0)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in found], ["n", "value", "error"])

    # Points near to each other come in one batch.
    near = points.repartitionByRange(F.get("x", F.lit(0)), F.get("x", F.lit(1)))
    found = near.mapInArrow(run, "n DOUBLE, value DOUBLE, error DOUBLE").agg(F.sum("n"), F.sum("value"), F.sum("error")).first()
    return found[1] / found[0], found[2] / found[0]


def _seeds(summary: Summary, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over the cells' means, weighed by what they hold."""
    chosen = [summary.mean[rng.choice(len(summary.n), p=summary.n / summary.n.sum())]]
    while len(chosen) < k:
        far = np.min([((summary.mean - c) ** 2).sum(1) for c in chosen], axis=0) * summary.n
        chosen.append(summary.mean[rng.choice(len(far), p=far / far.sum())] if far.sum() else chosen[0])
    return np.array(chosen)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, least = np.zeros(len(x), np.intp), np.full(len(x), np.inf)
    for i, center in enumerate(centers):
        far = sum((x[:, d] - v) ** 2 for d, v in enumerate(center))
        closer = far < least  # the lower number of equally near ones
        at[closer] = i
        least = np.where(closer, far, least)
    return at, least


def _moved(summary: Summary, centers: np.ndarray) -> np.ndarray:
    at, _ = _nearest(summary.mean, centers)
    n = np.bincount(at, weights=summary.n, minlength=len(centers))
    mean = np.stack([np.bincount(at, weights=summary.n * c, minlength=len(centers)) for c in summary.mean.T], 1) / np.maximum(n, 1e-300)[:, None]
    return np.where(n[:, None] > 0, mean, centers)


def fit_kmeans(
    vectors: DataFrame, ks: Sequence[int] = CLUSTER_COUNTS, seed: int = 42, restarts: int = 10, tolerance: float = TOLERANCE, column: str = "signals"
) -> dict[int, Clustering]:
    """The least-cost clustering of each count, over all restarts.

    Restarts begin with k-means++ on a summary of all rows, settle there, and then go on over
    the rows themselves until no centre of theirs moves by more than ``tolerance`` times the mean variance (squared).
    Every step is one aggregation for all that still move; what reaches the driver is a few
    numbers for each of their clusters.  Equal costs are told apart by the order of restarts.
    Equal points take part once, with their number.
    """
    rows = vectors.select(vector_to_array(F.col(column)).alias("x"))
    return _fit(equal_points(rows), Summary.edges_of(rows), ks, seed, restarts, tolerance)


def _fit(points: DataFrame, edges: list[np.ndarray], ks: Sequence[int], seed: int, restarts: int, tolerance: float) -> dict[int, Clustering]:
    """Of distinct points ``x`` with their number ``n``."""
    summary = Summary.of(points.withColumn("cluster", F.lit(0)), edges)
    if summary.mean.shape[0] == 0:
        raise ValueError("no rows to cluster")
    whole = summary.levels()[-1]
    limit = tolerance * float(np.trace(whole.spread[0])) / summary.mean.shape[1]
    settings = [(k, i) for k in ks for i in range(restarts)]
    centers = {}
    for k, i in settings:
        c = _seeds(summary, k, np.random.default_rng([seed, k, i]))
        for _ in range(MOST_STEPS):
            before, c = c, _moved(summary, c)
            if ((c - before) ** 2).sum() <= limit:
                break
        centers[k, i] = c
    moving, done = list(settings), {}
    for step in range(MOST_STEPS):
        sent = [(s, centers[s]) for s in moving]

        def sums(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, number, parts = _points(batch), [], []
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                for j, (_, c) in enumerate(sent):
                    at, far = _nearest(x, c)
                    parts.append(np.stack([np.bincount(at, weights=v, minlength=len(c)) for v in (n, n * far, *(n * x.T))], 1))
                    number += [j * 65536 + i for i in range(len(c))]
                v = np.concatenate(parts)
                ends = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["key", "v"])

        width = 2 + summary.mean.shape[1]
        total = points.mapInArrow(sums, "key LONG, v ARRAY<DOUBLE>").groupBy("key").agg(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).collect()
        table = {r[0]: np.array(r[1:]) for r in total}
        still = []
        for j, (s, c) in enumerate(sent):
            v = np.stack([table[j * 65536 + i] for i in range(len(c))])
            moved = np.where(v[:, :1] > 0, v[:, 2:] / np.maximum(v[:, :1], 1.0), c)
            if ((moved - c) ** 2).sum() <= limit or step == MOST_STEPS - 1:
                done[s] = Clustering(c, float(v[:, 1].sum()), v[:, 0].astype(np.int64))
            else:
                centers[s] = moved
                still.append(s)
        moving = still
        if not moving:
            break
    best = {}
    for k in ks:
        found = min((done[k, i] for i in range(restarts)), key=lambda f: round(f.cost, 6))
        order = np.lexsort(found.centers.T[::-1])
        best[k] = Clustering(found.centers[order], found.cost, found.sizes[order])
    return best


def clustering_metrics(vectors: DataFrame, models: dict[int, Clustering]) -> DataFrame:
    """Quality of given clusterings, the chosen one marked; ``silhouette_error`` bounds that of the silhouette."""
    rows = vectors.select(vector_to_array(F.col("signals")).alias("x"))
    return _metrics(equal_points(rows), Summary.edges_of(rows), models)


def _metrics(points: DataFrame, edges: list[np.ndarray], models: dict[int, Clustering]) -> DataFrame:
    rows = []
    for k, model in models.items():
        value, error = _silhouette(model._assigned(points, "x").withColumnRenamed(CLUSTER, "cluster"), edges)
        sizes, n = sorted(int(x) for x in model.sizes), int(model.sizes.sum())
        rows.append((k, model.cost, value, error, sizes[0], sizes[0] / n, sizes[-1] / n))
    schema = "k INT, inertia DOUBLE, silhouette_score DOUBLE, silhouette_error DOUBLE, min_cluster_size BIGINT, min_cluster_share DOUBLE, max_cluster_share DOUBLE"
    return select_clustering(points.sparkSession.createDataFrame(rows, schema))


def select_clustering(metrics: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Metrics with ``meets_min_share_rule`` and ``selected``: the best silhouette of those that meet the rule, or of all."""
    table = metrics.withColumn("meets_min_share_rule", F.col("min_cluster_share") >= MIN_SHARE)
    # One row per cluster count.
    place = F.row_number().over(Window.partitionBy(*within).orderBy(
        F.desc("meets_min_share_rule"), F.desc("silhouette_score"), F.desc("min_cluster_share"), "k"))
    return table.withColumn("selected", place == 1)


def kmeans_candidates(
    vectors: DataFrame, ks: Sequence[int] = CLUSTER_COUNTS, seed: int = 42, restarts: int = 10
) -> tuple[DataFrame, dict[int, Clustering]]:
    """Quality of each cluster count, the chosen one marked, and the best model per count."""
    rows = vectors.select(vector_to_array(F.col("signals")).alias("x"))
    points, edges = equal_points(rows), Summary.edges_of(rows)
    models = _fit(points, edges, ks, seed, restarts, TOLERANCE)
    return _metrics(points, edges, models), models


def assign_clusters(model: Clustering, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).drop("signals")


def _segment_counts(df: DataFrame) -> DataFrame:
    """Rows per cluster and segment: a few dozen rows at most."""
    return df.groupBy(CLUSTER, N.SEGMENT).agg(F.count(F.lit(1)).alias("n"))


def cluster_profiles(
    df: DataFrame, risk_cutoff: float = N.RISK_CUTOFF, margin_cutoff: float = N.MARGIN_CUTOFF
) -> DataFrame:
    """Size, mean and median signals, segment mix and a cautious label per cluster."""
    signals = {"predicted_late_delivery_risk": N.RISK, "expected_profit": N.EXPECTED_PROFIT, "predicted_margin": N.MARGIN}
    means = df.groupBy(CLUSTER).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{n}") for n, c in signals.items()])
    long = df.select(CLUSTER, F.inline(F.array(*[
        F.struct(F.lit(n).alias("signal"), F.col(c).cast("double").alias("v")) for n, c in signals.items()])))
    q = exact_quantiles(long, [CLUSTER, "signal"], "v", [0.5])
    medians = q.groupBy(CLUSTER).agg(
        *[F.max(F.when(F.col("signal") == n, F.col("quantile"))).alias(f"median_{n}") for n in signals])
    counts = _segment_counts(df)
    size = F.sum("n").over(Window.partitionBy(CLUSTER))
    shares = counts.withColumn("share", F.col("n") / size)
    entry = F.struct(F.col(N.SEGMENT), F.round("share", 6))
    mix = shares.groupBy(CLUSTER).agg(
        F.max_by(N.SEGMENT, F.struct("n", N.SEGMENT)).alias("dominant_ao3_priority_segment"),
        F.max("share").alias("dominant_ao3_segment_share"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("ao3_quadrant_distribution"))
    total = F.sum("row_count").over(Window.partitionBy(F.lit(1)))
    out = means.join(medians, CLUSTER).join(mix, CLUSTER).withColumn("row_share", F.col("row_count") / total)
    risk = F.when(F.col("mean_predicted_late_delivery_risk") >= risk_cutoff, "high risk").otherwise("low risk")
    margin = F.when(F.col("mean_predicted_margin") >= margin_cutoff, "high margin").otherwise("low margin")
    label = F.when(F.col("dominant_ao3_segment_share") < UNCLEAR_SHARE, "mixed / unclear").otherwise(F.concat_ws(" / ", risk, margin))
    return out.withColumn("suggested_interpretation_label", label)


def cluster_comparison(df: DataFrame) -> DataFrame:
    """How far clusters repeat the segments, and how many segments they split meaningfully."""
    counts = materialize(_segment_counts(df), "counts")  # read three times
    dominant = counts.groupBy(CLUSTER).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    weighted = dominant.agg((F.sum("top") / F.sum("all")).alias("weighted_dominant_segment_share"))
    whole = F.sum("n").over(Window.partitionBy(N.SEGMENT))
    split = counts.where(F.col(N.SEGMENT).isin(*N.OPERATIONAL_SEGMENTS)).withColumn("share", F.col("n") / whole)
    per_segment = split.groupBy(N.SEGMENT).agg(F.count_if(F.col("share") >= MEANINGFUL_SHARE).alias("m"))
    segments = per_segment.agg(F.count_if(F.col("m") >= 2)).scalar()
    share = F.col("weighted_dominant_segment_share")
    return weighted.select(
        share, segments.alias("segments_split"), (share >= DUPLICATE_SHARE).alias("mostly_duplicates_segments"),
        (share < UNCLEAR_SHARE).alias("hard_to_explain"))


def adoption(smallest: Column, silhouette_score: Column) -> Column:
    """Whether a clustering is worth keeping as context, beside the columns of its comparison."""
    return (
        F.when(smallest < MIN_SHARE, "do_not_adopt")
        .when(F.col("mostly_duplicates_segments"), "do_not_adopt")
        .when(F.col("hard_to_explain"), "document_but_do_not_use")
        .when(F.col("segments_split") == 0, "document_but_do_not_use")
        .when(silhouette_score < MIN_SILHOUETTE, "document_but_do_not_use")
        .otherwise("adopt_as_optional_context")
    )


def adoption_decision(metrics: DataFrame, comparison: DataFrame) -> DataFrame:
    """Whether the chosen clustering is worth keeping as context; both inputs are a row."""
    chosen = metrics.where("selected").select("k", "silhouette_score", "min_cluster_share")
    return comparison.join(chosen).select(
        "k", "silhouette_score", *comparison.columns, adoption(F.col("min_cluster_share"), F.col("silhouette_score")).alias("recommendation"))
