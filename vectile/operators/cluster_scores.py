"""Scores of a clustering: against true labels from a contingency table, or from the vectors themselves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.operators.blocks import BLOCK_VALUES, MAX_BLOCK_ROWS, TILE, Cell, block_pairs, map_block_pairs, pairwise, tile
from vectile.operators.blocks import Tiles
from vectile.session import cut

# -- against true labels -------------------------------------------------------------------------


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))


def label_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: adjusted_rand, mutual_info, homogeneity, completeness.

    Everything follows from sums of n ln n and n(n-1)/2 over cells and both margins, so no join is needed:
    MI = (S_cells - S_rows - S_cols) / N + ln N with S = sum of n ln n.
    """
    cells = contingency(df, true, pred)
    rows = cells.groupBy(true).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(pred).agg(F.sum("n").alias("n"))

    def sums(frame: DataFrame, tag: str) -> DataFrame:
        n = F.col("n").cast("double")
        return frame.agg(
            F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("ent"), F.sum(n * (n - 1) / 2).alias("pairs")
        ).withColumn("tag", F.lit(tag))

    three = sums(cells, "c").unionByName(sums(rows, "r")).unionByName(sums(cols, "p"))
    at = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c))).alias(f"{tag}_{c}")
    one = three.agg(F.max("total").alias("n"), *[at(t, c) for t in "crp" for c in ("ent", "pairs")])
    n = F.col("n")
    mi = F.greatest((F.col("c_ent") - F.col("r_ent") - F.col("p_ent")) / n + F.log(n), F.lit(0.0))
    h_true, h_pred = F.log(n) - F.col("r_ent") / n, F.log(n) - F.col("p_ent") / n
    expected = F.try_divide(F.col("r_pairs") * F.col("p_pairs"), n * (n - 1) / 2)
    top = (F.col("r_pairs") + F.col("p_pairs")) / 2
    same = (F.col("c_pairs") == F.col("r_pairs")) & (F.col("c_pairs") == F.col("p_pairs"))
    flat = F.lit(1e-12)
    return one.select(
        F.when(same, 1.0).otherwise(F.try_divide(F.col("c_pairs") - expected, top - expected)).alias("adjusted_rand"),
        mi.alias("mutual_info"),
        F.when(h_true <= flat, 1.0).otherwise(mi / h_true).alias("homogeneity"),
        F.when(h_pred <= flat, 1.0).otherwise(mi / h_pred).alias("completeness"),
    )


def compare_clusterings(df: DataFrame, true: str, first: str, second: str, *, tol: float = 1e-4) -> DataFrame:
    """One row: both adjusted Rand indices and whether they agree within ``tol``."""
    a = label_scores(df, true, first).select(F.col("adjusted_rand").alias("ari_first"))
    b = label_scores(df, true, second).select(F.col("adjusted_rand").alias("ari_second"))
    return a.select("ari_first", b.scalar().alias("ari_second")).withColumn(
        "same", F.abs(F.col("ari_first") - F.col("ari_second")) < tol
    )


# -- from the vectors ----------------------------------------------------------------------------


def _summary(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, n, mean array, ss): size, centroid and squared deviations, combined before the shuffle."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = df.groupBy(F.col(cluster).alias("cluster")).agg(Summarizer.metrics("count", "mean", "variance").summary(v).alias("s"))
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, x: a + x)
    return s.select(
        "cluster", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"),
        (spread * (F.col("s.count") - 1)).alias("ss"),
    )


def calinski_harabasz(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """One row: between over within dispersion, from one pass over the vectors."""
    per = _summary(df, vec, cluster)
    within = per.agg(F.sum("ss").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    x = F.col("x")
    axis = per.select("n", F.posexplode("mean").alias("pos", "x")).groupBy("pos").agg(
        (F.sum(F.col("n") * x * x) - F.sum(F.col("n") * x) * F.sum(F.col("n") * x) / F.sum("n")).alias("b")
    )
    between = axis.agg(F.sum("b"))
    b, w = between.scalar(), F.col("w")
    score = F.try_divide(b * (F.col("n") - F.col("k")), w * (F.col("k") - 1))
    return within.select(F.when(w == 0, 1.0).otherwise(score).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """One row: mean over clusters of the worst (s_i + s_j) / d_ij, centroid pairs done block by block."""
    centres = _summary(df, vec, cluster).select("cluster", "mean")
    v = F.col(vec).cast("array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with(v, "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    spread = (
        df.select(F.col(cluster).alias("cluster"), vec).join(centres, "cluster").groupBy("cluster").agg(F.avg(gap).alias("s"))
    )
    tiles = tile(centres.join(spread, "cluster"), "cluster", "mean", extra=["s"], n_cells=1)

    def worst(left, right, same) -> Iterator[pd.DataFrame]:
        for (la, a), (lb, b) in ((left, right),) if same else ((left, right), (right, left)):
            sa, sb = la["s"].to_numpy(), lb["s"].to_numpy()
            for i in range(0, len(a), TILE):
                d = pairwise("euclidean", a[i : i + TILE], b)
                if same:
                    d[np.arange(len(d)), i + np.arange(len(d))] = 0.0
                ratio = np.divide(sa[i : i + TILE, None] + sb[None, :], d, out=np.zeros_like(d), where=d > 1e-12)
                yield pd.DataFrame({"id": la["id"].to_numpy()[i : i + TILE], "worst": ratio.max(1)})

    pairs = block_pairs(tiles, tiles.near_cells(math.inf))
    found = map_block_pairs(tiles.points, pairs, worst, "id long, worst double")
    return found.groupBy("id").agg(F.max("worst").alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def silhouette_samples(df: DataFrame, id_col: str, vec: str, cluster: str) -> DataFrame:
    """(id, cluster, silhouette) with plain Euclidean distances; a lone member scores 0.

    The measure needs every distance. Blocks follow the clusters: a small cluster lies whole in one block, so
    a pair of blocks hands on only the least mean distance per row; a large one has blocks of its own and
    hands on one partial sum per row. Distances themselves never leave a task.
    """
    spark = df.sparkSession
    points = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), F.col(cluster).alias("c")
    )
    sizes = points.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    rows = min(MAX_BLOCK_ROWS, max(64, BLOCK_VALUES // max(width or 1, 1)), max(64, math.ceil(n / 8)))
    small = rows // 4
    large = sizes.where(F.col("size") > small).orderBy("c").collect()  # at most n / small clusters
    n_small = max(1, math.ceil((n - sum(r["size"] for r in large)) / rows))
    plan, at = [], n_small
    for r in large:
        k = math.ceil(r["size"] / rows)
        plan.append((r["c"], at, k))
        at += k
    own = spark.createDataFrame(plan, f"c {points.schema['c'].dataType.simpleString()}, first int, k int")
    slot = F.col("first") + F.pmod(F.xxhash64("id"), F.col("k"))
    placed = cut(
        points.join(sizes, "c").join(own, "c", "left").select(
            "id", "vec", "c", "size", F.col("first").isNull().alias("whole"),
            F.coalesce(slot, F.pmod(F.xxhash64("c"), F.lit(n_small))).cast("int").alias("block"),
        )
    )
    cell = Cell(0, n, 0.0, 0, at, ())

    def one_way(ia, ca, a, lb, b, same) -> Iterator[pd.DataFrame]:
        codes, inverse = np.unique(lb["c"].to_numpy(), return_inverse=True)
        size = np.zeros(len(codes))
        size[inverse] = lb["size"].to_numpy()
        member = np.zeros((len(b), len(codes)))
        member[np.arange(len(b)), inverse] = 1.0
        whole = bool(lb["whole"].iat[0])
        for s in range(0, len(a), TILE):
            d = pairwise("euclidean", a[s : s + TILE], b)
            if same:
                d[np.arange(len(d)), s + np.arange(len(d))] = 0.0
            sums = d @ member
            i, c = ia[s : s + TILE], ca[s : s + TILE]
            at_own = np.searchsorted(codes, c)
            hit = (at_own < len(codes)) & (codes[np.minimum(at_own, len(codes) - 1)] == c)
            mine = np.flatnonzero(hit)
            if whole:
                yield _rows(i[mine], sums[mine, at_own[mine]], None, True)
                means = sums / size
                means[mine, at_own[mine]] = np.inf
                least = means.min(1)
                ok = np.isfinite(least)
                yield _rows(i[ok], None, least[ok], False)
            else:
                yield _rows(i[hit], sums[hit, 0], None, True)
                yield _rows(i[~hit], sums[~hit, 0], None, False, codes[0], size[0])

    def _rows(i, total, least, mine, other=None, size=None) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "id": i, "mine": mine, "other": pd.array([other] * len(i), dtype="Int64"),
                "size": np.nan if size is None else size,
                "total": np.nan if total is None else total, "least": np.nan if least is None else least,
            }
        )

    def run(left, right, same) -> Iterator[pd.DataFrame]:
        for x, y in ((left, right),) if same else ((left, right), (right, left)):
            yield from one_way(x[0]["id"].to_numpy(), x[0]["c"].to_numpy(), x[1], y[0], y[1], same)

    schema = "id long, mine boolean, other long, size double, total double, least double"
    parts = map_block_pairs(placed, block_pairs(Tiles(placed, (cell,), None, "euclidean", 3.0), [(cell, cell)]), run, schema, split=False)
    nn = lambda c: F.when(~F.isnan(c), F.col(c))
    per = parts.groupBy("id", "mine", "other").agg(
        F.sum(nn("total")).alias("total"), F.max(nn("size")).alias("size"), F.min(nn("least")).alias("least")
    )
    both = per.groupBy("id").agg(
        F.sum(F.when(F.col("mine"), F.col("total"))).alias("own_total"),
        F.min(F.when(~F.col("mine"), F.coalesce(F.col("least"), F.col("total") / F.col("size")))).alias("b"),
    )
    a = F.try_divide(F.col("own_total"), F.col("size") - 1)
    score = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, "b")), F.lit(0.0)))
    return placed.select("id", "c", "size").join(both, "id").select("id", F.col("c").alias("cluster"), score.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vec: str, cluster: str) -> DataFrame:
    return silhouette_samples(df, id_col, vec, cluster).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_sq(df: DataFrame, vec: str, cluster: str) -> float:
    """The squared-Euclidean silhouette of ``pyspark.ml``: linear in the rows, a different number."""
    rows = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows)


def quality_partition_index(df: DataFrame, id_col: str, vec: str, cluster: str) -> DataFrame:
    """One row: least distance inside any cluster over the greatest between clusters."""
    tiles = tile(df, id_col, vec, extra=[cluster], n_cells=1)

    def extremes(left, right, same) -> Iterator[pd.DataFrame]:
        (la, a), (lb, b) = left, right
        ca, cb = la[cluster].to_numpy(), lb[cluster].to_numpy()
        low, high = np.inf, -np.inf
        for s in range(0, len(a), TILE):
            d = pairwise("euclidean", a[s : s + TILE], b)
            alike = ca[s : s + TILE, None] == cb[None, :]
            if (~alike).any():
                high = max(high, d[~alike].max())
            if same:
                alike[np.arange(len(d)), s + np.arange(len(d))] = False
            if alike.any():
                low = min(low, d[alike].min())
        yield pd.DataFrame({"low": [low], "high": [high]})

    pairs = block_pairs(tiles, tiles.near_cells(math.inf))
    found = map_block_pairs(tiles.points, pairs, extremes, "low double, high double")
    return found.agg(F.try_divide(F.min("low"), F.max("high")).alias("quality_partition_index"))


# -- registry ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClusterMetric:
    """``function(df, id_col, vec, cluster, label)`` gives one row with a column named ``column``."""

    name: str
    function: Callable[[DataFrame, str, str, str, str | None], DataFrame]
    column: str
    need_true_labels: bool


def _from_labels(column: str) -> Callable[..., DataFrame]:
    return lambda df, id_col, vec, cluster, label: label_scores(df, label, cluster).select(column)


LABEL_SCORES = ("adjusted_rand", "completeness", "homogeneity", "mutual_info")  # columns of label_scores
CLUSTER_METRICS = (
    ClusterMetric("adjusted-rand-index", _from_labels("adjusted_rand"), "adjusted_rand", True),
    ClusterMetric(
        "calinski-harabasz-index", lambda df, i, v, c, t: calinski_harabasz(df, v, c), "calinski_harabasz", False
    ),
    ClusterMetric("completeness-index", _from_labels("completeness"), "completeness", True),
    ClusterMetric("davies-bouldin", lambda df, i, v, c, t: davies_bouldin(df, v, c), "davies_bouldin", False),
    ClusterMetric("homogeneity-index", _from_labels("homogeneity"), "homogeneity", True),
    ClusterMetric("mutual-info-index", _from_labels("mutual_info"), "mutual_info", True),
    ClusterMetric("silhouette", lambda df, i, v, c, t: silhouette(df, i, v, c), "silhouette", False),
)


def evaluate_clusters(
    df: DataFrame, id_col: str, vec: str, cluster: str, *, label: str | None = None, param: str, param_value: Column | float,
    inertia: float | None = None, drop_noise: bool = False, metrics: Sequence[str] | None = None,
) -> DataFrame:
    """(param, param_value, metric, value): every registered score of one run, or the named ones, as long rows.

    Scores against true labels are left out when there is no label column or it holds one value only.
    Noise (-1) is scored as a cluster of its own unless ``drop_noise``.
    """
    rows = df.where(F.col(cluster) >= 0) if drop_noise else df
    has_truth = label is not None and label in df.columns and df.select(label).distinct().limit(2).count() > 1
    wanted = [
        m for m in CLUSTER_METRICS if (has_truth or not m.need_true_labels) and (metrics is None or m.name in metrics)
    ]
    frames = [
        m.function(rows, id_col, vec, cluster, label).select(F.lit(m.name).alias("metric"), F.col(m.column).cast("double").alias("value"))
        for m in wanted
        if m.column not in LABEL_SCORES
    ]
    if of_labels := [m for m in wanted if m.column in LABEL_SCORES]:  # all from one contingency table
        pairs = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(m.column).alias("value")) for m in of_labels])
        frames.append(label_scores(rows, label, cluster).select(F.inline(pairs)))
    if inertia is not None:
        frames.append(df.sparkSession.createDataFrame([("inertia", float(inertia))], "metric string, value double"))
    if not frames:  # the named scores all need true labels
        frames.append(df.sparkSession.createDataFrame([], "metric string, value double"))
    value = param_value if isinstance(param_value, Column) else F.lit(float(param_value))
    return reduce(DataFrame.unionByName, frames).select(
        F.lit(param).alias("param"), value.alias("param_value"), "metric", "value"
    )
