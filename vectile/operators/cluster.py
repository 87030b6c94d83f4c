"""Centroid and threshold clustering of keyed vectors and edge tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectile.functions.keys import order_key, unit_float
from vectile.operators.blocks import pairwise
from vectile.operators.graph import connected_components
from vectile.operators.ranking import range_positions
from vectile.session import cut

# -- k-means -------------------------------------------------------------------------------------

INIT_MODES = {"k-means++": "k-means||", "scalable-k-means++": "k-means||", "random": "random"}  # fixed names


def kmeans_fit(
    df: DataFrame, id_col: str, vec_col: str, *, n_clusters: int = 2, init_method: str = "k-means++", n_init: int = 1,
    seed: int = 42,
) -> tuple[DataFrame, float, KMeansModel]:
    """(id, cluster) rows, inertia and model of the best of ``n_init`` runs."""
    if init_method not in INIT_MODES:
        raise ValueError(f"{init_method} should be within {sorted(INIT_MODES)}")
    points = df.select(F.col(id_col), array_to_vector(F.col(vec_col)).alias("features")).persist()
    best = None
    for run in range(n_init):
        model = KMeans(
            k=n_clusters, seed=seed + run, initMode=INIT_MODES[init_method], maxIter=100, tol=1e-4,
            featuresCol="features", predictionCol="cluster",
        ).fit(points)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    points.unpersist()
    cost, model = best
    labels = model.transform(df.select(F.col(id_col), array_to_vector(F.col(vec_col)).alias("features")))
    return labels.select(id_col, "cluster"), cost, model


def _centre_matrix(centres: Sequence[Sequence[float]]) -> np.ndarray:
    return np.asarray([list(c) for c in centres], dtype=float)


def _member(near: np.ndarray, k: int) -> np.ndarray:
    """0/1 matrix of rows by centres: sums per centre are one product with it."""
    out = np.zeros((len(near), k))
    out[np.arange(len(near)), near] = 1.0
    return out


def kmeans_assign(df: DataFrame, id_col: str, vec_col: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(id, cluster, d2): nearest centre (the lower number on ties) and its squared distance."""
    c = _centre_matrix(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy()).astype(float)
                near = pairwise("sqeuclidean", x, c).argmin(1)
                d2 = ((x - c[near]) ** 2).sum(1)
                yield pd.DataFrame({id_col: b["id"], "cluster": near.astype("int32"), "d2": d2})

    points = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    id_type = df.schema[id_col].dataType.simpleString()
    return points.mapInPandas(assign, f"`{id_col}` {id_type}, cluster int, d2 double")


def kmeans_lloyd(
    df: DataFrame, vec_col: str, centres: Sequence[Sequence[float]], *, iterations: int = 10, tol: float = 0.0
) -> list[list[float]]:
    """Lloyd steps from given centres. A batch sends one partial sum per centre; an empty centre stays."""
    c = _centre_matrix(centres)
    points = df.select(F.col(vec_col).alias("vec"))

    for _ in range(iterations):

        def partial(batches: Iterator[pd.DataFrame], c: np.ndarray = c) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros_like(c), np.zeros(len(c), dtype="int64")
            for b in batches:
                if len(b):
                    x = np.stack(b["vec"].to_numpy()).astype(float)
                    near = pairwise("sqeuclidean", x, c).argmin(1)
                    sums += _member(near, len(c)).T @ x
                    n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"cluster": np.arange(len(c)), "n": n, "sums": list(sums)})

        parts = points.mapInPandas(partial, "cluster int, n long, sums array<double>")
        rows = (
            parts.select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
            .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # k x width numbers
        )
        new = c.copy()
        for r in rows:
            if r["n"]:
                new[r["cluster"], r["pos"]] = r["s"] / r["n"]
        moved = float(np.abs(new - c).max())
        c = new
        if moved <= tol:
            break
    return c.tolist()


SEED_ROUNDS = 4  # oversampling rounds over all rows; each draws twice as many rows as centres are wanted


def _seeds(df: DataFrame, id_col: str, vec_col: str, ks: Sequence[int], init_method: str, seed: int) -> dict[int, np.ndarray]:
    """Starting centres of every k, drawn from all rows in the same scans; a k's draw doesn't depend on the others.

    Oversampling as in k-means||: a round draws 2k rows with a chance in proportion to their squared distance from
    the rows drawn so far (the least keys -log(u) / distance, with u a hash of id and round). All rows then count as
    weights of their nearest drawn row, and weighted k-means finds k centres of them. Fewer different rows, fewer centres.
    """
    if init_method == "random":
        rows = df.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).orderBy(order_key(id_col, seed), id_col).limit(max(ks)).collect()
        first = _centre_matrix([r[vec_col] for r in rows])
        return {k: first[: min(k, len(first))].copy() for k in ks}
    points = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    start = points.orderBy(order_key("id", seed), "id").limit(1).collect()
    if not start:
        return {k: np.zeros((0, 0)) for k in ks}
    drawn = {k: np.array([start[0]["vec"]], dtype=float) for k in ks}
    for r in range(SEED_ROUNDS):

        def draw(batches: Iterator[pd.DataFrame], now: dict = dict(drawn)) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x, u = np.stack(b["vec"].to_numpy()), np.maximum(b["u"].to_numpy(), 1e-300)
                for k, c in now.items():
                    gap = pairwise("sqeuclidean", x, c).min(1)
                    gap[gap <= 1e-12 * np.maximum((x * x).sum(1), 1e-300)] = 0.0  # copies of drawn rows
                    with np.errstate(divide="ignore"):
                        key = np.where(gap > 0, -np.log(u) / gap, np.inf)
                    at = np.argsort(key, kind="stable")[: 2 * k]
                    at = at[np.isfinite(key[at])]
                    if len(at):  # none where all rows of the batch are copies of drawn ones
                        yield pd.DataFrame({"k": k, "key": key[at], "vec": list(x[at])})

        one = points.withColumn("u", unit_float(F.concat(F.col("id"), F.lit(f":{seed}:{r}"))))
        order = Window.partitionBy("k").orderBy("key")
        picks = one.mapInPandas(draw, "k int, key double, vec array<double>").withColumn("rn", F.row_number().over(order))
        for k, rows in _grouped(picks.where(F.col("rn") <= 2 * F.col("k")).orderBy("k", "key").collect()).items():  # 2k rows of each k
            drawn[k] = np.concatenate([drawn[k], _centre_matrix(rows)])
    drawn = {k: np.unique(c, axis=0) for k, c in drawn.items()}

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {k: np.zeros(len(c), dtype="int64") for k, c in drawn.items()}
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy())
                for k, c in drawn.items():
                    acc[k] += np.bincount(pairwise("sqeuclidean", x, c).argmin(1), minlength=len(c))
        for k, n in acc.items():
            yield pd.DataFrame({"k": k, "c": np.arange(len(n)), "n": n})

    weights = {k: np.zeros(len(c)) for k, c in drawn.items()}
    for r in points.select("vec").mapInPandas(weigh, "k int, c int, n long").groupBy("k", "c").agg(F.sum("n").alias("n")).collect():
        weights[r["k"]][r["c"]] = r["n"]
    return {k: _recluster(c, weights[k], k, seed) for k, c in drawn.items()}


def _recluster(rows: np.ndarray, weight: np.ndarray, k: int, seed: int, starts: int = 10, steps: int = 20) -> np.ndarray:
    """Weighted k-means of the drawn rows: the best of some starts."""
    best = None
    for start in range(starts):
        c = _plus_plus(rows, weight, k, seed + 1000 * start)
        for _ in range(steps):
            near = pairwise("sqeuclidean", rows, c).argmin(1)
            mass = np.bincount(near, weights=weight, minlength=len(c))
            total = _member(near, len(c)).T @ (rows * weight[:, None])
            c = np.where(mass[:, None] > 0, total / np.maximum(mass, 1)[:, None], c)
        cost = float((pairwise("sqeuclidean", rows, c).min(1) * weight).sum())
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def _grouped(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["k"], []).append(r["vec"])
    return out


def _plus_plus(rows: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Greedy k-means++ over weighted rows."""
    rng = np.random.default_rng(seed)
    picks = [int(rng.choice(len(rows), p=weight / weight.sum()))]
    gap = pairwise("sqeuclidean", rows, rows[picks]).min(1)
    gap[picks] = 0.0
    while len(picks) < k and (gap * weight).max() > 0:
        share = gap * weight
        tries = rng.choice(len(rows), size=2 + int(np.log(k + 1)), p=share / share.sum())
        left = np.minimum(gap[None], pairwise("sqeuclidean", rows[tries], rows))
        best = int((left * weight[None]).sum(1).argmin())
        picks.append(int(tries[best]))
        gap = left[best]
        gap[picks] = 0.0
    return rows[picks]


def kmeans_sweep(
    df: DataFrame, id_col: str, vec_col: str, ks: Sequence[int], *, init_method: str = "k-means++", seed: int = 42,
    max_iter: int = 100, tol: float = 1e-4,
) -> dict[int, tuple[list[list[float]], float, float | None]]:
    """{k: (centres, inertia, squared silhouette)} for all k together: a step is one scan for the whole sweep.

    A batch sends one partial sum per centre. A run stops on its own once its centres move by less than
    ``tol`` of the mean variance. The silhouette (squared Euclidean) follows from cluster sums in one scan more.
    """
    if init_method not in INIT_MODES:
        raise ValueError(f"{init_method} should be within {sorted(INIT_MODES)}")
    points = df.select(F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull()).persist()
    centres = _seeds(df, id_col, vec_col, list(dict.fromkeys(ks)), init_method, seed)

    def sums(of: dict[int, np.ndarray]) -> dict[int, dict[str, np.ndarray]]:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = {k: [np.zeros(len(c), "int64"), np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)] for k, c in of.items()}
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["vec"].to_numpy())
                sq = (x * x).sum(1)
                for k, c in of.items():
                    d2 = pairwise("sqeuclidean", x, c)
                    near = d2.argmin(1)
                    n, sse, norm, total = acc[k]
                    n += np.bincount(near, minlength=len(c))
                    sse += np.bincount(near, d2[np.arange(len(x)), near], len(c))
                    norm += np.bincount(near, sq, len(c))
                    total += _member(near, len(c)).T @ x
            for k, (n, sse, norm, total) in acc.items():
                yield pd.DataFrame(
                    {"k": k, "c": np.arange(len(n)), "n": n, "sse": sse, "sq": norm, "total": list(total)}
                )

        parts = points.mapInPandas(partial, "k int, c int, n long, sse double, sq double, total array<double>")
        rows = parts.groupBy("k", "c").agg(
            F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sq").alias("sq"),
            Summarizer.sum(array_to_vector("total")).alias("total"),
        ).collect()  # one row per centre
        out = {k: {"n": np.zeros(len(c)), "sse": np.zeros(len(c)), "sq": np.zeros(len(c)), "total": np.zeros_like(c)} for k, c in of.items()}
        for r in rows:
            for name in ("n", "sse", "sq"):
                out[r["k"]][name][r["c"]] = r[name]
            out[r["k"]]["total"][r["c"]] = r["total"].toArray()
        return out

    active, spread = set(centres), None
    for _ in range(max_iter):
        stats = sums({k: centres[k] for k in active})
        for k, s in stats.items():
            if spread is None:
                n, total = s["n"].sum(), s["total"].sum(0)
                spread = max((s["sq"].sum() / n - ((total / n) ** 2).sum()) / len(total), 0.0)
            new = np.where(s["n"][:, None] > 0, s["total"] / np.maximum(s["n"], 1)[:, None], centres[k])
            if ((new - centres[k]) ** 2).sum() <= tol * spread:
                active.discard(k)
            centres[k] = new
        if not active:
            break
    final = sums(centres)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = dict.fromkeys(centres, 0.0)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vec"].to_numpy())
            sq = (x * x).sum(1)
            for k, c in centres.items():
                n, s = final[k]["n"], final[k]
                if (n > 0).sum() < 2:
                    continue
                size = np.maximum(n, 1)
                # mean squared distance to a cluster: |x|^2 - 2 x.mean + mean |y|^2
                d = sq[:, None] - 2 * x @ (s["total"] / size[:, None]).T + (s["sq"] / size)[None]
                d[:, n == 0] = np.inf
                near = pairwise("sqeuclidean", x, c).argmin(1)
                at = np.arange(len(x))
                own = d[at, near] * n[near] / np.maximum(n[near] - 1, 1)
                d[at, near] = np.inf
                other = d.min(1)
                top = np.maximum(own, other)
                acc[k] += np.where((n[near] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0).sum()
        yield pd.DataFrame({"k": list(acc), "s": list(acc.values())})

    scores = {r["k"]: r["s"] for r in points.mapInPandas(score, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    points.unpersist()
    out = {}
    for k in ks:
        n = final[k]["n"]
        silhouette = float(scores[k] / n.sum()) if (n > 0).sum() > 1 else None
        out[k] = (centres[k].tolist(), float(final[k]["sse"].sum()), silhouette)
    return out


# -- Butina --------------------------------------------------------------------------------------


def butina(
    edges: DataFrame, points: DataFrame, members: DataFrame | None = None, *, by: Sequence[str] = ()
) -> DataFrame:
    """(id, cluster, centroid) from neighbour pairs (i, j); clusters are numbered from 1.

    Points go by (neighbours, id) descending; the first undecided one becomes a centroid and takes its
    undecided neighbours. In rounds: a point that comes before all its undecided neighbours is a centroid,
    its neighbours are members; a member belongs to its foremost centroid. The result is the sequential one.

    ``points`` holds (id, copies); ``members`` (id, rep) spreads the result over copies. Copies share all
    neighbours, so the highest id of a group decides for the group. With ``by`` columns in edges and points,
    independent graphs (say, one per threshold) are clustered in the same rounds.
    """
    by = list(by)
    both = edges.select(*by, "i", "j").unionByName(edges.select(*by, F.col("j").alias("i"), F.col("i").alias("j")))
    at = lambda frame, end, *cols: frame.select(*by, F.col("id").alias(end), *cols)
    degree = both.join(at(points, "j", F.col("copies").alias("cj")), [*by, "j"]).groupBy(*by, F.col("i").alias("id")).agg(
        F.sum("cj").alias("n")
    )
    nodes = cut(
        points.join(degree, [*by, "id"], "left").select(
            *by, "id", F.struct((F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("deg"), F.col("id").alias("id")).alias("rank")
        )
    )
    graph = cut(both.join(at(nodes, "j", F.col("rank").alias("rj")), [*by, "j"]).select(*by, "i", "j", "rj"))
    live, undecided, rounds = graph, nodes, []
    while True:
        top = live.groupBy(*by, F.col("i").alias("id")).agg(F.max("rj").alias("best"))
        ranked = undecided.join(top, [*by, "id"], "left").withColumn(
            "first", F.col("best").isNull() | (F.col("rank") > F.col("best"))
        )
        beside = (
            live.join(at(ranked.where("first"), "j"), [*by, "j"], "left_semi")
            .select(*by, F.col("i").alias("id")).distinct().withColumn("beside", F.lit(True))
        )
        state = cut(
            ranked.join(beside, [*by, "id"], "left").select(*by, "id", "rank", "first", F.coalesce("beside", F.lit(False)).alias("beside"))
        )
        rounds.append(state.where("first"))
        undecided = state.where("not first and not beside").select(*by, "id", "rank")
        if undecided.isEmpty():
            break
        live = cut(
            live.join(at(undecided, "i"), [*by, "i"], "left_semi").join(at(undecided, "j"), [*by, "j"], "left_semi")
        )
    centres = rounds[0]
    for more in rounds[1:]:
        centres = centres.unionByName(more)
    order = [*[F.col(c) for c in by], F.desc("rank.deg"), F.desc("rank.id")]
    placed = range_positions(centres.select(*by, "id", "rank"), order)
    if by:
        placed = placed.join(placed.groupBy(*by).agg(F.min("position").alias("start")), by)
    else:
        placed = placed.withColumn("start", F.lit(0))
    numbered = cut(placed.select(*by, "id", (F.col("position") - F.col("start") + 1).cast("int").alias("cluster")))
    joined = (
        graph.select(*by, "i", "j").join(at(numbered, "j", "cluster"), [*by, "j"])
        .join(at(numbered, "i"), [*by, "i"], "left_anti")
        .groupBy(*by, F.col("i").alias("id")).agg(F.min("cluster").alias("cluster"), F.min_by("j", "cluster").alias("centroid"))
    )
    out = numbered.select(*by, "id", "cluster", F.col("id").alias("centroid")).unionByName(joined)
    return _spread(out, members)


def _spread(labels: DataFrame, members: DataFrame | None) -> DataFrame:
    if members is None:
        return labels
    rest = [c for c in labels.columns if c != "id"]
    return members.join(labels.withColumnRenamed("id", "rep"), "rep").select("id", *rest)


# -- DBSCAN --------------------------------------------------------------------------------------


def dbscan(edges: DataFrame, points: DataFrame, *, min_samples: int = 5, members: DataFrame | None = None) -> DataFrame:
    """(id, cluster, is_core): density clusters from the pairs within eps; noise is -1.

    A point counts itself. Clusters are numbered from 0 by their lowest core id; a border point goes to the
    lowest-numbered cluster it touches.
    """
    both = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    around = (
        both.join(points.select(F.col("id").alias("j"), F.col("copies").alias("cj")), "j")
        .groupBy("i").agg(F.sum("cj").alias("n")).withColumnRenamed("i", "id")
    )
    core = cut(
        points.join(around, "id", "left").where(F.coalesce("n", F.lit(0)) + F.col("copies") >= min_samples).select("id")
    )
    links = edges.join(core.withColumnRenamed("id", "i"), "i", "left_semi").join(
        core.withColumnRenamed("id", "j"), "j", "left_semi"
    )
    comp = connected_components(links, core)
    firsts = _spread(comp, members).groupBy("component").agg(F.min("id").alias("first"))
    numbers = range_positions(firsts, [F.col("first")]).select("component", F.col("position").cast("int").alias("cluster"))
    inside = cut(comp.join(numbers, "component").select("id", "cluster"))
    border = (
        both.join(inside.withColumnRenamed("id", "j"), "j").join(core.withColumnRenamed("id", "i"), "i", "left_anti")
        .groupBy(F.col("i").alias("id")).agg(F.min("cluster").alias("cluster"))
    )
    labelled = inside.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    out = points.select("id").join(labelled, "id", "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )
    return _spread(out, members)
