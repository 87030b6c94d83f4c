"""Edge-table graph jobs: components, modularity, communities, neighbour weights, spectral layout."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.functions.keys import order_key, unit_float
from vectile.session import cut

logger = logging.getLogger(__name__)


GRAIN = 500_000  # edges that one task makes a forest of
HUB = 10_000  # a node with more neighbours than this, and than a 250th of all edges, is joined in parts


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component), ascending, of every node that isn't the least itself."""
    names, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    root = np.arange(len(names))
    while True:
        # hook the greater root onto the lesser, then shorten the paths
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = lo < hi
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(root, hi[live], lo[live])
        while not np.array_equal(shorter := root[root], root):
            root = shorter
    apart = np.flatnonzero(root != np.arange(len(names)))
    return names[apart], names[root[apart]]


def _contracted(pairs: DataFrame) -> DataFrame:
    """(u, v) of each task's edges as a forest of stars around least nodes. Types without an array form stay as they are."""
    kind = pairs.schema["u"].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)) or pairs.schema["v"].dataType != kind:
        return pairs

    def stars(u: list, v: list) -> pa.RecordBatch:
        both = [pa.concat_arrays(x) for x in (u, v)]
        values = pc.unique(pa.concat_arrays(both))
        values = values.take(pc.sort_indices(values))  # places in order, so that the least place is the least value
        a, b = forest(*(pc.index_in(x, values).to_numpy(zero_copy_only=False).astype(np.int64) for x in both))
        return pa.record_batch([values.take(pa.array(a)), values.take(pa.array(b))], names=["u", "v"])

    def run(batches):
        u, v, held = [], [], 0
        for batch in batches:
            u.append(batch.column("u"))
            v.append(batch.column("v"))
            held += batch.num_rows
            if held > GRAIN:
                yield stars(u, v)
                u, v, held = [], [], 0
        if held:
            yield stars(u, v)

    return pairs.mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def connected_components(
    edges: DataFrame, ids: DataFrame | None = None, *, src: str = "i", dst: str = "j", forests: bool = True
) -> DataFrame:
    """(id, component): component = the lowest id reachable. ``ids`` adds the isolated rows. Ids of any ordered type.

    Every task first makes a forest of its edges, again after each round; what fits a task is done then. Without
    ``forests`` (Python in Arrow batches) the rounds are joins and groupings alone. Otherwise,
    alternating stars: every node links its greater neighbours to the lowest it knows, then its lower
    neighbours to the lowest of them, until the edge set is a set of stars. Minima are combined before the shuffle,
    and the joins that hand them back split the neighbours of a hub, such as the root of a large star. Null ends
    are no edges; a node whose only edge is to itself is a component.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    shorter = _contracted if forests else lambda pairs: pairs
    state = cut(shorter(named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    mark = _mark(state)
    while mark[0]:
        if forests and mark[0] <= GRAIN:
            state = cut(_contracted(state.coalesce(1)))
            if isinstance(state.schema["u"].dataType, (T.IntegralType, T.StringType)):
                break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_lowest(large, 2 * mark[0])
        # v = m keeps the link to the lowest, any other lower neighbour is linked to it
        state = cut(shorter(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()))
        seen, mark = mark, _mark(state)
        if mark == seen:
            break
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    if ids is None:
        ids = named.where("u = v").select(F.col("u").alias("id")).distinct().join(out, "id", "left_anti")
        return out.unionByName(ids.select("id", F.col("id").alias("component")))
    return ids.select("id").join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_lowest(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the lowest v of each u. At most ``total / bound`` = 500 nodes are hubs, so their list is sent."""
    bound = max(HUB, total // 500)
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if total <= bound:  # no node can have more neighbours than there are
        return pairs.hint("merge").join(low.select("u", "m"), "u").select("u", "v", "m")
    parts = F.ceil(F.col("n") / bound).cast("int")
    hubs = F.broadcast(low.where(F.col("n") > bound).select("u", parts.alias("parts")))
    dealt = pairs.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    copied = low.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.hint("merge").join(copied, ["u", "part"]).select("u", "v", "m")


def modularity(edges: DataFrame, labels: DataFrame, *, weight: str = "w") -> DataFrame:
    """One row: sum over communities of in-weight / W - (degree / 2W)^2."""
    lab = labels.select("id", "cluster")
    e = (
        edges.select("i", "j", F.col(weight).alias("w"))
        .join(lab.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), "i")
        .join(lab.select(F.col("id").alias("j"), F.col("cluster").alias("cj")), "j")
        .groupBy("ci", "cj").agg(F.sum("w").alias("w"))
    )
    deg = F.array(F.struct(F.col("ci").alias("c"), F.lit(0.0).alias("x")), F.struct(F.col("cj").alias("c"), F.lit(0.0).alias("x")))
    per = (
        e.select(F.explode(deg).alias("s"), "w", "ci", "cj")
        .groupBy(F.col("s.c").alias("c"))
        .agg(
            F.sum("w").alias("deg"),
            (F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)) / 2).alias("inside"),
        )
    )
    # an edge inside a community is listed under both of its ends, hence the halves
    whole = per.agg(F.sum("deg").alias("w2"), F.sum(F.col("deg") * F.col("deg")).alias("dd"), F.sum("inside").alias("ins"))
    return whole.select((F.col("ins") / (F.col("w2") / 2) - F.col("dd") / (F.col("w2") * F.col("w2"))).alias("modularity"))


def graph_communities(edges: DataFrame, ids: DataFrame | None = None, *, weight: str = "w", seed: int = 42) -> DataFrame:
    """(id, cluster): modularity communities, by merging while a merge raises modularity.

    Each round a coin makes every community a leaf or a hub. A leaf applies to the neighbouring hub of
    highest gain; a hub takes its best applicant, and every other whose gain stays positive even if all
    applicants were taken. So each round raises modularity without having to measure it, many communities
    merge at once, and no community's neighbours are gathered in one place. Clusters carry their lowest id.
    ``ids`` adds the rows without an edge, each on its own.
    """
    state = edges.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.sum(weight).alias("w")
    )
    state = cut(state)
    ends = state.select(F.col("a").alias("id"), "w").unionByName(state.select(F.col("b").alias("id"), "w"))
    deg = cut(ends.groupBy("id").agg(F.sum("w").alias("deg")))
    ids = deg.select("id") if ids is None else ids.select("id")
    twice = deg.agg(F.sum("deg")).first()[0]  # twice the total weight
    taken, r = [], 0
    while True:
        rated = cut(
            state.join(deg.toDF("a", "da"), "a").join(deg.toDF("b", "db"), "b")
            .where(F.col("w") > F.col("da") * F.col("db") / twice * (1 + 1e-12))
        )
        if rated.isEmpty():
            break
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed + r)), F.lit(2))  # noqa: E731, B023
        first = coin("a") == 1
        offers = rated.where(coin("a") != coin("b")).select(
            "w", F.when(first, F.col("a")).otherwise(F.col("b")).alias("leaf"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("hub"),
            F.when(first, F.col("da")).otherwise(F.col("db")).alias("dl"),
            F.when(first, F.col("db")).otherwise(F.col("da")).alias("dh"),
        )
        gain = (F.col("w") - F.col("dl") * F.col("dh") / twice).alias("gain")
        picks = offers.groupBy("leaf").agg(F.max(F.struct(gain, "hub", "dl", "dh", "w")).alias("p")).select("leaf", "p.*")
        hubs = picks.groupBy("hub").agg(F.sum("dl").alias("all"), F.max(F.struct("gain", "leaf")).alias("best"))
        sure = F.col("w") > F.col("dl") * (F.col("dh") + F.col("all") - F.col("dl")) / twice
        moves = cut(picks.join(hubs, "hub").where((F.col("leaf") == F.col("best.leaf")) | sure).select("leaf", "hub"))
        r += 1
        if moves.isEmpty():
            continue  # the coins separated no pair worth merging; throw again
        taken.append(moves)
        deg = cut(
            deg.join(moves.withColumnRenamed("leaf", "id"), "id", "left")
            .groupBy(F.coalesce("hub", "id").alias("id")).agg(F.sum("deg").alias("deg"))
        )
        state = (
            state.join(moves.toDF("a", "ha"), "a", "left").join(moves.toDF("b", "hb"), "b", "left")
            .select(F.coalesce("ha", "a").alias("x"), F.coalesce("hb", "b").alias("y"), "w").where("x <> y")
            .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
        )
        state = cut(state)
    links = None
    for m in taken:
        part = m.toDF("i", "j")
        links = part if links is None else links.unionByName(part)
    if links is None:
        return ids.select("id", F.col("id").alias("cluster"))
    return connected_components(links, ids).withColumnRenamed("component", "cluster")


def fuzzy_graph(knn: DataFrame, k: int) -> DataFrame:
    """(i, j, w), i < j: neighbour weights exp(-(d - rho)+ / sigma), joined as a + b - ab.

    rho is the least positive distance of a row; sigma makes the weights of its k neighbours sum to
    log2(k), found by bisection over the k distances of each row (a bounded array).
    """
    goal = math.log2(k)

    @F.pandas_udf("struct<rho: double, sigma: double>")
    def fit(d: pd.Series) -> pd.DataFrame:
        width = max((len(r) for r in d), default=0)
        x = np.full((len(d), width), np.inf)  # rows with fewer neighbours end in weights of zero
        for n, row in enumerate(d):
            x[n, : len(row)] = row
        rho = np.where(x > 0, x, np.inf).min(1, initial=np.inf)
        rho = np.where(np.isfinite(rho), rho, 0.0)
        gap = np.maximum(x - rho[:, None], 0.0)
        lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _ in range(64):  # all rows of the batch at once
            s = np.exp(-gap / mid[:, None]).sum(1)
            open_, over = np.abs(s - goal) >= 1e-9, s > goal
            hi, lo = np.where(open_ & over, mid, hi), np.where(open_ & ~over, mid, lo)
            step = np.where(np.isinf(hi), mid * 2, (lo + np.where(np.isinf(hi), 0.0, hi)) / 2)
            mid = np.where(open_, step, mid)
        return pd.DataFrame({"rho": rho, "sigma": np.maximum(mid, 1e-9)})

    rows = knn.groupBy("i").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # k values per row
    fitted = rows.select("i", fit("ds").alias("f")).select("i", "f.rho", "f.sigma")
    one_way = knn.join(fitted, "i").select(
        F.least("i", "j").alias("a"),
        F.greatest("i", "j").alias("b"),
        F.exp(-F.greatest(F.col("d") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w"),
    )
    # a pair occurs once or twice; a lone direction has product 0
    pair = one_way.groupBy("a", "b").agg(F.sum("w").alias("s"), F.max("w").alias("hi"), F.count(F.lit(1)).alias("n"))
    other = F.when(F.col("n") == 2, F.col("s") - F.col("hi")).otherwise(0.0)
    return pair.select(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("s") - F.col("hi") * other).alias("w"))


DEGREE = 8  # products with the graph between two restarts
GUARD = 3  # extra vectors of a block, so that the wanted ones have a gap to the rest


def spectral_layout(
    edges: DataFrame, *, dims: int = 2, iterations: int = 100, tol: float = 1e-4, seed: int = 42, weight: str = "w"
) -> DataFrame:
    """(id, x_0 .. x_{dims-1}): leading non-trivial eigenvectors of A = D^-1/2 W D^-1/2, each with ||Av - tv|| <= ``tol``.

    Restarted block Krylov iteration. A round multiplies a block by A ``DEGREE`` times along the Chebyshev
    recurrence (an edge join and a sum each); the best vectors of all these products (Rayleigh-Ritz) start the next
    round. Only the Gram matrix of the products, whose size hangs on ``dims`` alone, visits the driver. It also
    gives the residuals, so the loop ends by them; if ``iterations`` rounds don't reach ``tol`` it raises. Signs are
    fixed by the entry of the lowest id. Edges of no weight don't count; no edges give no rows; axes beyond the
    number of rows are zero.
    """
    both = edges.select("i", "j", F.col(weight).cast("double").alias("w")).where("w > 0")
    both = cut(both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")))
    deg = both.groupBy("i").agg(F.sum("w").alias("deg"))
    norm = cut(
        both.join(deg, "i").join(deg.withColumnsRenamed({"i": "j", "deg": "deg_j"}), "j")
        .select("i", "j", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg_j"))).alias("w"))
    )
    b = dims + GUARD
    width = 1 + b * (DEGREE + 1)
    # every row holds the trivial vector, then the products so far
    draws = [unit_float(F.concat(F.col("i").cast("string"), F.lit(f":{seed}:{c}"))) - 0.5 for c in range(b)]
    state = cut(deg.select(F.col("i").alias("id"), F.array(F.sqrt("deg"), *draws).alias("t")))
    if state.isEmpty():
        return state.select("id", *[F.lit(0.0).alias(f"x_{c}") for c in range(dims)])
    # A of product k is the mean of its neighbours in the recurrence, A of the first is the second
    shift = np.zeros((width, b * DEGREE))
    for k in range(DEGREE):
        for c in range(b):
            for to, part in ((k + 1, 0.5), (k - 1, 0.5)) if k else ((1, 1.0),):
                shift[1 + to * b + c, k * b + c] = part
    for r in range(iterations):
        state = _products(norm, _recombined(state, _orthogonal_start(_gram(state, 1 + b), b)), b)
        mix, residual = _ritz(_gram(state, width), shift, b, dims)
        state = _recombined(state, mix)
        logger.info("round %d: residual %.2g", r + 1, residual)
        if residual <= tol:
            break
    else:
        raise RuntimeError(f"spectral layout: residual {residual:.2g} after {iterations} rounds, above {tol:.2g}")
    state = cut(state)
    lead = state.orderBy("id").limit(1).first()["t"]
    return state.select(
        "id", *[(F.col("t")[1 + c] * (1.0 if lead[1 + c] >= 0 else -1.0)).alias(f"x_{c}") for c in range(dims)]
    )


def layout_residuals(edges: DataFrame, layout: DataFrame, axes: list[str], *, weight: str = "w") -> DataFrame:
    """(axis, n, norm, value, residual, overlap) of a spectral layout, measured on the edges themselves.

    ``value`` is the Rayleigh quotient v'Av, ``residual`` is ||Av - value v||, ``overlap`` the largest product with the
    trivial vector or another axis.
    """
    both = edges.select("i", "j", F.col(weight).cast("double").alias("w")).where("w > 0")
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    deg = cut(both.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("deg")))
    rows = layout.join(deg, "id")
    scaled = rows.select(F.col("id").alias("j"), *[(F.col(a) / F.sqrt("deg")).alias(a) for a in axes])
    pushed = both.join(scaled, "j").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(a)).alias(f"y_{a}") for a in axes])
    all_in = cut(rows.join(pushed, "id").select("id", "deg", *axes, *[(F.col(f"y_{a}") / F.sqrt("deg")).alias(f"y_{a}") for a in axes]))
    one = []
    for a in axes:
        v, y = F.col(a), F.col(f"y_{a}")
        others = [F.abs(F.sum(v * F.col(o))) for o in axes if o != a]
        trivial = F.abs(F.sum(v * F.sqrt("deg"))) / F.sqrt(F.sum(F.col("deg")))
        one.append(
            F.struct(
                F.lit(a).alias("axis"), F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(v * v)).alias("norm"),
                (F.sum(v * y) / F.sum(v * v)).alias("value"), F.sum(y * y).alias("yy"), F.sum(v * y).alias("vy"),
                (F.greatest(trivial, *others) if others else trivial).alias("overlap"),
            )
        )
    per = all_in.agg(F.array(*one).alias("s")).select(F.inline("s"))
    left = F.greatest(F.col("yy") - F.col("value") * F.col("vy"), F.lit(0.0))  # for v'y = value v'v
    return per.select("axis", "n", "norm", "value", F.sqrt(left).alias("residual"), "overlap")


def _gram(state: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns held in ``t``, summed by task and then by cell: width^2 numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["t"].to_numpy())
                acc += x.T @ x
        yield pd.DataFrame({"cell": np.arange(width * width), "s": acc.ravel()})

    gram = np.zeros(width * width)
    for r in state.select("t").mapInPandas(partial, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        gram[r["cell"]] = r["s"]
    return gram.reshape(width, width)


def _orthogonal_start(gram: np.ndarray, b: int) -> np.ndarray:
    """Coefficients of a unit trivial vector and of ``b`` unit vectors orthogonal to it."""
    mix = np.eye(1 + b)
    mix[0, 0] = 1.0 / math.sqrt(gram[0, 0])
    mix[0, 1:] = -gram[0, 1:] / gram[0, 0]
    norms = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", mix, gram, mix), 0.0))
    return mix / np.where(norms > 1e-9, norms, np.inf)  # a graph of fewer rows leaves vectors of zeros


def _recombined(state: DataFrame, mix: np.ndarray) -> DataFrame:
    """New columns as combinations of the old ones, row by row."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "t": list(np.stack(batch["t"].to_numpy()) @ mix)})

    return state.mapInPandas(apply, f"id {state.schema['id'].dataType.simpleString()}, t array<double>")


def _products(norm: DataFrame, state: DataFrame, b: int) -> DataFrame:
    """The block at the end of ``t`` followed by its products: T_1 = A T_0, T_k+1 = 2 A T_k - T_k-1."""
    state = cut(state)
    for k in range(DEGREE):
        now, before = 1 + k * b, 1 + (k - 1) * b
        last = state.select(F.col("id").alias("j"), *[F.col("t")[now + c].alias(f"v{c}") for c in range(b)])
        pushed = norm.join(last, "j").groupBy(F.col("i").alias("id")).agg(
            *[F.sum(F.col("w") * F.col(f"v{c}")).alias(f"y{c}") for c in range(b)]
        )
        new = [F.col(f"y{c}") * 2 - F.col("t")[before + c] if k else F.col(f"y{c}") for c in range(b)]
        state = cut(state.join(pushed, "id").select("id", F.concat("t", F.array(*new)).alias("t")))
    return state


def _ritz(gram: np.ndarray, shift: np.ndarray, b: int, dims: int) -> tuple[np.ndarray, float]:
    """(coefficients of the trivial vector and the ``b`` best ones, largest residual of the first ``dims``)."""
    n = shift.shape[1]
    inner, moved = gram[1 : 1 + n, 1 : 1 + n], gram[1 : 1 + n] @ shift
    both = shift.T @ gram @ shift
    size, axes = np.linalg.eigh(inner)
    keep = size > 1e-10 * size.max(initial=0.0)
    white = axes[:, keep] / np.sqrt(size[keep])
    small = white.T @ moved @ white
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:b]
    values, chosen = values[top], white @ vectors[:, top]
    mix = np.zeros((gram.shape[0], 1 + b))
    mix[0, 0] = 1.0
    mix[1 : 1 + n, 1 : 1 + len(top)] = chosen
    left = [c @ both @ c - 2 * t * (c @ moved @ c) + t * t * (c @ inner @ c) for t, c in zip(values[:dims], chosen.T, strict=False)]
    return mix, math.sqrt(max(max(left, default=0.0), 0.0))
