"""Properties and brute-force checks on small inputs, with the large-data paths forced on."""

import lzma
import tarfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectile.operators import class_scores as cs
from vectile.operators import cluster as cl
from vectile.operators import cluster_scores as sc
from vectile.operators import density as de
from vectile.operators import hierarchy as hi
from vectile.operators import graph as gr
from vectile.operators import learn as ln
from vectile.operators import pairs as pr
from vectile.operators import pooling as po
from vectile.operators import profile as pf
from vectile.operators import ranking as rk
from vectile.operators import reduce as rd
from vectile.operators import sampling as sp
from vectile.operators import sets as st
from vectile.operators import blocks
from vectile.operators.blocks import pairwise, tile
from vectile.plans.clustering import ClusterRun, RunConfig, TextRun
from vectile.plans.descriptors import register_model
from vectile.sources import readers, sinks

RNG = np.random.default_rng(7)
BLOBS = np.concatenate(
    [RNG.normal(c, s, (40, 3)) for c, s in [((0, 0, 0), 0.3), ((3, 0, 0), 0.4), ((0, 4, 0), 0.2), ((0.9, 0.9, 0), 0.15)]]
    + [RNG.uniform(-3, 6, (30, 3))]
)
COPIED = np.concatenate([BLOBS[:60], np.repeat(BLOBS[5:6], 40, axis=0)])  # a third of the rows are copies


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- ranking and sampling ------------------------------------------------------------------------


def test_positions_are_dense_and_layout_free(spark):
    a = rk.hash_positions(spark.range(500), "id")
    b = rk.hash_positions(spark.range(500).repartition(13), "id")
    pa = {r["id"]: r["position"] for r in a.collect()}
    assert sorted(pa.values()) == list(range(500))
    assert pa == {r["id"]: r["position"] for r in b.collect()}


def test_range_positions_spread_a_hot_value(spark):
    df = spark.range(600).withColumn("k", F.when(F.col("id") < 400, 7).otherwise(F.col("id")))
    rows = rk.range_positions(df, [F.col("k"), F.col("id")]).collect()
    want = {i: n for n, (k, i) in enumerate(sorted((7 if i < 400 else i, i) for i in range(600)))}
    assert {r["id"]: r["position"] for r in rows} == want


def test_running_totals_with_hot_group(spark):
    df = spark.range(300).select((F.col("id") >= 250).cast("int").alias("g"), "id", (F.col("id") % 5).alias("x"))
    got = {(r["g"], r["id"]): (r["run_x"], r["all_x"]) for r in rk.running_totals(df, [F.col("id")], ["x"], by=["g"]).collect()}
    run = Counter()
    total = {0: sum(i % 5 for i in range(250)), 1: sum(i % 5 for i in range(250, 300))}
    for i in range(300):
        g = int(i >= 250)
        run[g] += i % 5
        assert got[g, i] == (run[g], total[g])


@pytest.mark.parametrize("n", [0, 1, 137, 300])
def test_sample_size_is_exact(spark, n):
    ids = [r["id"] for r in sp.sample_exact(spark.range(300), "id", n).collect()]
    assert len(ids) == len(set(ids)) == n


def test_sample_too_large(spark):
    with pytest.raises(ValueError):
        sp.sample_exact(spark.range(10), "id", 11)
    assert sp.sample_exact(spark.range(10), "id", 11, strict=False).count() == 10
    assert sp.sample_exact(spark.range(10), "id", None).count() == 10


def test_null_group_keeps_its_quota(spark):
    df = spark.range(40).withColumn("g", F.when(F.col("id") < 20, "a"))
    assert sp.sample_per_group(df, "id", "g", 5).groupBy("g").count().orderBy("g").collect()[0]["count"] == 5


def test_fifty_rows_in_six_folds(spark):
    folds = sp.deal_folds(spark.range(50), "id")
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [9, 9, 8, 8, 8, 8]
    roles = sp.fold_experiments(folds, "id").groupBy("experiment").pivot("role").count().orderBy("experiment").collect()
    assert [r["test"] for r in roles] == [8] * 5
    assert [r["valid"] for r in roles] == [9, 9, 8, 8, 8]
    assert all(r["train"] + r["valid"] + r["test"] == 50 for r in roles)


def test_kfold_blocks(spark):
    rows = sp.kfold(spark.range(13), "id", k=5).orderBy("id").collect()
    assert [r["fold"] for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def greedy_groups(sizes, train=0.8, valid=0.1):
    n = sum(s for s, _ in sizes.values())
    a = b = 0
    out = {}
    for g, (s, _) in sorted(sizes.items(), key=lambda t: (-t[1][0], -t[1][1])):
        if a + s <= train * n:
            a, out[g] = a + s, "train"
        elif a + b + s <= (train + valid) * n:
            b, out[g] = b + s, "valid"
        else:
            out[g] = "test"
    return out


def test_group_split_equals_greedy_fill(spark):
    groups = np.concatenate([np.full(60, 0), RNG.integers(1, 60, 120)])
    df = spark.createDataFrame([(i, int(g)) for i, g in enumerate(groups)], "id long, g long")
    sizes = {g: (int((groups == g).sum()), int(np.flatnonzero(groups == g)[0])) for g in set(groups.tolist())}
    got = {r["g"]: r["split"] for r in sp.split_by_group(df, "id", "g").collect()}
    assert got == greedy_groups(sizes)


def test_no_one_partition_window(spark):
    text = plan(sp.shuffle_rank(spark.range(1000), "id"))
    ranked = [line for line in text.splitlines() if "row_number" in line and "Window" in line]
    assert ranked and all("__bucket" in line for line in ranked)


def test_filter_and_columns_reach_the_scan(spark):
    from vectile.plans import all_queries

    text = plan(all_queries()[0]["filter_outlier"](spark, "/root/testdata/sf0.001"))
    assert "LessThanOrEqual(o_totalprice,400000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


# -- profile -------------------------------------------------------------------------------------


def test_describe_with_hot_and_missing_values(spark):
    values = [5.0] * 200 + RNG.normal(0, 10, 300).tolist() + [None] * 20
    df = spark.createDataFrame([(v, None if v is None else v * 2) for v in values], "x double, y double")
    got = pf.describe_exact(df, ["x", "y"]).orderBy("column_name").collect()
    x = np.array([v for v in values if v is not None])
    assert got[0]["n"] == 500
    np.testing.assert_allclose([got[0][f"p{p}"] for p in (25, 50, 75)], np.percentile(x, [25, 50, 75]))
    np.testing.assert_allclose(got[1]["p75"], np.percentile(2 * x, 75))


def test_scale_and_constant(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (2, 4.0, 3)], "id int, x double, c int")
    assert [(r["x"], r["c"]) for r in pf.minmax_scale(df, ["x", "c"]).orderBy("id").collect()] == [(0.0, 0.0), (1.0, 0.0)]
    assert pf.drop_constant_columns(df, ["x", "c"]).columns == ["id", "x"]


# -- vectors -------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock", "chebyshev", "canberra", "braycurtis", "cosine"])
def test_pairs_with_pruned_cells(spark, metric):
    d = pairwise(metric, BLOBS, BLOBS)
    radius = float(np.quantile(d[np.triu_indices(len(d), 1)], 0.1))
    tiles = tile(frame(spark, BLOBS), "id", "v", metric=metric, n_cells=8, block_rows=16)
    got = {(r["i"], r["j"]) for r in pr.pairs_within(tiles, radius).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(d < radius - 1e-9), strict=True) if i < j}
    edge = {(i, j) for i, j in zip(*np.nonzero(d <= radius + 1e-9), strict=True) if i < j}
    assert want <= got <= edge


def test_far_cells_are_not_compared(spark):
    tiles = tile(frame(spark, np.concatenate([BLOBS, BLOBS + 100])), "id", "v", n_cells=8, block_rows=16, keep_nearest=3)
    every = len(tiles.cells) * (len(tiles.cells) + 1) // 2
    assert len(tiles.near_cells(0.5)) < every
    assert len(tiles.neighbour_cells(3)) < every


def test_neighbours_with_pruned_cells_and_copies(spark, monkeypatch):
    monkeypatch.setattr(blocks, "EXACT_VALUES", 100)
    for x in (BLOBS, COPIED):
        tiles = tile(frame(spark, x), "id", "v", n_cells=8, block_rows=16, keep_nearest=6)
        got = {(r["i"], r["rank"]): (r["j"], r["d"]) for r in pr.knn_tiles(tiles, 6).collect()}
        d = np.array([[np.sqrt(((a - b) ** 2).sum()) for b in x] for a in x])
        for i in range(len(x)):
            near = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:6]
            assert [got[i, r + 1][0] for r in range(6)] == [j for _, j in near]


def test_pair_joins_have_no_cartesian_product(spark):
    df = pr.similarity_join(frame(spark, BLOBS), "id", "v", 0.5)
    assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_condensed_length_of_five_rows(spark):
    x = RNG.integers(0, 10, (5, 3)).astype(float)
    assert pr.similarity_join(frame(spark, x), "id", "v", 1e6).count() == 10


def sequential_butina(d, t):
    n = len(d)
    near = [[j for j in range(n) if j != i and d[i, j] <= t] for i in range(n)]
    label, c = [0] * n, 0
    for _, i in sorted(((len(near[i]), i) for i in range(n)), reverse=True):
        if label[i]:
            continue
        c += 1
        for j in [i, *near[i]]:
            label[j] = label[j] or c
    return label


@pytest.mark.parametrize("data", ["blobs", "copies"])
def test_butina_is_the_sequential_one(spark, data):
    x = BLOBS if data == "blobs" else COPIED
    reps, members = pr.collapse_copies(frame(spark, x), "id", "v")
    edges = pr.similarity_join(reps, "id", "v", 0.45)
    got = [r["cluster"] for r in cl.butina(edges, reps.select("id", "copies"), members).orderBy("id").collect()]
    assert got == sequential_butina(dist(x), 0.45)
    if data == "copies":
        assert reps.count() == 60


def brute_dbscan(d, eps, m):
    n, near = len(d), [np.flatnonzero(row <= eps) for row in d]
    core = [len(a) >= m for a in near]
    label, c = [-1] * n, 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        while todo:
            p = todo.pop()
            if label[p] < 0:
                label[p] = c
                if core[p]:
                    todo += list(near[p])
        c += 1
    return label


def test_dbscan(spark):
    for x in (BLOBS, COPIED):
        reps, members = pr.collapse_copies(frame(spark, x), "id", "v")
        edges = pr.similarity_join(reps, "id", "v", 0.4)
        got = cl.dbscan(edges, reps.select("id", "copies"), min_samples=5, members=members).orderBy("id").collect()
        assert [r["cluster"] for r in got] == brute_dbscan(dist(x), 0.4, 5)


def test_components(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(40, i) for i in range(41, 60)] + [(70, 71)]
    edges = spark.createDataFrame([(max(p), min(p)) for p in pairs], "i long, j long")
    want = {**{i: 0 for i in range(31)}, **{i: 40 for i in range(40, 60)}, 70: 70, 71: 70, 80: 80}
    ids = spark.createDataFrame([(i,) for i in want], "id long")
    for hub in (gr.HUB, 3):  # with a low bound the star's root is joined in parts
        monkeypatch.setattr(gr, "HUB", hub)
        got = {r["id"]: r["component"] for r in gr.connected_components(edges, ids).collect()}
        assert got == want
    own = spark.createDataFrame([(5, 5), (None, 3), (8, 9)], "i long, j long")
    assert sorted(tuple(r) for r in gr.connected_components(own).collect()) == [(5, 5), (8, 8), (9, 8)]


def test_components_without_forests(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(40, i) for i in range(41, 60)] + [(5, 5), (70, 70), (None, 3)]
    edges = spark.createDataFrame(pairs, "i long, j long")
    want = {**{i: 0 for i in range(31)}, **{i: 40 for i in range(40, 60)}, 70: 70}
    for hub in (gr.HUB, 3):
        monkeypatch.setattr(gr, "HUB", hub)
        got = {r["id"]: r["component"] for r in gr.connected_components(edges, forests=False).collect()}
        assert {k: v for k, v in got.items() if k in want} == want


def brute_hierarchy(x, m, method="eom", epsilon=0.0):
    n, d = len(x), dist(x)
    core = np.sort(d, 1)[:, m - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    boss, top, kids, size, height = list(range(n)), list(range(n)), {}, dict.fromkeys(range(n), 1), {}

    def find(a):
        while boss[a] != a:
            a = boss[a]
        return a

    weight = 0.0
    for w, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            weight += w
            node = n + len(kids)
            kids[node], height[node] = (top[a], top[b]), w
            size[node] = size[top[a]] + size[top[b]]
            boss[b], top[a] = a, node

    def leaves(a):
        return [a] if a < n else leaves(kids[a][0]) + leaves(kids[a][1])

    found = {0: {"up": None, "birth": 0.0, "falls": [], "kids": [], "n": n}}
    todo = [(n + len(kids) - 1, 0)]
    while todo:
        node, c = todo.pop()
        lam = 1 / max(height[node], 1e-12)
        sides = kids[node]
        if min(size[s] for s in sides) >= m:
            for s in sides:
                k = len(found)
                found[k] = {"up": c, "birth": lam, "falls": [], "kids": [], "n": size[s]}
                found[c]["kids"].append(k)
                todo.append((s, k))
        else:
            for s in sides:
                if size[s] >= m:
                    todo.append((s, c))
                else:
                    found[c]["falls"] += [(p, lam) for p in leaves(s)]
    score, pick = {}, {}
    for c in sorted(found, reverse=True):
        me = found[c]
        own = sum(v - me["birth"] for _, v in me["falls"]) + sum(
            found[k]["n"] * (found[k]["birth"] - me["birth"]) for k in me["kids"]
        )
        inner = sum(score[k] for k in me["kids"])
        pick[c] = c > 0 and (not me["kids"] if method == "leaf" else (not me["kids"] or inner <= own))
        score[c] = max(own, inner) if me["kids"] else own
    if epsilon:
        risen = set()
        for c in (c for c in found if pick[c]):
            while found[c]["birth"] > 1 / epsilon and found[c]["up"] != 0:
                c = found[c]["up"]
            risen.add(c)
        pick = {c: c in risen for c in found}
    label = [-1] * n
    for c, me in found.items():
        owner, at = None, c
        while at is not None:
            owner, at = (at if pick[at] else owner), found[at]["up"]
        for p, _ in me["falls"]:
            label[p] = -1 if owner is None else owner
    names = {}
    return [-1 if v < 0 else names.setdefault(v, len(names)) for v in label], weight


def test_hdbscan_equals_brute_force(spark):
    tiles = de.reachability_tiles(frame(spark, BLOBS), "id", "v", min_samples=5)
    tree = de.spanning_tree(tiles)
    for method in ("eom", "leaf"):
        want, weight = brute_hierarchy(BLOBS, 5, method)
        got = de.condense(tree, tiles.points.select("id"), min_cluster_size=5, cluster_selection_method=method)
        assert [r["cluster"] for r in got.orderBy("id").collect()] == want
        assert tree.agg(F.sum("w")).first()[0] == pytest.approx(weight)


def brute_tree(x, m):
    d = dist(x)
    core = np.sort(d, 1)[:, m - 1]
    reach, inside, out = np.maximum(d, np.maximum(core[:, None], core[None])), [0], []
    while len(inside) < len(x):
        w, i, j = min((reach[i, j], min(i, j), max(i, j)) for i in inside for j in range(len(x)) if j not in inside)
        out.append((i, j, float(w)))
        inside.append(j if i in inside else i)
    return out


@pytest.mark.parametrize("seed,m,method,epsilon,grain", [(1, 2, "eom", 0.3, 6), (3, 3, "eom", 0.0, 20), (2, 2, "leaf", 0.3, None)])
def test_condensed_tree_in_small_ranges(spark, seed, m, method, epsilon, grain):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.3, (25, 2)), rng.normal(2, 0.5, (25, 2)), rng.uniform(-3, 5, (10, 2))])
    tree = spark.createDataFrame(brute_tree(x, m), "i long, j long, w double")
    got = de.condense(
        tree, frame(spark, x).select("id"), min_cluster_size=m, cluster_selection_method=method,
        cluster_selection_epsilon=epsilon, grain=grain,
    )
    assert [r["cluster"] for r in got.orderBy("id").collect()] == brute_hierarchy(x, m, method, epsilon)[0]


def test_condense_of_nothing_and_of_tiny_clusters(spark):
    tree, ids = spark.createDataFrame([], "i long, j long, w double"), spark.createDataFrame([(7,), (9,)], "id long")
    assert [r["cluster"] for r in de.condense(tree, ids).collect()] == [-1, -1]
    with pytest.raises(ValueError, match="at least 2"):
        de.condense(tree, ids, min_cluster_size=1)


def test_fold_of_deep_and_random_trees(spark):
    rng = np.random.default_rng(5)
    for shape in ("chain", "random"):
        n, free, kids = 40, list(range(-40, 0)), {}
        for node in range(n - 1):
            one = free.pop(0 if shape == "chain" else int(rng.integers(len(free))))
            two = free.pop(0 if shape == "chain" else int(rng.integers(len(free))))
            kids[node] = (one, two)
            free.insert(0, node)
        lo, add = rng.integers(0, 60, 2 * n - 1).astype(float), rng.integers(-3, 9, 2 * n - 1).astype(float)
        want, rows = {}, []
        for k, node in enumerate(range(-n, n - 1)):
            c = kids.get(node, (None, None))
            want[node] = max(lo[k], add[k] + sum(want[v] for v in c if v is not None))
            rows.append((node, *c, float(lo[k]), float(add[k])))
        nodes = spark.createDataFrame(rows, "node long, c1 long, c2 long, lo double, add double")
        for grain in (1, None):
            assert {r["node"]: r["value"] for r in hi.fold(nodes, grain).collect()} == want


def test_tree_over_many_cells(spark):
    t = tile(frame(spark, BLOBS), "id", "v", n_cells=8, block_rows=16)
    from dataclasses import replace

    flat = replace(t, points=t.points.withColumn("core", F.lit(0.0)))
    d, inside, want = dist(BLOBS), [0], 0.0
    while len(inside) < len(BLOBS):
        out = [i for i in range(len(BLOBS)) if i not in inside]
        gap = d[np.ix_(inside, out)]
        want += gap.min()
        inside.append(out[int(gap.min(0).argmin())])
    assert de.spanning_tree(flat).agg(F.sum("w")).first()[0] == pytest.approx(want)


def test_silhouette_large_and_small_clusters(spark):
    x = np.concatenate([RNG.normal(0, 1, (300, 2)), RNG.normal(4, 1, (20, 2)), RNG.normal(-5, 1, (3, 2)), [[9.0, 9.0]]])
    c = [0] * 300 + [1] * 20 + [2] * 3 + [3]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, c int")
    d, c = dist(x), np.array(c)
    want = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        want.append((b - a) / max(a, b))
    got = [r["silhouette"] for r in sc.silhouette_samples(df, "id", "v", "c").orderBy("id").collect()]
    np.testing.assert_allclose(got, want, atol=1e-7)


def test_communities_of_two_cliques(spark):
    pairs = [(i, j) for g in (0, 10) for i in range(g, g + 6) for j in range(i + 1, g + 6)] + [(5, 10)]
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i long, j long, w double")
    got = gr.graph_communities(edges)
    quality = gr.modularity(edges, got).first()[0]
    alone = gr.modularity(edges, got.select("id", F.col("id").alias("cluster"))).first()[0]
    best = gr.modularity(edges, got.select("id", (F.col("id") >= 10).cast("int").alias("cluster"))).first()[0]
    assert alone < quality <= best + 1e-12


def test_fuzzy_weights_sum_to_log2_k(spark):
    k = 8
    knn = pr.knn_join(frame(spark, BLOBS), "id", "v", k)
    rows = gr.fuzzy_graph(knn, k).collect()
    near = {}
    for r in knn.collect():
        near.setdefault(r["i"], {})[r["j"]] = r["d"]
    one = {}
    for i, ds in near.items():
        rho, lo, hi = min(ds.values()), 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(np.exp(-(v - rho) / mid) for v in ds.values()) < np.log2(k) else (lo, mid)
        one[i] = {j: np.exp(-(v - rho) / hi) for j, v in ds.items()}
    for r in rows:
        a, b = one[r["i"]].get(r["j"], 0.0), one[r["j"]].get(r["i"], 0.0)
        assert r["w"] == pytest.approx(a + b - a * b, abs=1e-6)


def test_spectral_layout_is_orthonormal_and_separates(spark):
    x = np.concatenate([RNG.normal(0, 1, (30, 2)), RNG.normal(6, 1, (30, 2))])
    knn = pr.knn_join(frame(spark, x), "id", "v", 10)
    weights = gr.fuzzy_graph(knn, 10).unionByName(spark.createDataFrame([(0, 30, 0.05)], "i long, j long, w double"))
    rows = gr.spectral_layout(weights, dims=1, iterations=25).orderBy("id").collect()
    v = np.array([r["x_0"] for r in rows])
    assert (v**2).sum() == pytest.approx(1.0)
    assert abs(np.sign(v[:30]).sum() - np.sign(v[30:]).sum()) >= 50


def test_spectral_layout_reaches_its_residual(spark):
    n = 120
    w = np.triu((RNG.random((n, n)) < 0.05) * RNG.random((n, n)), 1)
    w[np.arange(n - 1), np.arange(1, n)] += 0.3
    i, j = np.nonzero(w)
    rows = [(int(a), int(c), float(w[a, c])) for a, c in zip(i, j, strict=True)] + [(0, 900, 0.0)]
    got = gr.spectral_layout(spark.createDataFrame(rows, "i long, j long, w double"), dims=2, tol=1e-6).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(n))  # an edge of no weight adds no row
    full = w + w.T
    root = np.sqrt(full.sum(1))
    a = full / root[:, None] / root[None]
    values, vectors = np.linalg.eigh(a)
    x = np.array([[r["x_0"], r["x_1"]] for r in got])
    for c in (0, 1):
        want = vectors[:, -2 - c]
        assert np.linalg.norm(a @ x[:, c] - values[-2 - c] * x[:, c]) <= 2e-6
        np.testing.assert_allclose(np.abs(want @ x[:, c]), 1.0, atol=1e-5)
    with pytest.raises(RuntimeError):
        gr.spectral_layout(spark.createDataFrame(rows, "i long, j long, w double"), dims=2, tol=1e-13, iterations=1)


def test_spectral_layout_of_few_rows(spark):
    schema = "i long, j long, w double"
    assert gr.spectral_layout(spark.createDataFrame([], schema)).count() == 0
    two = gr.spectral_layout(spark.createDataFrame([(1, 2, 0.5)], schema), dims=2).orderBy("id").collect()
    assert [(r["id"], round(abs(r["x_0"]), 6), round(r["x_1"], 6)) for r in two] == [(1, 0.707107, 0.0), (2, 0.707107, 0.0)]


def test_pca_matches_svd(spark):
    points, ratio = rd.pca_project(frame(spark, BLOBS), "id", "v", 2)
    got = np.array([r["point"] for r in points.orderBy("id").collect()])
    centred = BLOBS - BLOBS.mean(0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    assert ratio == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())
    np.testing.assert_allclose(np.abs(got), np.abs(centred @ axes[:2].T), atol=1e-8)
    with pytest.raises(ValueError):
        rd.pca_project(frame(spark, BLOBS), "id", "v", 4)


def test_kmeans_and_lloyd(spark):
    df = frame(spark, BLOBS)
    labels, inertia, model = cl.kmeans_fit(df, "id", "v", n_clusters=4, n_init=2)
    near = cl.kmeans_assign(df, "id", "v", [c.tolist() for c in model.clusterCenters()])
    assert near.agg(F.sum("d2")).first()[0] == pytest.approx(inertia, rel=1e-3)
    moved = cl.kmeans_lloyd(df, "v", [BLOBS[0].tolist(), BLOBS[50].tolist(), [99.0, 99.0, 99.0]], iterations=2)
    assert moved[2] == [99.0, 99.0, 99.0]


def test_kmeans_sweep_fits_each_k(spark):
    df = frame(spark, BLOBS)
    fits = cl.kmeans_sweep(df, "id", "v", [1, 2, 5, 9])
    assert fits[1][2] is None
    assert fits[1][1] > fits[2][1] > fits[5][1] > fits[9][1]
    for k in (2, 5):
        centres, inertia, silhouette = fits[k]
        near = cl.kmeans_assign(df, "id", "v", centres)
        assert near.agg(F.sum("d2")).first()[0] == pytest.approx(inertia)
        assert sc.silhouette_sq(df.join(near, "id"), "v", "cluster") == pytest.approx(silhouette)
        _, other, _ = cl.kmeans_fit(df, "id", "v", n_clusters=k)
        assert inertia <= 1.15 * other
    run = ClusterRun(df, RunConfig("k-means", reduction=None), vec_col="v")
    assert run.sweep([2, 3]).count() == 8


# -- sets ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("threshold", [0.3, 0.65, 1.0])
def test_set_join_with_copies_and_hot_bits(spark, threshold, monkeypatch):
    monkeypatch.setattr(st, "HOT_ROWS", 8)
    base = [set(RNG.choice(120, RNG.integers(3, 40), replace=False).tolist()) | {0, 1} for _ in range(60)]
    near = [s ^ {int(RNG.integers(2, 120))} for s in base[:30]]
    sets = base + near + [base[0]] * 40
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, bits array<int>")
    distinct, members = st.distinct_sets(df, "id")
    got = {(r["i"], r["j"]): r["similarity"] for r in st.tanimoto_join(distinct, threshold, n_bits=128).collect()}
    reps = {}
    for i, s in enumerate(sets):
        reps[frozenset(s)] = i
    ids = sorted(reps.values())
    want = {}
    for a in ids:
        for b in ids:
            s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and s >= threshold:
                want[a, b] = s
    assert got == pytest.approx(want)
    assert members.count() == len(sets)


# -- scores --------------------------------------------------------------------------------------


def test_label_scores_closed_forms(spark):
    df = spark.createDataFrame([(0, 5, 0), (0, 5, 0), (1, 6, 0), (1, 6, 0)], "t int, p int, one int")
    same = sc.label_scores(df, "t", "p").first()
    assert same["adjusted_rand"] == 1.0 and same["mutual_info"] == pytest.approx(np.log(2))
    flat = sc.label_scores(df, "t", "one").first()
    assert (flat["adjusted_rand"], flat["homogeneity"], flat["completeness"]) == (0.0, 0.0, 1.0)


def test_binary_scores_without_a_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    row = cs.binary_scores(df, "t", "p").first()
    assert (row["precision"], row["recall"], row["f1"], row["mcc"], row["accuracy"]) == (0, 0, 0, 0, 1)
    assert cs.list_of_scores(2)[:5] == cs.list_of_scores(3)


def test_auc_with_ties(spark):
    t, s = RNG.integers(0, 2, 300), RNG.integers(0, 12, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, s, strict=True)], "t int, s int")
    pos, neg = s[t == 1], s[t == 0]
    want = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
    assert cs.roc_auc(df, "t", "s").first()[0] == pytest.approx(want)


def test_metric_rows_skip_without_truth(spark):
    df = frame(spark, BLOBS).withColumn("c", (F.col("id") < 80).cast("int")).withColumn("label", F.lit(1))
    rows = sc.evaluate_clusters(df, "id", "v", "c", label="label", param="k", param_value=2, inertia=1.5).collect()
    assert {r["metric"] for r in rows} == {"calinski-harabasz-index", "davies-bouldin", "silhouette", "inertia"}


# -- runs, sources, sinks ------------------------------------------------------------------------


def test_run_config_checks():
    assert RunConfig("k-means", reduction="pca").method == "K-MEANS"
    for bad in (
        {"method": "ward"}, {"params": {"nope": 1}}, {"params": {"seed": 1}}, {"reduction": "tsne"},
        {"reduction_params": {"device": "cuda"}},
    ):
        with pytest.raises(ValueError):
            RunConfig(**bad)


@pytest.mark.parametrize("method, values", [("butina", [0.3, 0.5]), ("dbscan", [3, 8])])
def test_sweep_shares_pairs(spark, method, values):
    df = frame(spark, BLOBS).withColumn("label", (F.col("id") / 40).cast("int"))
    run = ClusterRun(df, RunConfig(method, reduction=None), vec_col="v", label_col="label")
    rows = run.sweep(values).collect()
    assert {r["param_value"] for r in rows} == set(map(float, values))
    assert len(rows) == 7 * len(values)


def test_tar_archive(spark, tmp_path):
    body = tmp_path / "rows.tsv"
    body.write_text("a\tb\n1\tx\n2\ty\n")
    with lzma.open(tmp_path / "t.tar.xz", "wb") as xz, tarfile.open(fileobj=xz, mode="w|") as tar:
        tar.add(body, arcname="rows.tsv")
    rows = readers.read_archive(spark, str(tmp_path / "t.tar.xz"), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", "x"), ("2", "y")]


def test_molecule_record_with_caret_numbers(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("2\ngdb 1\t1.5\t2*^-3\nC 0.1 2*^-6 1.0 0.0\nH 1 2 3 0\n10 20\nCO\tCO\nInChI\n")
    row = readers.read_records(spark, str(tmp_path)).first()
    assert row["smiles"] == "CO" and row["props"] == [1.5, 2e-3]
    assert [tuple(a) for a in row["atoms"]] == [("C", 0.1, 2e-6, 1.0), ("H", 1.0, 2.0, 3.0)]


def test_metric_and_config_logs(spark, tmp_path):
    metrics = spark.createDataFrame([("k", 2.0, "silhouette", 0.5)], "param string, param_value double, metric string, value double")
    for run in ("a", "b"):
        sinks.log_metrics(metrics, str(tmp_path / "log"), run)
        sinks.log_config(spark, RunConfig(), str(tmp_path / "config"), run)
    assert spark.read.parquet(str(tmp_path / "log")).select("run_id").distinct().count() == 2
    fields = {r["field"]: r["value"] for r in spark.read.parquet(str(tmp_path / "config")).where("run_id = 'a'").collect()}
    assert fields["method"] == "K-MEANS"
    metrics.write.json(str(tmp_path / "scores.json"))
    assert spark.read.json(str(tmp_path / "scores.json")).first()["value"] == 0.5


def test_user_encoder(spark):
    def make():
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    df = spark.createDataFrame([(1, "banana"), (2, "x" * 5000)], "id long, text string")
    got = {r["id"]: r["vector"] for r in ln.embed_text(df, "id", "text", make, batch_size=1).collect()}
    assert got == {1: [6.0, 3.0], 2: [5000.0, 0.0]}


def test_coulomb_pair(spark):
    df = spark.createDataFrame([(1, [(6.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 2.0)])], "id int, a array<struct<z: double, px: double, py: double, pz: double>>")
    row = po.sorted_eigenvalues(df.select("id", po.coulomb_matrix(F.col("a")).alias("m")), "id", "m").first()["values"]
    m = np.array([[0.5 * 6**2.4, 3.0], [3.0, 0.5]])
    np.testing.assert_allclose(row, sorted(np.linalg.eigvalsh(m), key=lambda v: -abs(v)))


def test_dataset_catalog_picks_tasks_by_name(spark):
    data = spark.createDataFrame([(i, f"t{i}", i % 2, 10 + i) for i in range(20)], "id long, s string, first int, second int")
    catalog = {"d": readers.Dataset(lambda *_: data, "regression", "random", ["first", "second"], "id", "s")}
    rows = readers.load_dataset(spark, "", catalog, "d", tasks_wanted=["second"]).collect()
    assert all(r["labels"] == 10.0 + r["id"] for r in rows)
    assert Counter(r["split"] for r in rows) == {"train": 16, "valid": 2, "test": 2}
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "", catalog, "other")


def test_run_and_sweep_agree(spark):
    df = frame(spark, BLOBS).withColumnRenamed("v", "vector")
    for n_init in (1, 2):
        run = ClusterRun(df, RunConfig("k-means", {"n_clusters": 4, "n_init": n_init}, reduction=None))
        one = {(r["metric"], round(r["value"], 9)) for r in run.run()[1].collect() if r["value"] is not None}
        many = run.sweep([2, 4])
        assert one == {(r["metric"], round(r["value"], 9)) for r in many.where("param_value = 4").collect() if r["value"] is not None}


def test_weighted_pairs_lose_no_copy(spark):
    x = np.round(np.random.default_rng(8).random((60, 2)), 1)
    reps, members = pr.collapse_copies(frame(spark, x), "id", "v")
    top = {r["id"]: r["rep"] for r in members.collect()}
    got = {(r["i"], r["j"]): r["n_pairs"] for r in pr.weighted_pairs(pr.similarity_join(reps, "id", "v", 0.25), reps).collect()}
    want, d = {}, dist(x)
    for i in range(len(x)):
        for j in range(i):
            if d[i, j] <= 0.25:
                key = tuple(sorted((top[i], top[j])))
                want[key] = want.get(key, 0) + 1
    assert len(set(top.values())) < len(x) and got == want


def test_short_family_is_an_error(spark):
    df = spark.createDataFrame([(k, "t", 1, "a" if k else "b") for k in range(9)], "id long, text string, labels int, fam string")
    assert rd_load(df, ["a"], 6).count() == 6
    with pytest.raises(ValueError, match="too few"):
        rd_load(df, ["a", "b"], 6)


def rd_load(df, families, n):
    from vectile.sources.readers import load_multi_family

    return load_multi_family(df, "id", "fam", families, sample_size=n, strict=True)


def test_scores_as_json(spark, tmp_path):
    from vectile.sources.sinks import write_scores_json

    rows = spark.createDataFrame([("auc", 0.5), ("f1", 1.0)], "metric string, value double")
    paths = {write_scores_json(rows, str(tmp_path), "eval") for _ in range(2)}
    assert len(paths) == 2 and all(sorted(map(tuple, spark.read.json(p).collect())) == [("auc", 0.5), ("f1", 1.0)] for p in paths)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "x double")
    from vectile.operators.profile import histogram, minmax_scale

    got = sorted(str(r["x"]) for r in minmax_scale(df, ["x"]).collect())
    assert got == ["0.0", "0.5", "1.0", "None", "nan"]
    assert sorted((r["bin"], r["n"]) for r in histogram(df, ["x"], 2).collect()) == [(0, 1), (1, 2)]


def test_dedupe_keeps_one_id_a_key(spark):
    from vectile.operators.profile import dedupe_keep_first

    rows = [(1, "a"), (2, "a"), (1, "b"), (3, "b"), (None, "c"), (None, "a"), (5, None), (4, None), (7, ""), (1, "d"), (0, "d")]
    got = dedupe_keep_first(spark.createDataFrame(rows, "i long, k string"), "k", "i").collect()
    assert {tuple(r) for r in got} == {(1, "a"), (1, "b"), (None, "c"), (4, None), (7, ""), (0, "d")}


# -- runs from texts -----------------------------------------------------------------------------

TEXTS = [f"alpha beta gamma delta {w}" for w in "abcdef"] + [f"one two three four five {w}" for w in "uvwxyz"]


def text_frame(spark):
    rows = [(i, t, "x" if i < 6 else "y") for i, t in enumerate(TEXTS)] + [(12, None, "x"), (13, TEXTS[0], "x"), (14, "", "y")]
    return spark.createDataFrame(rows, "key long, body string, label string").withColumn("text", F.lit("other"))


def text_run(spark, config, **more):
    return TextRun(text_frame(spark), config, id_col="key", text_col="body", label_col="label", **more)


def test_text_run_clusters_sets_without_reduction(spark):
    run = text_run(spark, RunConfig("butina", {"threshold": 0.8}), descriptor="fingerprint", descriptor_params={"n_bits": 512})
    assert run.config.reduction is None
    out = run.report()
    got = {r["id"]: r["cluster"] for r in out.labels.collect()}
    assert set(got) == set(range(12)) | {13, 14}  # the null text takes no part
    assert len({got[i] for i in (*range(6), 13)}) == 1 and len({got[i] for i in range(6, 12)}) == 1 and len(set(got.values())) == 3
    scores = {r["metric"]: r["value"] for r in out.scores.collect()}
    assert len(scores) == 7 and scores["homogeneity-index"] == pytest.approx(1.0)
    assert out.projection.count() == 2 * len(got)
    bits = {r["id"]: set(r["feature"]) for r in run.features.collect()}
    edges, points, members = run._edges(0.5, "tanimoto")
    reps = {r["id"] for r in points.collect()}
    want = {(a, b) for a in reps for b in reps if a < b and len(bits[a] & bits[b]) >= 0.5 * len(bits[a] | bits[b]) > 0}
    assert {(r["i"], r["j"]) for r in edges.collect()} == want and members.count() == len(got)
    with pytest.raises(ValueError):
        run.cluster(threshold=1.0)


def test_text_run_from_vectors(spark):
    run = text_run(spark, RunConfig("butina", {"threshold": 0.9, "distance_metric": "tanimoto"}, reduction=None), descriptor_params={"dim": 16})
    assert run.config.params["distance_metric"] == "euclidean"
    rows = {r["id"]: np.array(r["vector"]) for r in run.rows.collect()}
    assert set(rows) == set(range(12)) | {13, 14} and all(len(v) == 16 for v in rows.values())
    assert all(np.linalg.norm(v) == pytest.approx(1) or not v.any() for v in rows.values())
    assert set(run.cluster()[0].columns) == {"id", "cluster"}
    named = text_run(spark, RunConfig("k-means", {"n_clusters": 2}, "pca", metrics=["silhouette"]), descriptor="word2vec", descriptor_params={"width": 4})
    assert [r["metric"] for r in named.run()[1].collect()] == ["silhouette", "inertia"]


def test_text_run_checks_names(spark):
    df = text_frame(spark)
    for more in ({"descriptor": "nope"}, {"descriptor_params": {"radii": 1}}, {"descriptor": "word2vec", "descriptor_params": {"seed": 1}}):
        with pytest.raises(ValueError):
            TextRun(df, RunConfig(reduction=None), id_col="key", text_col="body", **more)
    with pytest.raises(ValueError):
        RunConfig(metrics=["nope"])
    register_model("lengths-of-texts", lambda: lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts])
    run = TextRun(df, RunConfig("k-means", reduction=None), descriptor="lengths-of-texts", id_col="key", text_col="body")
    assert run.rows.where("id = 0").first()["vector"] == [float(len(TEXTS[0])), 1.0, 0.0]
    with pytest.raises(ValueError):
        register_model("Hashed", lambda: None)


def test_text_run_of_no_rows(spark):
    none = text_frame(spark).where("key < 0")
    run = TextRun(none, RunConfig("butina", reduction=None), descriptor="fingerprint", id_col="key", text_col="body")
    assert run.cluster()[0].count() == 0


# -- sizes ---------------------------------------------------------------------------------------


def test_fingerprints_are_hashed_many_at_once(spark):
    """Equal to the column expression, whatever the length of an n-gram (a block of md5 ends at 55 bytes)."""
    from vectile.functions import text as tx

    texts = ["", " ", "a", "b  a\tB a", "x" * 54 + " y", "x" * 55, "É ü ñ 漢字 a b", "b" * 60 + " c d e " + "z" * 11, None, "a b a b a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for radius, n_bits in ((2, 1 << 18), (0, 64), (3, 97)):
        got = {r["id"]: (r["bits"], r["n_on"]) for r in tx.fingerprint(df, "id", "text", radius=radius, n_bits=n_bits).collect()}
        want = df.where("text IS NOT NULL").select("id", tx.fingerprint_bits(F.col("text"), radius=radius, n_bits=n_bits).alias("b")).collect()
        assert got == {r["id"]: (r["b"], len(r["b"])) for r in want}
    plan = tx.fingerprint(df, "id", "text")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "md5" not in plan


def test_set_join_shuffles_no_pairs(spark, monkeypatch):
    """Sets that share common bits only leave nothing behind on disk, and no shuffle grows with their number."""
    monkeypatch.setattr(st, "HOT_ROWS", 50)
    rows = [(i, sorted({*range(20), *(int(x) for x in RNG.choice(1 << 12, 40))})) for i in range(300)]
    sets, members = st.distinct_sets(spark.createDataFrame(rows, "id long, bits array<int>"), "id")
    joined = st.tanimoto_join(sets, 0.6, n_bits=1 << 12)
    assert joined.count() == 0 and members.count() == 300
    assert "Exchange" not in joined._jdf.queryExecution().toString()
    r = sets.orderBy("id").first()
    assert st.unpack(r["bits"], r["n"]).tolist() == rows[0][1]


def test_label_scores_make_no_vectors(spark, monkeypatch):
    """Scores that read labels alone don't write out the vectors of sets, which are as wide as the bits."""
    from vectile.plans import clustering as runs

    written = []
    monkeypatch.setattr(runs, "cut", lambda df, real=runs.cut: written.append(df.columns) or real(df))
    run = text_run(spark, RunConfig("butina", {"threshold": 0.8}, metrics=["adjusted-rand-index"]), descriptor="fingerprint", descriptor_params={"n_bits": 512})
    assert [r["metric"] for r in run.run()[1].collect()] == ["adjusted-rand-index"]
    assert all("vector" not in columns for columns in written)


def test_measures_are_taken_where_pairs_are_found(spark):
    """The named distances and weights of a pair come from its block, as the expressions give them, and no pair is joined."""
    from vectile.functions import vectors as vx

    x = np.round(RNG.normal(0, 1, (60, 5)), 1)
    x[0], x[1], x[2] = 0.0, 2.0, 0.0  # no length; no variance
    x[2, 0] = 1.0
    df = spark.createDataFrame([(i, v.tolist(), i % 3 + 1) for i, v in enumerate(x)], "id long, v array<double>, copies long")
    found = pr.similarity_join(df, "id", "v", 2.5, weight="copies", measures=vx.METRICS)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner, (block", "")
    a, b = df.toDF("i", "a", "ci"), df.toDF("j", "b", "cj")
    want = a.join(b, F.col("i") < F.col("j")).select(
        "i", "j", (F.col("ci") * F.col("cj")).alias("n_pairs"), *[vx.distance(m, F.col("a"), F.col("b")).alias(m) for m in vx.METRICS]
    ).where("euclidean <= 2.5")
    rows = lambda d: {(r["i"], r["j"]): [r["n_pairs"], *(r[m] for m in vx.METRICS)] for r in d.collect()}
    got, want = rows(found), rows(want)
    assert got.keys() == want.keys() and any(None in v for v in want.values())
    for k, v in want.items():
        assert [y is None for y in got[k]] == [y is None for y in v]
        assert [y for y in got[k] if y is not None] == pytest.approx([y for y in v if y is not None], abs=1e-9)


def test_long_tables_travel_in_few_blocks(spark, monkeypatch):
    """A long block is compared in parts; its rows go to as many tasks as there are blocks, not parts."""
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 64)
    monkeypatch.setattr(blocks, "SHARES", 4)
    x = RNG.normal(0, 1, (1200, 3)).astype("float32")
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<float>")
    tiles = tile(df, "id", "v", n_cells=1)
    assert sum(c.blocks for c in tiles.cells) == 4 and dict(tiles.points.dtypes)["vec"] == "array<float>"
    d = pairwise("euclidean", x.astype(float), x.astype(float))
    i, j = np.nonzero(np.triu(d <= 0.3, 1))
    assert {(r["i"], r["j"]) for r in pr.pairs_within(tiles, 0.3).collect()} == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("many", [1_000_000, 0])
def test_provenance_sums_without_a_shuffle_of_grams(spark, many, monkeypatch):
    """The sums equal a grouping of the n-gram rows, with repeated and null ids; texts of one id alone are not shuffled."""
    from vectile.functions import text as tx

    monkeypatch.setattr(tx, "MANY_IDS", many)
    texts = ["a b a b c", "b a b a b", "", "É é x", None, "one two  three\ttwo", "a b", "z " * 70 + "end", "end"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "c b a"), (None, "n u"), (None, "u n"), (5, "one two  three\ttwo")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(2)
    for n_bits in (1 << 18, 8):
        want = tx.fingerprint_provenance(df, "id", "text", n_bits=n_bits).groupBy("id", "bit").agg(
            F.count(F.lit(1)).alias("n_grams"), F.min("gram").alias("first_gram")
        )
        got = tx.fingerprint_provenance(df, "id", "text", n_bits=n_bits, summed=True)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    once = tx.fingerprint_provenance(df.where("id NOT IN (0, 5)"), "id", "text", summed=True)
    assert "Exchange hashpartitioning" not in once._jdf.queryExecution().toString() and once.count() > 0


@pytest.mark.parametrize("near", [1, 16])
def test_spanning_tree_searches_only_uncertain_rows(spark, near, monkeypatch):
    """With nearest rows known the tree is the one of all pairs, ties by ids included, and fewer rows are compared."""
    asked = []
    whole = de.map_block_pairs
    monkeypatch.setattr(de, "map_block_pairs", lambda points, *a, **k: asked.append(points.where("ask").count()) or whole(points, *a, **k))
    monkeypatch.setattr(de, "NEAR", near)
    x = np.round(np.concatenate([BLOBS, BLOBS[:20]]), 1)  # copies and equal distances
    df = frame(spark, x)
    for samples in (1, 4):
        asked.clear()
        tiles = de.reachability_tiles(df, "id", "v", min_samples=samples)
        got = {(r["i"], r["j"]): r["w"] for r in de.spanning_tree(tiles).collect()}
        d = pairwise("euclidean", x, x)
        exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core = np.sort(exact, 1)[:, samples - 1]
        w = np.maximum(exact, np.maximum(core[:, None], core[None]))
        root, want = list(range(len(x))), {}

        def top(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in sorted(zip(*np.triu_indices(len(d), 1)), key=lambda e: (w[e], *e)):
            if (ra := top(a)) != (rb := top(b)):
                root[ra] = rb
                want[int(a), int(b)] = w[a, b]
        assert got == pytest.approx(want)
        assert near < 16 or sum(asked) < len(x)
