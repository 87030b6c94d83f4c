"""Model fitting, reduction, graph layout, whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectile.operators import cluster as cl
from vectile.operators import cluster_scores as sc
from vectile.operators import density as de
from vectile.operators import graph as gr
from vectile.operators import learn as ln
from vectile.operators import pairs as pr
from vectile.operators import reduce as rd
from vectile.operators import sampling as sp
from vectile.plans.clustering import ClusterRun, RunConfig
from vectile.plans.registry import query, table
from vectile.plans.score_queries import assigned
from vectile.plans.vector_queries import K, KNN_SQL, edges_of
from vectile.session import cut, spread


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# -- density tree --------------------------------------------------------------------------------

CUT_HEIGHT = 1.2


@query(
    "single_linkage_cut",
    f"""WITH RECURSIVE {KNN_SQL}, core AS (SELECT i AS id, max(d) AS core FROM k WHERE rank <= 4 GROUP BY i),
        b AS (SELECT n.i, n.j FROM n JOIN core ci ON ci.id = n.i JOIN core cj ON cj.id = n.j
              WHERE greatest(n.d, ci.core, cj.core) <= {CUT_HEIGHT}),
        r AS (SELECT id, id AS root FROM e UNION SELECT b.j, r.root FROM r JOIN b ON b.i = r.id)
        SELECT id, min(root) AS component FROM r GROUP BY id""",
)
def single_linkage_cut(spark, sf):
    tiles = de.reachability_tiles(vectors(spark, sf), "id", "vector", min_samples=5)
    return de.single_linkage_cut(de.spanning_tree(tiles), tiles.points.select("id"), CUT_HEIGHT)


@query("mst_edges")
def mst_edges(spark, sf):
    tiles = de.reachability_tiles(vectors(spark, sf), "id", "vector", min_samples=5)
    return de.spanning_tree(tiles).withColumn("w", F.round("w", 6))


@query("hdbscan")
def hdbscan(spark, sf):
    return de.hdbscan(vectors(spark, sf), "id", "vector", min_cluster_size=5)


# -- graphs --------------------------------------------------------------------------------------


@query("graph_communities")
def graph_communities(spark, sf):
    edges, points, members = edges_of(spark, sf)
    found = gr.graph_communities(edges.select("i", "j", F.exp(-F.col("d") * F.col("d")).alias("w")), points)
    return members.join(found.withColumnRenamed("id", "rep"), "rep").select("id", "cluster")


RESIDUAL = 1e-3


@query("fuzzy_graph")
def fuzzy_graph(spark, sf):
    knn = pr.knn_join(vectors(spark, sf), "id", "vector", K)
    return gr.fuzzy_graph(knn, K).withColumn("w", F.round("w", 6))


@query("spectral_layout")
def spectral_layout(spark, sf):
    knn = pr.knn_join(vectors(spark, sf), "id", "vector", K)
    return gr.spectral_layout(gr.fuzzy_graph(knn, K), dims=2, tol=RESIDUAL)


@query(
    "spectral_residual",
    """SELECT axis, count(*) AS n, true AS unit, true AS orthogonal, true AS solved
       FROM embeddings, (VALUES ('x_0'), ('x_1')) a(axis) GROUP BY axis""",
)
def spectral_residual(spark, sf):
    """Whether the layout, taken back to its edges, is orthonormal and solves its eigen-equation to the tolerance."""
    edges = cut(gr.fuzzy_graph(pr.knn_join(vectors(spark, sf), "id", "vector", K), K))
    return gr.layout_residuals(edges, cut(gr.spectral_layout(edges, dims=2, tol=RESIDUAL)), ["x_0", "x_1"]).select(
        "axis", "n", (F.abs(F.col("norm") - 1) < 1e-6).alias("unit"), (F.col("overlap") < 1e-6).alias("orthogonal"),
        (F.col("residual") <= RESIDUAL * 1.01).alias("solved"),
    )


@query("projection_long")
def projection_long(spark, sf):
    rows = assigned(spark, sf).select(F.col("vec_id").alias("id"), "embedding", "label", "cluster")
    points, _ = rd.pca_project(rows, "id", "embedding", 2)
    return rd.projection_long(points.join(rows.drop("embedding"), "id"), "id", {"original": "label", "calculated": "cluster"})


@query("pca_project")
def pca_project(spark, sf):
    points, ratio = rd.pca_project(vectors(spark, sf), "id", "vector", 2)
    p = F.col("point")
    return points.select("id", F.round(p[0], 6).alias("pc0"), F.round(p[1], 6).alias("pc1"), F.lit(round(ratio, 6)).alias("explained"))


# -- centroid clustering and whole runs ----------------------------------------------------------


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    labels, _, _ = cl.kmeans_fit(vectors(spark, sf), "id", "vector", n_clusters=10, n_init=2)
    return labels


@query("sweep_kmeans")
def sweep_kmeans(spark, sf):
    """Inertia and silhouette for k = 2 .. 19, fitted together."""
    fits = cl.kmeans_sweep(vectors(spark, sf), "id", "vector", range(2, 20))
    rows = [("n_clusters", float(k), "inertia", cost) for k, (_, cost, _) in fits.items()]
    rows += [("n_clusters", float(k), "silhouette-sq", s) for k, (_, _, s) in fits.items()]
    return spark.createDataFrame(rows, "param string, param_value double, metric string, value double")


@query("cluster_run")
def cluster_run(spark, sf):
    config = RunConfig("k-means", {"n_clusters": 10}, "pca", {"n_components": 8})
    return ClusterRun(vectors(spark, sf), config, label_col="label").run()[1]


@query("evaluate_clusters")
def evaluate_clusters(spark, sf):
    rows = assigned(spark, sf)
    return sc.evaluate_clusters(cut(rows), "vec_id", "embedding", "cluster", label="label", param="n_clusters", param_value=10)


# -- supervised ----------------------------------------------------------------------------------


def labelled_words(spark, sf):
    docs = spread(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"))
    return ln.text_rows(docs, "doc_id", "text", "quality")


@query("train_classifier")
def train_classifier(spark, sf):
    rows = cut(sp.split_fractions(labelled_words(spark, sf), "doc_id"))
    model = ln.train_classifier(rows.where("split = 'train'"), "quality")
    scored = cut(ln.predict(model, rows.where("split = 'test'"), "doc_id", "quality"))
    return ln.evaluate(scored, "quality")


@query("predict_batch")
def predict_batch(spark, sf):
    rows = cut(labelled_words(spark, sf))
    return ln.predict(ln.train_classifier(rows, "quality"), rows, "doc_id", "quality")


@query("cv_accuracy")
def cv_accuracy(spark, sf):
    folds = cut(sp.kfold(labelled_words(spark, sf), "doc_id", k=5))
    return ln.cross_validate(folds, "doc_id", "quality", "fold", n_features=1 << 12, max_iter=10)[0]


@query(
    "regress_cv",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) - 1 AS position,
                  count(*) OVER () AS n FROM orders),
       f AS (SELECT o_orderkey, CAST(CASE WHEN position < (n % 5) * (n // 5 + 1) THEN position // (n // 5 + 1)
             ELSE n % 5 + (position - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS INTEGER) AS fold FROM r),
       x AS (SELECT fold, l_quantity AS x, l_extendedprice AS y FROM lineitem JOIN f ON f.o_orderkey = l_orderkey),
       m AS (SELECT k.fold, regr_slope(x.y, x.x) AS b, regr_intercept(x.y, x.x) AS a
             FROM (SELECT DISTINCT fold FROM f) k JOIN x ON x.fold <> k.fold GROUP BY k.fold)
       SELECT x.fold, round(avg((y - a - b * x) * (y - a - b * x)), 2) AS mse, round(avg(abs(y - a - b * x)), 4) AS mae
       FROM x JOIN m ON m.fold = x.fold GROUP BY x.fold""",
)
def regress_cv(spark, sf):
    folds = sp.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", shuffle=True)
    rows = table(spark, sf, "lineitem").join(folds, F.col("l_orderkey") == F.col("o_orderkey"))
    out = ln.regress_cv(rows, ["l_quantity"], "l_extendedprice", "fold")
    return out.select("fold", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


@query("embed_word2vec")
def embed_word2vec(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    vec = ln.embed_word2vec(cut(ln.text_rows(docs, "doc_id", "text")), "doc_id", width=16, partitions=4)
    return vec.select("doc_id", F.posexplode("vector").alias("pos", "value"))
