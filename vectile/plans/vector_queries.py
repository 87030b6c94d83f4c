"""Pairs, neighbours, threshold and density clusters over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectile.functions import vectors as vx
from vectile.operators import cluster as cl
from vectile.operators import graph as gr
from vectile.operators import pairs as pr
from vectile.operators import profile as pf
from vectile.operators.blocks import tile
from vectile.plans.registry import query, table
from vectile.session import cut

RADIUS = 1.15
K = 15

E_SQL = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PAIRS_SQL = f"""{E_SQL}, p AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d, a.v AS av, b.v AS bv
   FROM e a JOIN e b ON a.id < b.id)"""
# all pairs of rows, counted under the highest ids of their groups of copies
WEIGHED_SQL = f"""{PAIRS_SQL}, rep AS (SELECT id, max(id) OVER (PARTITION BY v) AS rep FROM e),
   w AS (SELECT least(ri.rep, rj.rep) AS i, greatest(ri.rep, rj.rep) AS j, p.d, p.av, p.bv
         FROM p JOIN rep ri ON ri.id = p.i JOIN rep rj ON rj.id = p.j)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def distinct_vectors(spark, sf):
    return pr.collapse_copies(vectors(spark, sf), "vec_id", "embedding")[0]


def edges_of(spark, sf, radius=RADIUS):
    """(edges, representatives with copies, members) at one radius."""
    reps, members = pr.collapse_copies(vectors(spark, sf), "vec_id", "embedding")
    reps = cut(reps)
    return pr.similarity_join(reps, "id", "embedding", radius), reps.select("id", "copies"), cut(members)


def weighed(spark, sf, radius=RADIUS, **options):
    """(i, j, d, n_pairs): see ``pairs.weighted_pairs``."""
    reps = cut(distinct_vectors(spark, sf))
    return pr.weighted_pairs(pr.similarity_join(reps, "id", "embedding", radius, weight="copies", **options), reps)


@query(
    "pair_distance",
    f"WITH {WEIGHED_SQL} SELECT i, j, round(min(d), 6) AS d, count(*) AS n_pairs FROM w WHERE d <= {RADIUS} GROUP BY i, j",
)
def pair_distance(spark, sf):
    return weighed(spark, sf).withColumn("d", F.round("d", 6))


@query(
    "pair_distance_full",
    f"""WITH {WEIGHED_SQL}, o AS (SELECT i, j, d FROM w WHERE d <= {RADIUS} UNION ALL SELECT j, i, d FROM w WHERE d <= {RADIUS}
        UNION ALL SELECT rep, rep, 0 FROM rep) SELECT i, j, round(min(d), 6) AS d, count(*) AS n_pairs FROM o GROUP BY i, j""",
)
def pair_distance_full(spark, sf):
    """Ordered pairs of rows, each row with itself too: a group of n copies has n * n."""
    reps = cut(distinct_vectors(spark, sf))
    across = pr.weighted_pairs(pr.similarity_join(reps, "id", "embedding", RADIUS), reps).where("i <> j")
    back = across.select(F.col("j").alias("i"), F.col("i").alias("j"), "d", "n_pairs")
    own = reps.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"), (F.col("copies") * F.col("copies")).alias("n_pairs"))
    return across.unionByName(back).unionByName(own).withColumn("d", F.round("d", 6))


@query(
    "pair_similarity",
    f"WITH {WEIGHED_SQL} SELECT i, j, round(1 - min(d), 6) AS s, count(*) AS n_pairs FROM w WHERE d <= {RADIUS} GROUP BY i, j",
)
def pair_similarity(spark, sf):
    return weighed(spark, sf).select("i", "j", F.round(1 - F.col("d"), 6).alias("s"), "n_pairs")


@query(
    "gaussian_similarity",
    f"WITH {WEIGHED_SQL} SELECT i, j, round(exp(-min(d) * min(d)), 6) AS w, count(*) AS n_pairs FROM w WHERE d <= {RADIUS} GROUP BY i, j",
)
def gaussian_similarity(spark, sf):
    return weighed(spark, sf).select("i", "j", F.round(F.exp(-F.col("d") * F.col("d")), 6).alias("w"), "n_pairs")


@query(
    "similarity_join",
    f"""WITH {WEIGHED_SQL} SELECT i, j, round(min(list_cosine_distance(av, bv)), 6) AS d, count(*) AS n_pairs FROM w
        WHERE list_cosine_distance(av, bv) <= 0.6 GROUP BY i, j""",
)
def similarity_join(spark, sf):
    return weighed(spark, sf, 0.6, metric="cosine").withColumn("d", F.round("d", 6))


METRIC_SQL = {
    "euclidean": "d",
    "sqeuclidean": "d * d",
    "cityblock": "list_sum(list_transform(z, lambda x: abs(x[1] - x[2])))",
    "chebyshev": "list_max(list_transform(z, lambda x: abs(x[1] - x[2])))",
    "minkowski": "pow(list_sum(list_transform(z, lambda x: pow(abs(x[1] - x[2]), 3))), 1.0::DOUBLE / 3)",
    "cosine": "list_cosine_distance(av, bv)",
    "correlation": """list_cosine_distance(list_transform(av, lambda x: x - list_avg(av)), list_transform(bv, lambda x: x - list_avg(bv)))""",
    "hamming": "list_avg(list_transform(z, lambda x: CASE WHEN x[1] <> x[2] THEN 1.0::DOUBLE ELSE 0 END))",
    "jaccard": "len(list_filter(z, lambda x: x[1] <> x[2]))::DOUBLE / len(list_filter(z, lambda x: x[1] <> 0 OR x[2] <> 0))",
    "canberra": "list_sum(list_transform(z, lambda x: abs(x[1] - x[2]) / (abs(x[1]) + abs(x[2]))))",
    "braycurtis": """list_sum(list_transform(z, lambda x: abs(x[1] - x[2]))) / list_sum(list_transform(z, lambda x: abs(x[1] + x[2])))""",
}


@query(
    "distance_metrics",
    f"""WITH {WEIGHED_SQL}, z AS (SELECT i, j, any_value(av) AS av, any_value(bv) AS bv, min(d) AS d, count(*) AS n_pairs,
               list_transform(list_zip(any_value(av), any_value(bv)), lambda t: [t[1], t[2]]) AS z FROM w WHERE d <= {RADIUS} GROUP BY i, j)
        SELECT i, j, n_pairs, {', '.join(f'round({e}, 6) AS {m}' for m, e in METRIC_SQL.items())} FROM z""",
)
def distance_metrics(spark, sf):
    reps = cut(distinct_vectors(spark, sf))
    across = pr.similarity_join(reps, "id", "embedding", RADIUS, weight="copies", measures=vx.METRICS)
    v = F.col("embedding").cast("array<double>")
    own = pr.pairs_of_copies(reps, *[vx.distance(m, v, v).alias(m) for m in vx.METRICS])
    return across.unionByName(own).select("i", "j", "n_pairs", *[F.round(m, 6).alias(m) for m in vx.METRICS])


KNN_SQL = f"""{E_SQL}, n AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id),
   k AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM n QUALIFY rank <= {K})"""


@query("knn_join", f"WITH {KNN_SQL} SELECT i, j, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM k")
def knn_join(spark, sf):
    return pr.knn_join(vectors(spark, sf), "vec_id", "embedding", K).withColumn("d", F.round("d", 6))


@query("core_distance", f"WITH {KNN_SQL} SELECT i AS id, round(max(d), 6) AS core FROM k WHERE rank <= 4 GROUP BY i")
def core_distance(spark, sf):
    from vectile.operators.density import core_distances

    t = tile(vectors(spark, sf), "vec_id", "embedding", keep_nearest=4)
    return core_distances(t, 5).withColumn("core", F.round("core", 6))


ADJ_SQL = f"""{PAIRS_SQL}, b AS (SELECT i, j FROM p WHERE d <= {{radius}} UNION ALL SELECT j, i FROM p WHERE d <= {{radius}})"""
BUTINA_SQL = """g AS (SELECT id, count(j) AS deg FROM e LEFT JOIN b ON b.i = id GROUP BY id),
   o AS (SELECT id, deg, row_number() OVER (ORDER BY deg DESC, id DESC) AS k FROM g),
   nb AS (SELECT o.k, list(o2.k) AS near FROM o JOIN b ON b.i = o.id JOIN o o2 ON o2.id = b.j GROUP BY o.k),
   s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS c UNION ALL
         SELECT s.k + 1, CASE WHEN nb.near IS NULL OR NOT list_has_any(nb.near, s.c) THEN list_append(s.c, s.k + 1) ELSE s.c END
         FROM s LEFT JOIN nb ON nb.k = s.k + 1 WHERE s.k < (SELECT count(*) FROM o)),
   f AS (SELECT c FROM s ORDER BY k DESC LIMIT 1),
   cc AS (SELECT unnest(c) AS k FROM f),
   own AS (SELECT cc.k AS k, cc.k AS ck FROM cc UNION ALL
           SELECT nb.k, (SELECT min(x) FROM unnest(list_intersect(nb.near, (SELECT c FROM f))) u(x))
           FROM nb WHERE nb.k NOT IN (SELECT k FROM cc)),
   num AS (SELECT k, row_number() OVER (ORDER BY k) AS cluster FROM cc),
   lab AS (SELECT o.id, CAST(num.cluster AS INTEGER) AS cluster, oc.id AS centroid
           FROM own JOIN o ON o.k = own.k JOIN num ON num.k = own.ck JOIN o oc ON oc.k = own.ck)"""


def butina_sql(radius):
    return f"RECURSIVE {ADJ_SQL.format(radius=radius)}, {BUTINA_SQL}"


def butina_labels(spark, sf, radius=RADIUS):
    edges, points, members = edges_of(spark, sf, radius)
    return cl.butina(cut(edges), points, members)


@query("butina", f"WITH {butina_sql(RADIUS)} SELECT id, cluster, centroid FROM lab")
def butina(spark, sf):
    return butina_labels(spark, sf)


@query(
    "cluster_size_report",
    f"""WITH {butina_sql(RADIUS)}, z AS (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster)
        SELECT count(*) AS n_clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons,
               count(*) FILTER (n > 5) AS over_5, count(*) FILTER (n > 25) AS over_25, count(*) FILTER (n > 100) AS over_100 FROM z""",
)
def cluster_size_report(spark, sf):
    return pf.cluster_size_report(butina_labels(spark, sf))


@query(
    "cluster_members",
    f"""WITH {butina_sql(RADIUS)} SELECT cluster, count(*) OVER (PARTITION BY cluster) AS size, id,
              id = centroid AS is_centroid FROM lab""",
)
def cluster_members(spark, sf):
    lab = cut(butina_labels(spark, sf))
    sizes = lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return lab.join(sizes, "cluster").select("cluster", "size", "id", (F.col("id") == F.col("centroid")).alias("is_centroid"))


SWEEP = (1.1, 1.15, 1.2)


@query(
    "sweep_thresholds",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {butina_sql(t)} SELECT {t}::DOUBLE AS threshold, count(DISTINCT cluster) AS n_clusters,
            max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster))"""
        for t in SWEEP
    ),
)
def sweep_thresholds(spark, sf):
    edges, points, members = edges_of(spark, sf, max(SWEEP))
    # one join at the widest radius; each threshold keeps its share, and all are clustered in the same rounds
    edges, grid = cut(edges), F.array(*map(F.lit, SWEEP))
    graphs = edges.withColumn("threshold", F.explode(grid)).where("d <= threshold")
    labels = cl.butina(graphs, points.withColumn("threshold", F.explode(grid)), members, by=["threshold"])
    sizes = labels.groupBy("threshold", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons")
    )


REACH_SQL = """r AS (SELECT id, id AS root FROM {nodes} UNION SELECT b.j, r.root FROM r JOIN {edges} b ON b.i = r.id),
   comp AS (SELECT id, min(root) AS component FROM r GROUP BY id)"""


@query(
    "connected_components",
    f"""WITH RECURSIVE {ADJ_SQL.format(radius=RADIUS)}, {REACH_SQL.format(nodes='e', edges='b')}
        SELECT id, component FROM comp""",
)
def connected_components(spark, sf):
    edges, points, members = edges_of(spark, sf)
    comp = gr.connected_components(edges, points)
    rows = cut(members.join(comp.withColumnRenamed("id", "rep"), "rep").select("id", "component"))
    lowest = rows.groupBy("component").agg(F.min("id").alias("low"))
    return rows.join(lowest, "component").select("id", F.col("low").alias("component"))


DBSCAN_OF_B_SQL = f"""core AS (SELECT id FROM e LEFT JOIN b ON b.i = id GROUP BY id HAVING count(j) + 1 >= 5),
   ce AS (SELECT i, j FROM b WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
   {REACH_SQL.format(nodes='core', edges='ce')},
   num AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster FROM (SELECT DISTINCT component FROM comp)),
   inside AS (SELECT id, cluster FROM comp JOIN num USING (component)),
   border AS (SELECT b.i AS id, min(cluster) AS cluster FROM b JOIN inside ON inside.id = b.j
              WHERE b.i NOT IN (SELECT id FROM core) GROUP BY b.i),
   lab AS (SELECT e.id, CAST(coalesce(inside.cluster, border.cluster, -1) AS INTEGER) AS cluster,
                  inside.id IS NOT NULL AS is_core
           FROM e LEFT JOIN inside ON inside.id = e.id LEFT JOIN border ON border.id = e.id)"""
DBSCAN_SQL = f"RECURSIVE {ADJ_SQL.format(radius=RADIUS)}, {DBSCAN_OF_B_SQL}"


def dbscan_labels(spark, sf):
    edges, points, members = edges_of(spark, sf)
    return cl.dbscan(cut(edges), points, min_samples=5, members=members)


@query("dbscan", f"WITH {DBSCAN_SQL} SELECT id, cluster, is_core FROM lab")
def dbscan(spark, sf):
    return dbscan_labels(spark, sf)


@query(
    "noise_split",
    f"""WITH {DBSCAN_SQL} SELECT CASE WHEN cluster >= 0 THEN 'clustered' ELSE 'noise' END AS part, count(*) AS n,
              min(id) AS first_id, max(id) AS last_id FROM lab GROUP BY 1""",
)
def noise_split(spark, sf):
    lab = dbscan_labels(spark, sf)
    parts = lab.where("cluster >= 0").withColumn("part", F.lit("clustered")).unionByName(
        lab.where("cluster < 0").withColumn("part", F.lit("noise"))
    )
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
