"""Cluster scores, classifier scores, pooling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vectile.operators import class_scores as cs
from vectile.operators import cluster as cl
from vectile.operators import cluster_scores as sc
from vectile.operators import graph as gr
from vectile.operators import pairs as pr
from vectile.operators import pooling as po
from vectile.plans.registry import query, table
from vectile.plans.source_queries import ATOM_SQL, atoms_of
from vectile.plans.vector_queries import E_SQL, RADIUS, distinct_vectors

WIDTH = 64

# -- k-means from given centres ------------------------------------------------------------------


def label_centres(spark, sf):
    """One mean vector per label, a fixed handful."""
    rows = po.mean_pool(table(spark, sf, "embeddings"), "label", "embedding").orderBy("label").collect()
    return [list(r["pooled"]) for r in rows]


LONG_SQL = f"""{E_SQL}, x AS (SELECT id, label, unnest(range(1, {WIDTH + 1})) AS pos, unnest(v) AS x FROM e)"""
CENTRES_SQL = """c0 AS (SELECT label - 0 AS k, pos, avg(x) AS c FROM x GROUP BY ALL)"""


def step_sql(n):
    return f"""d{n} AS (SELECT x.id, c.k, sum((x.x - c.c) * (x.x - c.c)) AS d2 FROM x JOIN c{n} c ON c.pos = x.pos GROUP BY ALL),
       a{n} AS (SELECT id, k, d2 FROM d{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, k) = 1),
       c{n + 1} AS (SELECT a.k, x.pos, avg(x.x) AS c FROM a{n} a JOIN x ON x.id = a.id GROUP BY ALL)"""


ASSIGN_SQL = f"{LONG_SQL}, {CENTRES_SQL}, {step_sql(0)}"


def assigned(spark, sf):
    """(vec_id, embedding, label, cluster): nearest label mean."""
    emb = table(spark, sf, "embeddings")
    near = cl.kmeans_assign(emb, "vec_id", "embedding", label_centres(spark, sf))
    return emb.join(near.select("vec_id", "cluster"), "vec_id")


@query("kmeans_assign", f"WITH {ASSIGN_SQL} SELECT id AS vec_id, CAST(k AS INTEGER) AS cluster, round(d2, 6) AS d2 FROM a0")
def kmeans_assign(spark, sf):
    near = cl.kmeans_assign(table(spark, sf, "embeddings"), "vec_id", "embedding", label_centres(spark, sf))
    return near.withColumn("d2", F.round("d2", 6))


@query(
    "kmeans_lloyd",
    f"""WITH {ASSIGN_SQL}, {step_sql(1)}, {step_sql(2)}
        SELECT CAST(k AS INTEGER) AS cluster, CAST(pos - 1 AS INTEGER) AS pos, round(c, 6) AS value FROM c3""",
)
def kmeans_lloyd(spark, sf):
    centres = cl.kmeans_lloyd(table(spark, sf, "embeddings"), "embedding", label_centres(spark, sf), iterations=3)
    frame = spark.createDataFrame(list(enumerate(centres)), "cluster int, c array<double>")
    return frame.select("cluster", F.posexplode("c").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("inertia", f"WITH {ASSIGN_SQL} SELECT count(*) AS n, round(sum(d2), 6) AS inertia FROM a0")
def inertia(spark, sf):
    near = cl.kmeans_assign(table(spark, sf, "embeddings"), "vec_id", "embedding", label_centres(spark, sf))
    return near.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("inertia"))


# -- scores against labels -----------------------------------------------------------------------

LAB_SQL = f"{ASSIGN_SQL}, lab AS (SELECT e.id, e.label, a0.k AS cluster FROM e JOIN a0 USING (id))"
CELLS_OF_LAB_SQL = """cell AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM lab GROUP BY ALL),
   ra AS (SELECT label, sum(n) AS a FROM cell GROUP BY label), cb AS (SELECT cluster, sum(n) AS b FROM cell GROUP BY cluster),
   t AS (SELECT sum(n) AS n FROM cell),
   mi AS (SELECT sum(cell.n / t.n * ln(t.n * cell.n / (a * b))) AS mi FROM cell JOIN ra USING (label) JOIN cb USING (cluster), t),
   ht AS (SELECT -sum(a / n * ln(a / n)) AS h FROM ra, t), hp AS (SELECT -sum(b / n * ln(b / n)) AS h FROM cb, t),
   s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cell) AS c2, (SELECT sum(a * (a - 1) / 2) FROM ra) AS a2,
                (SELECT sum(b * (b - 1) / 2) FROM cb) AS b2, (SELECT n * (n - 1) / 2 FROM t) AS n2),
   ari AS (SELECT (c2 - a2 * b2 / n2) / ((a2 + b2) / 2 - a2 * b2 / n2) AS ari FROM s)"""
CELL_SQL = f"{LAB_SQL}, {CELLS_OF_LAB_SQL}"


@query("contingency", f"WITH {LAB_SQL} SELECT label, CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM lab GROUP BY ALL")
def contingency(spark, sf):
    return sc.contingency(assigned(spark, sf), "label", "cluster")


@query("adjusted_rand", f"WITH {CELL_SQL} SELECT round(ari, 6) AS adjusted_rand FROM ari")
def adjusted_rand(spark, sf):
    return sc.label_scores(assigned(spark, sf), "label", "cluster").select(F.round("adjusted_rand", 6).alias("adjusted_rand"))


@query("mutual_info", f"WITH {CELL_SQL} SELECT round(mi, 6) AS mutual_info FROM mi")
def mutual_info(spark, sf):
    return sc.label_scores(assigned(spark, sf), "label", "cluster").select(F.round("mutual_info", 6).alias("mutual_info"))


@query("homogeneity", f"WITH {CELL_SQL} SELECT round(mi / h, 6) AS homogeneity FROM mi, ht")
def homogeneity(spark, sf):
    return sc.label_scores(assigned(spark, sf), "label", "cluster").select(F.round("homogeneity", 6).alias("homogeneity"))


@query("completeness", f"WITH {CELL_SQL} SELECT round(mi / h, 6) AS completeness FROM mi, hp")
def completeness(spark, sf):
    return sc.label_scores(assigned(spark, sf), "label", "cluster").select(F.round("completeness", 6).alias("completeness"))


@query(
    "compare_clusterings",
    f"WITH {CELL_SQL} SELECT round(ari, 6) AS ari_first, round(ari, 6) AS ari_second, true AS same FROM ari",
)
def compare_clusterings(spark, sf):
    rows = assigned(spark, sf).withColumn("renamed", F.col("cluster") * 10 + 3)  # same partition, other names
    out = sc.compare_clusterings(rows, "label", "cluster", "renamed")
    return out.withColumns({c: F.round(c, 6) for c in ("ari_first", "ari_second")})


# -- scores from vectors -------------------------------------------------------------------------

CENTROIDS_OF_LAB_SQL = """lx AS (SELECT lab.id, lab.cluster AS k, x.pos, x.x FROM lab JOIN x USING (id)),
   cc AS (SELECT k, pos, avg(x) AS c, count(*) AS n FROM lx GROUP BY ALL),
   g AS (SELECT pos, avg(x) AS c FROM lx GROUP BY pos),
   dist AS (SELECT lx.id, lx.k, sum((x - c) * (x - c)) AS d2 FROM lx JOIN cc ON cc.k = lx.k AND cc.pos = lx.pos GROUP BY ALL)"""
CENTROID_SQL = f"{LAB_SQL}, {CENTROIDS_OF_LAB_SQL}"


# what follows the centroids, a cluster's rows, or the distances of a row to the clusters
CH_SQL = """b AS (SELECT sum(cc.n * (cc.c - g.c) * (cc.c - g.c)) AS b FROM cc JOIN g USING (pos)),
        w AS (SELECT sum(d2) AS w, count(*) AS n, count(DISTINCT k) AS k FROM dist)
        SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w"""
DB_SQL = """s AS (SELECT k, avg(sqrt(d2)) AS s FROM dist GROUP BY k),
        m AS (SELECT a.k AS i, b.k AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM cc a JOIN cc b ON a.pos = b.pos AND a.k <> b.k GROUP BY ALL),
        r AS (SELECT m.i, max((s1.s + s2.s) / m.d) AS r FROM m JOIN s s1 ON s1.k = m.i JOIN s s2 ON s2.k = m.j GROUP BY m.i)
        SELECT round(avg(r), 6) AS davies_bouldin FROM r"""
SIL_AVG_SQL = "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"


@query("calinski_harabasz", f"WITH {CENTROID_SQL}, {CH_SQL}")
def calinski_harabasz(spark, sf):
    return sc.calinski_harabasz(assigned(spark, sf), "embedding", "cluster").select(
        F.round("calinski_harabasz", 6).alias("calinski_harabasz")
    )


@query("davies_bouldin", f"WITH {CENTROID_SQL}, {DB_SQL}")
def davies_bouldin(spark, sf):
    return sc.davies_bouldin(assigned(spark, sf), "embedding", "cluster").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


def sil_sql(distance):
    return f"{LAB_SQL}, {sil_of_lab_sql(distance)}"


def sil_of_lab_sql(distance):
    return f"""lv AS (SELECT lab.id, lab.cluster AS k, e.v FROM lab JOIN e USING (id)),
       sz AS (SELECT k, count(*) AS n FROM lv GROUP BY k),
       m AS (SELECT a.id, a.k, b.k AS other, sum({distance}) AS s FROM lv a JOIN lv b ON true GROUP BY ALL),
       ab AS (SELECT m.id, max(CASE WHEN m.k = other THEN s / nullif(n - 1, 0) END) AS a,
                     min(CASE WHEN m.k <> other THEN s / n END) AS b FROM m JOIN sz ON sz.k = other GROUP BY m.id)"""


SIL_SQL = sil_sql("list_distance(a.v, b.v)")


@query("silhouette_exact", f"WITH {SIL_SQL} {SIL_AVG_SQL}")
def silhouette_exact(spark, sf):
    return sc.silhouette(assigned(spark, sf), "vec_id", "embedding", "cluster").select(F.round("silhouette", 6).alias("silhouette"))


@query(
    "silhouette_sq",
    f"""WITH {sil_sql("list_distance(a.v, b.v) * list_distance(a.v, b.v)")}
        SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_sq FROM ab""",
)
def silhouette_sq(spark, sf):
    value = sc.silhouette_sq(assigned(spark, sf), "embedding", "cluster")
    return spark.createDataFrame([(round(value, 6),)], "silhouette_sq double")


@query(
    "quality_partition_index",
    f"""WITH {LAB_SQL}, p AS (SELECT la.cluster = lb.cluster AS same, list_distance(a.v, b.v) AS d
            FROM e a JOIN e b ON a.id < b.id JOIN lab la ON la.id = a.id JOIN lab lb ON lb.id = b.id)
        SELECT round(min(d) FILTER (same) / max(d) FILTER (NOT same), 6) AS quality_partition_index FROM p""",
)
def quality_partition_index(spark, sf):
    return sc.quality_partition_index(assigned(spark, sf), "vec_id", "embedding", "cluster").select(
        F.round("quality_partition_index", 6).alias("quality_partition_index")
    )


@query(
    "modularity",
    f"""WITH e AS (SELECT max(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS v, arg_max(label, vec_id) AS label
            FROM embeddings GROUP BY embedding), w AS (SELECT a.id AS i, b.id AS j, a.label AS ci, b.label AS cj,
              exp(-list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS w
            FROM e a JOIN e b ON a.id < b.id WHERE list_distance(a.v, b.v) <= {RADIUS}),
        t AS (SELECT sum(w) AS w FROM w),
        dg AS (SELECT c, sum(w) AS deg FROM (SELECT ci AS c, w FROM w UNION ALL SELECT cj, w FROM w) GROUP BY c),
        ins AS (SELECT ci AS c, sum(w) AS w FROM w WHERE ci = cj GROUP BY ci)
        SELECT round(sum(coalesce(ins.w, 0) / t.w - (deg / (2 * t.w)) * (deg / (2 * t.w))), 6) AS modularity
        FROM dg LEFT JOIN ins USING (c), t""",
)
def modularity(spark, sf):
    emb = table(spark, sf, "embeddings")
    close = pr.similarity_join(distinct_vectors(spark, sf), "id", "embedding", RADIUS)
    edges = close.select("i", "j", F.exp(-F.col("d") * F.col("d")).alias("w"))
    labels = emb.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return gr.modularity(edges, labels).select(F.round("modularity", 6).alias("modularity"))


# -- classifier scores ---------------------------------------------------------------------------

P_SQL = """p AS (SELECT doc_id, quality, toxic, n_chars, CAST(n_chars > 500 AS INTEGER) AS pred,
   n_chars / (n_chars + 400.0::DOUBLE) AS prob FROM documents JOIN labels USING (doc_id))"""


def predictions(spark, sf):
    """(doc_id, quality, toxic, n_chars, pred, prob): length as a plain score of quality."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "quality", "toxic", "n_chars", (F.col("n_chars") > 500).cast("int").alias("pred"),
        (F.col("n_chars") / (F.col("n_chars") + 400.0)).alias("prob"),
    )


CONF_SQL = f"""{P_SQL}, c AS (SELECT count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 0 AND pred = 1) AS fp,
   count(*) FILTER (quality = 0 AND pred = 0) AS tn, count(*) FILTER (quality = 1 AND pred = 0) AS fn FROM p)"""
MCC_SQL = "(tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"


@query("confusion_binary", f"WITH {CONF_SQL} SELECT tn, fp, fn, tp FROM c")
def confusion_binary(spark, sf):
    return cs.confusion(predictions(spark, sf), "quality", "pred")


@query(
    "classification_binary",
    f"""WITH {CONF_SQL} SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
          round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
          round({MCC_SQL}, 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auroc FROM c""",
)
def classification_binary(spark, sf):
    out = cs.binary_scores(predictions(spark, sf), "quality", "pred")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy", "mcc", "auroc")})


LANG_SQL = """g AS (SELECT lang AS t, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de'
      WHEN contains(text, ' les ') THEN 'fr' ELSE 'es' END AS p FROM documents),
   k AS (SELECT t AS cls FROM g UNION SELECT p FROM g),
   s AS (SELECT cls, (SELECT count(*) FROM g WHERE t = cls)::DOUBLE AS a, (SELECT count(*) FROM g WHERE p = cls)::DOUBLE AS b,
                (SELECT count(*) FROM g WHERE p = cls AND t = cls)::DOUBLE AS h FROM k),
   n AS (SELECT count(*)::DOUBLE AS n FROM g)"""


def language_guess(spark, sf):
    has = lambda w: F.col("text").contains(f" {w} ")
    return table(spark, sf, "documents").select(
        "lang", F.when(has("the"), "en").when(has("der"), "de").when(has("les"), "fr").otherwise("es").alias("guess")
    )


@query(
    "classification_weighted",
    f"""WITH {LANG_SQL} SELECT round(sum(a * coalesce(h / nullif(b, 0), 0)) / max(n), 6) AS precision,
          round(sum(a * coalesce(h / nullif(a, 0), 0)) / max(n), 6) AS recall,
          round(sum(a * coalesce(2 * h / nullif(a + b, 0), 0)) / max(n), 6) AS f1, round(sum(h) / max(n), 6) AS accuracy
        FROM s, n""",
)
def classification_weighted(spark, sf):
    out = cs.weighted_scores(language_guess(spark, sf), "lang", "guess")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "mcc_multiclass",
    f"""WITH {LANG_SQL} SELECT round((sum(h) * max(n) - sum(a * b)) /
          sqrt((max(n) * max(n) - sum(b * b)) * (max(n) * max(n) - sum(a * a))), 6) AS mcc FROM s, n""",
)
def mcc_multiclass(spark, sf):
    return cs.weighted_scores(language_guess(spark, sf), "lang", "guess").select(F.round("mcc", 6).alias("mcc"))


AUC_SQL = """(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y)))"""
RANK_SQL = "rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part2}) - 1) / 2.0::DOUBLE AS rk"


@query(
    "roc_auc",
    f"""WITH {P_SQL}, r AS (SELECT quality AS y, n_chars AS score, rank() OVER (ORDER BY n_chars) +
            (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM p)
        SELECT round({AUC_SQL}, 6) AS auroc FROM r""",
)
def roc_auc(spark, sf):
    return cs.roc_auc(predictions(spark, sf), "quality", "n_chars").select(F.round("auroc", 6).alias("auroc"))


AP_SQL = """s AS (SELECT n_chars, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS m FROM p GROUP BY n_chars),
   u AS (SELECT p, sum(p) OVER o AS rp, sum(m) OVER o AS rm, sum(p) OVER () AS np FROM s WINDOW o AS (ORDER BY n_chars DESC))"""


@query("average_precision", f"WITH {P_SQL}, {AP_SQL} SELECT round(sum(p / np * rp / rm), 6) AS average_precision FROM u")
def average_precision(spark, sf):
    return cs.average_precision(predictions(spark, sf), "quality", "n_chars").select(
        F.round("average_precision", 6).alias("average_precision")
    )


@query("log_loss", f"WITH {P_SQL} SELECT round(-avg(CASE WHEN quality = 1 THEN ln(prob) ELSE ln(1 - prob) END), 6) AS log_loss FROM p")
def log_loss(spark, sf):
    return cs.log_loss(predictions(spark, sf), "quality", "prob").select(F.round("log_loss", 6).alias("log_loss"))


@query(
    "classifier_report",
    f"""WITH {CONF_SQL}, {AP_SQL}, r AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) +
            (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM p)
        SELECT 'tp' AS metric, tp::DOUBLE AS value FROM c UNION ALL SELECT 'tn', tn FROM c UNION ALL SELECT 'fp', fp FROM c
        UNION ALL SELECT 'fn', fn FROM c UNION ALL SELECT 'accuracy', round((tp + tn) / (tp + tn + fp + fn), 6) FROM c
        UNION ALL SELECT 'mcc', round({MCC_SQL}, 6) FROM c UNION ALL SELECT 'auroc', round({AUC_SQL}, 6) FROM r
        UNION ALL SELECT 'auprc', round(sum(p / np * rp / rm), 6) FROM u
        UNION ALL SELECT 'eval_loss', round(-avg(CASE WHEN quality = 1 THEN ln(prob) ELSE ln(1 - prob) END), 6) FROM p""",
)
def classifier_report(spark, sf):
    return cs.classifier_report(predictions(spark, sf), "quality", "pred", "prob").withColumn("value", F.round("value", 6))


@query("wrong_predictions", f"WITH {P_SQL} SELECT doc_id, quality, pred FROM p WHERE quality <> pred")
def wrong_predictions(spark, sf):
    return cs.wrong_predictions(predictions(spark, sf).select("doc_id", "quality", "pred"), "quality", "pred")


@query(
    "multitask_scores",
    f"""WITH {P_SQL}, l AS (SELECT 'quality' AS task, quality AS y, pred, n_chars FROM p
             UNION ALL SELECT 'toxic', toxic, pred, n_chars FROM p),
        r AS (SELECT task, y, pred, rank() OVER (PARTITION BY task ORDER BY n_chars) +
              (count(*) OVER (PARTITION BY task, n_chars) - 1) / 2.0::DOUBLE AS rk FROM l)
        SELECT task, round({AUC_SQL}, 6) AS auroc, round(avg(CAST(y = pred AS INTEGER)), 6) AS accuracy FROM r GROUP BY task""",
)
def multitask_scores(spark, sf):
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("y"), "pred", "n_chars") for t in ("quality", "toxic")])
    long = predictions(spark, sf).select(F.inline(tasks))
    out = cs.multitask_scores(long, "task", "y", "pred", "n_chars")
    return out.withColumns({c: F.round(c, 6) for c in ("auroc", "accuracy")})


# -- pooling -------------------------------------------------------------------------------------


def _long(df):
    return df.select("label", F.posexplode("pooled").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("mean_pool", f"WITH {LONG_SQL} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM x GROUP BY ALL")
def mean_pool(spark, sf):
    return _long(po.mean_pool(table(spark, sf, "embeddings"), "label", "embedding"))


@query(
    "mean_pool_masked",
    f"""WITH {LONG_SQL}, m AS (SELECT id, CASE WHEN v[1] > 0 THEN 1.0::DOUBLE ELSE 0 END AS w FROM e)
        SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(x * w) / greatest(sum(w), 1e-9), 6) AS value
        FROM x JOIN m USING (id) GROUP BY label, pos""",
)
def mean_pool_masked(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("w", (F.col("embedding")[0] > 0).cast("double"))
    return _long(po.mean_pool(rows, "label", "embedding", "w"))


@query(
    "layer_sum_pool",
    f"""WITH {LONG_SQL}, s AS (SELECT id, label, (pos - 1) % 16 AS pos, sum(x) AS x FROM x WHERE pos > 32 GROUP BY ALL)
        SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM s GROUP BY label, pos""",
)
def layer_sum_pool(spark, sf):
    """Each vector read as four layers of 16; the last two are summed, then averaged per label."""
    e = F.col("embedding").cast("array<double>")
    layers = F.array(*[F.slice(e, 16 * k + 1, 16) for k in range(4)])
    rows = table(spark, sf, "embeddings").select("label", po.layer_sum(layers, [3, 4]).alias("v"))
    return _long(po.mean_pool(rows, "label", "v"))


COULOMB_SQL = f"""{ATOM_SQL}, m AS (SELECT a.vec_id, a.k AS i, b.k AS j, CASE WHEN a.k = b.k THEN 0.5 * pow(a.z, 2.4::DOUBLE)
     ELSE a.z * b.z / sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2)) END AS v
   FROM atoms a JOIN atoms b ON a.vec_id = b.vec_id)"""


@query("coulomb_entries", f"WITH {COULOMB_SQL} SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 5) AS v FROM m")
def coulomb_entries(spark, sf):
    m = atoms_of(table(spark, sf, "embeddings")).select("vec_id", po.coulomb_matrix(F.col("atoms")).alias("m"))
    rows = m.select("vec_id", F.posexplode("m").alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", "v")).withColumn("v", F.round("v", 5))


@query(
    "coulomb_eigenvalues",
    f"""WITH {COULOMB_SQL} SELECT vec_id, 20 AS width, round(sum(v) FILTER (i = j), 4) AS trace, round(sum(v * v), 3) AS sq_norm
        FROM m GROUP BY vec_id""",
)
def coulomb_eigenvalues(spark, sf):
    """Padded eigenvalues, reported through two invariants: their sum and their sum of squares."""
    m = atoms_of(table(spark, sf, "embeddings")).select("vec_id", po.coulomb_matrix(F.col("atoms")).alias("m"))
    e = po.sorted_eigenvalues(m, "vec_id", "m").select("vec_id", po.pad(F.col("values"), 20).alias("e"))
    add = lambda a, x: a + x
    return e.select(
        "vec_id", F.size("e").alias("width"), F.round(F.aggregate("e", F.lit(0.0), add), 4).alias("trace"),
        F.round(F.aggregate(F.transform("e", lambda x: x * x), F.lit(0.0), add), 3).alias("sq_norm"),
    )
