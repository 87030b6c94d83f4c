"""Projections, filters, aggregates, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectile.functions import text as tx
from vectile.operators import profile as pf
from vectile.plans.registry import query, table
from vectile.session import spread

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r6(c, name):
    return F.round(c, 6).alias(name)


# -- projections ---------------------------------------------------------------------------------


@query(
    "project_rename",
    "SELECT p_partkey AS id, p_name AS text, p_size AS labels FROM part",
)
def project_rename(spark, sf):
    return (
        table(spark, sf, "part")
        .select("p_partkey", "p_name", "p_size")
        .withColumnsRenamed({"p_partkey": "id", "p_name": "text", "p_size": "labels"})
    )


@query(
    "project_cast",
    """SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels""",
)
def project_cast(spark, sf):
    df = table(spark, sf, "labels")
    return pf.cast_labels(pf.cast_labels(df, ["quality"], "classification"), ["toxic"], "regression")


@query(
    "project_pack_labels",
    """SELECT d.doc_id, d.text, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS labels
       FROM documents d JOIN labels USING (doc_id)""",
)
def project_pack_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    packed = table(spark, sf, "labels").select("doc_id", F.array("quality", "toxic").alias("labels"))
    return pf.attach(docs, packed, "doc_id").withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query(
    "project_wide_tasks",
    "SELECT d.doc_id, d.text AS smiles, quality, toxic FROM documents d JOIN labels USING (doc_id)",
)
def project_wide_tasks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("smiles"))
    return pf.attach(docs, table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query(
    "project_unpack_xy",
    """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label
       FROM embeddings""",
)
def project_unpack_xy(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", v[0].cast("double").alias("x"), v[1].cast("double").alias("y"), "label"
    )


@query(
    "select_numeric",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
       FROM lineitem""",
)
def select_numeric(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(*pf.numeric_columns(df))


@query(
    "drop_constant_columns",
    "SELECT p_partkey, p_size, p_retailprice FROM part",
)
def drop_constant_columns(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1.0).alias("batch"))
    return pf.drop_constant_columns(df, ["p_size", "p_retailprice", "batch"])


@query(
    "minmax_scale",
    """WITH m AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) e0, max(l_extendedprice) e1
                  FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_quantity - q0) / (q1 - q0), 6) AS l_quantity,
              round((l_extendedprice - e0) / (e1 - e0), 6) AS l_extendedprice, CAST(0 AS DOUBLE) AS constant
       FROM lineitem, m""",
)
def minmax_scale(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(7).alias("constant")
    )
    cols = ["l_quantity", "l_extendedprice", "constant"]
    return pf.minmax_scale(df, cols).withColumns({c: F.round(c, 6) for c in cols})


@query(
    "derive_counts",
    """WITH w AS (SELECT doc_id,
                    string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), ' ') AS w FROM documents)
       SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words,
              CAST(len(list_filter(w, lambda x: length(x) > 3)) AS INTEGER) AS n_long_words FROM w""",
)
def derive_counts(spark, sf):
    w = F.col("w")
    return (
        table(spark, sf, "documents")
        .select("doc_id", tx.words(F.col("text")).alias("w"))
        .select(
            "doc_id",
            F.size(w).alias("n_words"),
            F.size(F.filter(w, lambda x: F.length(x) > 3)).alias("n_long_words"),
        )
    )


@query(
    "canonical_key",
    """SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS canon_key FROM documents""",
)
def canonical_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.canonical_key(F.col("text")).alias("canon_key"))


@query(
    "largest_fragment",
    """WITH p AS (SELECT doc_id, trim(unnest(string_split(text, '.'))) AS s FROM documents)
       SELECT doc_id, s AS fragment, CAST(length(s) AS INTEGER) AS n FROM p WHERE length(s) > 0
       QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, s DESC) = 1""",
)
def largest_fragment(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", tx.largest_fragment(F.col("text")).alias("fragment"))
        .dropna(subset=["fragment"])
        .withColumn("n", F.length("fragment"))
    )


@query(
    "string_pieces",
    """SELECT p_partkey, string_split(p_name, ' ')[2] AS second_word, replace(p_name, ' ', '_') AS slug,
              upper(p_type) AS upper_type, right(p_brand, 7) AS tail FROM part""",
)
def string_pieces(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("second_word"),
        F.regexp_replace("p_name", " ", "_").alias("slug"),
        F.upper("p_type").alias("upper_type"),
        F.right("p_brand", F.lit(7)).alias("tail"),
    )


@query(
    "word_position",
    """SELECT doc_id, CAST(list_position(string_split(text, ' '), 'the') - 1 AS BIGINT) AS position
       FROM documents WHERE list_contains(string_split(text, ' '), 'the')""",
)
def word_position(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", tx.word_position(F.col("text"), "the").cast("bigint").alias("position"))
        .where(F.col("position").isNotNull())
    )


@query(
    "metric_prefix_merge",
    """WITH m AS (SELECT avg(CAST(quality = toxic AS INTEGER)) AS acc, count(*) AS n FROM labels)
       SELECT 'ACC_acc' AS metric, round(acc, 6) AS value FROM m
       UNION ALL SELECT 'ACC_n', n FROM m UNION ALL SELECT 'AVS_acc', round(acc, 6) FROM m
       UNION ALL SELECT 'AVS_n', n FROM m""",
)
def metric_prefix_merge(spark, sf):
    m = table(spark, sf, "labels").agg(
        F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("acc"), F.count(F.lit(1)).alias("n")
    )
    metrics = {"acc": F.round("acc", 6), "n": F.col("n")}
    merged = F.map_concat(pf.prefix_metrics(metrics, "ACC_"), pf.prefix_metrics(metrics, "AVS_"))
    return m.select(F.explode(merged).alias("metric", "value"))


# -- filters -------------------------------------------------------------------------------------


@query(
    "filter_valid",
    r"""SELECT doc_id, text FROM documents
       WHERE text IS NOT NULL AND length(trim(text)) > 0
         AND length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', ''))
         AND length(text) - length(replace(text, '[', '')) = length(text) - length(replace(text, ']', ''))
         AND NOT regexp_matches(text, '[\x00-\x08\x0E-\x1F\x7F]')""",
)
def filter_valid(spark, sf):
    return table(spark, sf, "documents").where(tx.is_valid_text(F.col("text"))).select("doc_id", "text")


@query(
    "filter_outlier",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 400000""",
)
def filter_outlier(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_totalprice") <= 400000).select("o_orderkey", "o_totalprice")


@query(
    "filter_by_size",
    """SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0)) = 32""",
)
def filter_by_size(spark, sf):
    return (
        table(spark, sf, "embeddings")
        .where(F.size(F.filter("embedding", lambda x: x > 0)) == 32)
        .select("vec_id", "label")
    )


@query(
    "limit_ordered",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20",
)
def limit_ordered(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


@query(
    "null_counts",
    """SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS n_null, count(*) AS n_rows FROM j
       UNION ALL SELECT 'text', count(*) - count(text), count(*) FROM j
       UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM j
       UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM j""".replace(
        "FROM j", "FROM (SELECT d.doc_id, d.text, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) j"
    ),
)
def null_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pf.null_counts(pf.attach(docs, table(spark, sf, "labels"), "doc_id", "left"))


# -- profiles ------------------------------------------------------------------------------------


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return pf.value_counts(table(spark, sf, "events"), "event_type")


@query(
    "group_means",
    """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity,
              round(avg(l_extendedprice), 6) AS mean_l_extendedprice, round(avg(l_discount), 6) AS mean_l_discount,
              round(avg(l_tax), 6) AS mean_l_tax FROM lineitem GROUP BY l_returnflag""",
)
def group_means(spark, sf):
    out = pf.group_means(table(spark, sf, "lineitem"), "l_returnflag", MEASURES)
    return out.withColumns({f"mean_{c}": F.round(f"mean_{c}", 6) for c in MEASURES})


@query(
    "describe_exact",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
            min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
            round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem"""
        for c in MEASURES
    ),
)
def describe_exact(spark, sf):
    out = pf.describe_exact(table(spark, sf, "lineitem"), MEASURES)
    return out.withColumns({c: F.round(c, 6) for c in ["mean", "std", "p25", "p50", "p75"]})


@query(
    "histogram_10",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin,
            count(*) AS n FROM lineitem, (SELECT min({c}) lo, max({c}) hi FROM lineitem) GROUP BY ALL"""
        for c in MEASURES
    ),
)
def histogram_10(spark, sf):
    return pf.histogram(table(spark, sf, "lineitem"), MEASURES)


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM documents"
        for c in ["text", "lang", "source", "n_chars"]
    ),
)
def distinct_counts(spark, sf):
    return pf.distinct_counts(table(spark, sf, "documents"), ["text", "lang", "source", "n_chars"])


@query(
    "duplicate_report",
    """WITH g AS (SELECT md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) k, count(*) n
                  FROM documents GROUP BY 1)
       SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates FROM g""",
)
def duplicate_report(spark, sf):
    docs = table(spark, sf, "documents").select(tx.canonical_key(F.col("text")).alias("canon_key"))
    return pf.duplicate_report(docs, "canon_key")


@query(
    "dedupe_keep_first",
    """SELECT doc_id, text, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS canon_key
       FROM documents QUALIFY row_number() OVER (PARTITION BY canon_key ORDER BY doc_id) = 1""",
)
def dedupe_keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", tx.canonical_key(F.col("text")).alias("canon_key"))
    return pf.dedupe_keep_first(docs, "canon_key", "doc_id")


@query(
    "score_mean_std",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
       FROM events GROUP BY event_type""",
)
def score_mean_std(spark, sf):
    out = pf.score_mean_std(table(spark, sf, "events"), "event_type", "value")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


GRID_SQL = """e AS (SELECT CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, label FROM embeddings),
   b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM e),
   g AS (SELECT CAST(least(floor((x - x0) / (x1 - x0) * 400), 399) AS INTEGER) AS gx,
                CAST(least(floor((y - y0) / (y1 - y0) * 400), 399) AS INTEGER) AS gy, label, count(*) AS n
         FROM e, b GROUP BY ALL)"""


@query("grid_count_cat", f"WITH {GRID_SQL} SELECT gx, gy, label, n FROM g")
def grid_count_cat(spark, sf):
    return pf.grid_count(project_unpack_xy(spark, sf), "x", "y", "label")


@query(
    "grid_equalized",
    f"""WITH {GRID_SQL}, c AS (SELECT gx, gy, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY gx, gy)
        SELECT gx, gy, n, round(cume_dist() OVER (ORDER BY n), 6) AS shade FROM c""",
)
def grid_equalized(spark, sf):
    return pf.equalize(grid_count_cat(spark, sf)).withColumn("shade", F.round("shade", 6))


# -- codes and keyed joins -----------------------------------------------------------------------


@query(
    "factorize",
    """WITH f AS (SELECT p_type, min(p_partkey) k FROM part GROUP BY p_type)
       SELECT p_type, row_number() OVER (ORDER BY k) - 1 AS code FROM f""",
)
def factorize(spark, sf):
    return pf.factorize(table(spark, sf, "part"), "p_type", "p_partkey")


@query(
    "category_codes",
    """SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)""",
)
def category_codes(spark, sf):
    return pf.category_codes(table(spark, sf, "part"), "p_brand")


@query(
    "attach_labels",
    "SELECT d.doc_id, d.lang, quality, toxic FROM documents d JOIN labels USING (doc_id)",
)
def attach_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return pf.attach(docs, table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


# -- text ----------------------------------------------------------------------------------------

N_BITS = 1 << 18

WORDS_SQL = """w AS (SELECT doc_id,
      string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), ' ') AS w FROM documents),
   t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM w)"""
GRAMS_SQL = f"""{WORDS_SQL},
   l AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
   g AS (SELECT doc_id, a AS gram FROM l UNION ALL SELECT doc_id, a || ' ' || b FROM l WHERE b IS NOT NULL
         UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM l WHERE c IS NOT NULL)"""
HASH_SQL = "CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT)"
BITS_SQL = f"""{GRAMS_SQL},
   bits AS (SELECT DISTINCT doc_id, CAST({HASH_SQL} % {N_BITS} AS INTEGER) AS bit FROM g)"""


@query(
    "fingerprint",
    f"""WITH {BITS_SQL} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_on, CAST(sum(bit) AS BIGINT) AS bit_sum,
               min(bit) AS first_bit, max(bit) AS last_bit FROM bits GROUP BY doc_id""",
)
def fingerprint(spark, sf):
    bits = F.col("bits")
    return tx.fingerprint(spread(table(spark, sf, "documents")), "doc_id", "text", n_bits=N_BITS).select(
        "doc_id",
        "n_on",
        F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum"),
        F.element_at(bits, 1).alias("first_bit"),
        F.element_at(bits, -1).alias("last_bit"),
    )


@query(
    "fingerprint_provenance",
    f"""WITH {GRAMS_SQL}, d AS (SELECT DISTINCT doc_id, gram FROM g)
        SELECT doc_id, CAST({HASH_SQL} % {N_BITS} AS INTEGER) AS bit, count(*) AS n_grams, min(gram) AS first_gram
        FROM d GROUP BY ALL""",
)
def fingerprint_provenance(spark, sf):
    return tx.fingerprint_provenance(spread(table(spark, sf, "documents")), "doc_id", "text", n_bits=N_BITS, summed=True)


@query(
    "fingerprint_dense",
    f"""WITH {GRAMS_SQL}, b AS (SELECT DISTINCT doc_id, {HASH_SQL} % 2048 AS bit FROM g)
        SELECT doc_id, 2048 AS width, CAST(count(*) AS DOUBLE) AS total,
               CAST(sum(bit) AS DOUBLE) AS weighted FROM b GROUP BY doc_id""",
)
def fingerprint_dense(spark, sf):
    bits = tx.fingerprint(spread(table(spark, sf, "documents")), "doc_id", "text", n_bits=2048)
    dense = bits.select("doc_id", tx.fingerprint_dense(F.col("bits"), 2048).alias("v"))
    zero = F.lit(0.0)
    return dense.select(
        "doc_id",
        F.size("v").alias("width"),
        F.aggregate("v", zero, lambda a, x: a + x).alias("total"),
        F.aggregate(F.transform("v", lambda x, i: x * i), zero, lambda a, x: a + x).alias("weighted"),
    )


@query(
    "embed_hashing",
    f"""WITH {WORDS_SQL}, g AS (SELECT doc_id, a AS gram FROM t),
        c AS (SELECT doc_id, CAST({HASH_SQL} % 64 AS INTEGER) AS idx,
                     sum(CASE WHEN ({HASH_SQL} // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM g GROUP BY ALL),
        n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY doc_id)
        SELECT doc_id, idx, CASE WHEN norm > 0 THEN round(v / norm, 6) END AS value FROM c JOIN n USING (doc_id)""",
)
def embed_hashing(spark, sf):
    return tx.embed_hashing(spread(table(spark, sf, "documents")), "doc_id", "text").withColumn("value", F.round("value", 6))


@query(
    "tokenize_truncate",
    f"""WITH {WORDS_SQL}
        SELECT doc_id, CAST(i AS INTEGER) AS position, a AS token, CAST(i // 512 AS INTEGER) AS window,
               i < 512 AS in_limit FROM t""",
)
def tokenize_truncate(spark, sf):
    return tx.tokens(spread(table(spark, sf, "documents")), "doc_id", "text")
