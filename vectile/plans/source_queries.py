"""Sources and sinks. Files are written from the given tables into the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectile.functions import text as tx
from vectile.plans.registry import query, table
from vectile.plans.table_queries import N_BITS, WORDS_SQL, GRAMS_SQL, HASH_SQL
from vectile.session import scratch_path, spread
from vectile.sources import readers, sinks

PART_SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _part_csv(spark, sf):
    return sinks.write_csv(table(spark, sf, "part"), scratch_path(spark, "part-csv"))


@query("scan_rename", "SELECT p_partkey AS id, p_name AS text, p_size AS labels FROM part")
def scan_rename(spark, sf):
    return readers.read_csv(
        spark, _part_csv(spark, sf), PART_SCHEMA, columns=["p_partkey", "p_name", "p_size"],
        names=["id", "text", "labels"],
    )


@query("scan_pruned", "SELECT p_name FROM part")
def scan_pruned(spark, sf):
    return readers.read_csv(spark, _part_csv(spark, sf), PART_SCHEMA, columns=["p_name"])


@query(
    "scan_archive_tsv",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part",
)
def scan_archive_tsv(spark, sf):
    path, columns = scratch_path(spark, "archive"), ["p_partkey", "p_name", "p_brand"]
    sinks.write_archives(table(spark, sf, "part"), path, columns)
    return readers.read_archive(spark, path, columns)


ATOM_SQL = """a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(0, 16)) AS k FROM embeddings),
   atoms AS (SELECT vec_id, k, 1 + floor(abs(e[4 * k + 1]) * 40) AS z,
                    e[4 * k + 2] * 10 AS px, e[4 * k + 3] * 10 AS py, e[4 * k + 4] * 10 AS pz FROM a)"""


def atoms_of(df):
    """(vec_id, label, atoms): each vector read as 16 atoms (charge, x, y, z)."""
    e = F.col("e")
    return df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).select(
        "vec_id",
        "label",
        F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda k: F.struct(
                (F.floor(F.abs(F.get(e, k * 4)) * 40) + 1).cast("double").alias("z"),
                (F.get(e, k * 4 + 1) * 10).alias("px"),
                (F.get(e, k * 4 + 2) * 10).alias("py"),
                (F.get(e, k * 4 + 3) * 10).alias("pz"),
            ),
        ).alias("atoms"),
    )


def _write_molecules(spark, sf):
    """One file per vector in the molecule layout, numbers with the ``*^`` exponent form."""
    num = lambda c: F.replace(F.format_string("%.15e", c), F.lit("e"), F.lit("*^"))
    atom = lambda x: F.concat_ws(
        "\t", F.concat(F.lit("Z"), x["z"].cast("int").cast("string")), num(x["px"]), num(x["py"]), num(x["pz"]), F.lit("0.0")
    )
    rows = atoms_of(table(spark, sf, "embeddings")).select(
        "vec_id",
        F.concat_ws(
            "\n",
            F.size("atoms").cast("string"),
            F.concat_ws("\t", F.lit("gdb"), F.col("vec_id").cast("string"), F.col("label").cast("string"), F.lit("2.5")),
            F.concat_ws("\n", F.transform("atoms", atom)),
            F.lit("100.0\t200.0"),
            F.concat(F.lit("mol"), F.col("vec_id").cast("string"), F.lit("\tmolB")),
            F.lit("InChI"),
        ).alias("value"),
    )
    path = scratch_path(spark, "molecules")
    spread(rows).write.partitionBy("vec_id").text(path)
    return path


@query(
    "scan_records_wholetext",
    f"""WITH {ATOM_SQL}, s AS (SELECT vec_id, count(*) AS n, round(sum(px), 6) AS sx, round(sum(py), 6) AS sy,
                 round(sum(pz), 6) AS sz FROM atoms GROUP BY vec_id)
        SELECT 'mol' || vec_id AS smiles, CAST(n AS INTEGER) AS n_atoms, sx, sy, sz, CAST(label AS DOUBLE) AS prop_0
        FROM s JOIN embeddings USING (vec_id)""",
)
def scan_records_wholetext(spark, sf):
    total = lambda c: F.round(F.aggregate(F.col("atoms")[c], F.lit(0.0), lambda a, x: a + x), 6)
    return readers.read_records(spark, _write_molecules(spark, sf)).select(
        "smiles", "n_atoms", total("x").alias("sx"), total("y").alias("sy"), total("z").alias("sz"),
        F.col("props")[0].alias("prop_0"),
    )


@query("scan_file_count", "SELECT count(*) AS n_files FROM embeddings")
def scan_file_count(spark, sf):
    # one file per record plus no side files: names starting with _ or . are not listed
    return readers.file_count(spark, _write_molecules(spark, sf))


@query(
    "csv_to_fingerprints",
    f"""WITH {WORDS_SQL.replace('documents', 'part').replace('doc_id', 'p_partkey').replace('text', 'p_name')},
        g AS (SELECT p_partkey, a AS gram FROM t UNION ALL
              SELECT p_partkey, gram FROM (SELECT p_partkey, a || ' ' || lead(a) OVER (PARTITION BY p_partkey ORDER BY i) AS gram FROM t)
              WHERE gram IS NOT NULL)
        SELECT p_partkey AS id, CAST(count(DISTINCT {HASH_SQL} % 2048) AS INTEGER) AS n_on,
               CAST(sum(DISTINCT {HASH_SQL} % 2048) AS BIGINT) AS bit_sum FROM g GROUP BY p_partkey""",
)
def csv_to_fingerprints(spark, sf):
    rows = scan_rename(spark, sf)
    return tx.fingerprint(rows, "id", "text", radius=1, n_bits=2048).select(
        "id", "n_on", F.aggregate("bits", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum")
    )


@query("sink_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def sink_csv_roundtrip(spark, sf):
    return readers.read_csv(spark, _part_csv(spark, sf), PART_SCHEMA)


@query(
    "sink_vector_roundtrip",
    """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width,
              round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def sink_vector_roundtrip(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    path = sinks.write_vectors_csv(df, scratch_path(spark, "vectors"), "embedding")
    back = sinks.read_vectors_csv(spark, path, "vec_id long, embedding string, label int", "embedding", "array<float>")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", F.size("embedding").alias("width"), F.round(total, 6).alias("total"))


@query(
    "sink_by_split",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS p,
                  count(*) OVER () AS n FROM documents)
       SELECT doc_id, lang, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' WHEN p < floor(n * 0.9::DOUBLE) THEN 'valid'
              ELSE 'test' END AS split FROM r""",
)
def sink_by_split(spark, sf):
    from vectile.operators.sampling import split_fractions

    parts = split_fractions(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    path = sinks.write_parts(parts, scratch_path(spark, "by-split"), "split")
    return spark.read.schema("doc_id long, lang string, split string").csv(path, header=True)


@query(
    "sink_folds",
    """SELECT doc_id, CAST((row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':69'), doc_id) - 1) % 6 AS INTEGER)
              AS fold FROM documents""",
)
def sink_folds(spark, sf):
    from vectile.operators.sampling import deal_folds

    folds = deal_folds(table(spark, sf, "documents").select("doc_id"), "doc_id")
    path = sinks.write_parts(folds, scratch_path(spark, "folds"), "fold")
    return spark.read.schema("doc_id long, fold int").csv(path, header=True)


@query(
    "metric_log",
    """SELECT 'run-' || lang AS run_id, 'lang' AS param, lang AS param_value, 'mean_chars' AS metric,
              round(avg(n_chars), 6) AS value FROM documents GROUP BY lang""",
)
def metric_log(spark, sf):
    path = scratch_path(spark, "metric-log")
    means = (
        table(spark, sf, "documents")
        .groupBy("lang")
        .agg(F.round(F.avg("n_chars"), 6).alias("value"))
        .select(
            F.concat(F.lit("run-"), "lang").alias("run_id"), F.lit("lang").alias("param"),
            F.col("lang").alias("param_value"), F.lit("mean_chars").alias("metric"), "value",
        )
    )
    sinks.log_metrics(means.drop("run_id"), path, F.concat(F.lit("run-"), "param_value"))
    return spark.read.parquet(path).select("run_id", "param", "param_value", "metric", "value")


def family_rows(spark, sf):
    """(doc_id, text, labels, lang): the labelled texts, quality as the 0/1 label, language as the family."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("labels")), "doc_id")


FAMILY_SQL = """f AS (SELECT d.doc_id, d.text, lang, quality AS labels FROM documents d JOIN labels USING (doc_id))"""


@query(
    "load_family",
    f"""WITH {FAMILY_SQL} SELECT doc_id, text, labels FROM f WHERE labels = 1
        ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 50""",
)
def load_family(spark, sf):
    rows = family_rows(spark, sf).select("doc_id", "text", "labels")
    return readers.load_family(rows, "doc_id", sample_size=50, interacted_only=True)


@query(
    "load_multi_family",
    f"""WITH {FAMILY_SQL} SELECT doc_id, text, lang AS labels,
             CAST(list_position(['de', 'en', 'fr'], lang) - 1 AS INTEGER) AS labels_protein
        FROM f WHERE labels = 1 AND lang IN ('de', 'en', 'fr')
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) <= 20""",
)
def load_multi_family(spark, sf):
    return readers.load_multi_family(
        family_rows(spark, sf), "doc_id", "lang", ["fr", "en", "de"], sample_size=60, convert_labels=True
    )


@query(
    "load_unlabelled",
    r"""SELECT doc_id, text, 0 AS labels FROM documents
       WHERE text IS NOT NULL AND length(trim(text)) > 0
         AND length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', ''))
         AND length(text) - length(replace(text, '[', '')) = length(text) - length(replace(text, ']', ''))
         AND NOT regexp_matches(text, '[\x00-\x08\x0E-\x1F\x7F]')
       ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 200""",
)
def load_unlabelled(spark, sf):
    return readers.load_unlabelled(table(spark, sf, "documents"), "doc_id", "text", sample_size=200)


def _labelled(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text", "source")
    return docs.join(table(spark, root, "labels"), "doc_id")


CATALOG = {
    "doc_quality": readers.Dataset(
        _labelled, "classification", "random", ["quality", "toxic"], "doc_id", "text", "source", ["quality"]
    ),
    "doc_labels": readers.Dataset(
        _labelled, "classification", "scaffold", ["quality", "toxic"], "doc_id", "text", "source"
    ),
    "part_price": readers.Dataset(
        lambda spark, root: table(spark, root, "part"), "regression", "random", ["p_size", "p_retailprice"],
        "p_partkey", "p_name", "p_brand",
    ),
}


@query(
    "catalog_load",
    """WITH r AS (SELECT p_partkey, p_name, p_size, p_retailprice,
                  row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey) - 1 AS p,
                  count(*) OVER () AS n FROM part)
       SELECT p_partkey, p_name AS smiles, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
              CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' WHEN p < floor(n * 0.9::DOUBLE) THEN 'valid'
              ELSE 'test' END AS split FROM r""",
)
def catalog_load(spark, sf):
    return readers.load_dataset(spark, sf, CATALOG, "part_price", layout="wide")


@query(
    "gen_blobs",
    """WITH c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k, avg(embedding[1]) AS cx, avg(embedding[2]) AS cy
                  FROM embeddings GROUP BY label),
       m AS (SELECT count(*) AS n FROM c),
       o AS (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42:c'), 1, 8) AS BIGINT) % n AS blob,
                 (CAST('0x' || substr(md5(o_orderkey || ':42:0:u'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u0,
                 (CAST('0x' || substr(md5(o_orderkey || ':42:0:v'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS v0,
                 (CAST('0x' || substr(md5(o_orderkey || ':42:1:u'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u1,
                 (CAST('0x' || substr(md5(o_orderkey || ':42:1:v'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS v1
             FROM orders, m)
       SELECT o_orderkey, CAST(blob AS INTEGER) AS blob,
              round(cx + 0.1 * sqrt(-2 * ln(u0)) * cos(2 * pi() * v0), 5) AS x,
              round(cy + 0.1 * sqrt(-2 * ln(u1)) * cos(2 * pi() * v1), 5) AS y
       FROM o JOIN c ON c.k = o.blob""",
)
def gen_blobs(spark, sf):
    v = F.col("embedding")
    rows = (
        table(spark, sf, "embeddings").groupBy("label").agg(F.avg(v[0]).alias("cx"), F.avg(v[1]).alias("cy"))
        .orderBy("label").collect()  # one row per label
    )
    blobs = readers.gaussian_blobs(table(spark, sf, "orders"), "o_orderkey", [[r["cx"], r["cy"]] for r in rows])
    p = F.col("point")
    return blobs.select("o_orderkey", "blob", F.round(p[0], 5).alias("x"), F.round(p[1], 5).alias("y"))
