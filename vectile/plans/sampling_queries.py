"""Draws, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectile.operators import sampling as sp
from vectile.plans.registry import query, table

ORDER = "ORDER BY md5(CAST({id} AS VARCHAR) || ':{seed}'), {id}"


def rank_sql(tbl: str, id_: str, seed: int, cols: str = "") -> str:
    return f"""r AS (SELECT {id_}{cols}, row_number() OVER ({ORDER.format(id=id_, seed=seed)}) - 1 AS position,
                     count(*) OVER () AS n FROM {tbl})"""


@query("sample_exact", f"SELECT doc_id, lang FROM documents {ORDER.format(id='doc_id', seed=42)} LIMIT 100")
def sample_exact(spark, sf):
    return sp.sample_exact(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(
    "sample_per_group",
    f"""SELECT doc_id, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY source {ORDER.format(id='doc_id', seed=42)}) <= 7""",
)
def sample_per_group(spark, sf):
    return sp.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 7)


@query("shuffle_rank", f"WITH {rank_sql('orders', 'o_orderkey', 42)} SELECT o_orderkey, position FROM r")
def shuffle_rank(spark, sf):
    return sp.shuffle_rank(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_80_10_10",
    f"""WITH {rank_sql('orders', 'o_orderkey', 42)}
        SELECT o_orderkey, CASE WHEN position < floor(CAST(n AS DOUBLE) * 0.8::DOUBLE) THEN 'train'
               WHEN position < floor(CAST(n AS DOUBLE) * 0.9::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r""",
)
def split_80_10_10(spark, sf):
    return sp.split_fractions(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_train_test",
    f"""WITH {rank_sql('orders', 'o_orderkey', 42)}
        SELECT o_orderkey, CASE WHEN position < ceil(CAST(n AS DOUBLE) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END
               AS split FROM r""",
)
def split_train_test(spark, sf):
    return sp.split_train_test(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


FOLDS_SQL = f"""{rank_sql('documents', 'doc_id', 69)},
   f AS (SELECT doc_id, CAST(position % 6 AS INTEGER) AS fold FROM r)"""


@query("folds_6", f"WITH {FOLDS_SQL} SELECT doc_id, fold FROM f")
def folds_6(spark, sf):
    return sp.deal_folds(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "kfold_experiments",
    f"""WITH {FOLDS_SQL} SELECT CAST(e AS INTEGER) AS experiment, doc_id,
          CASE WHEN fold = 5 THEN 'test' WHEN fold = e THEN 'valid' ELSE 'train' END AS role
        FROM f, range(5) x(e)""",
)
def kfold_experiments(spark, sf):
    return sp.fold_experiments(folds_6(spark, sf), "doc_id")


@query(
    "split_fixed_cv",
    f"WITH {FOLDS_SQL} SELECT doc_id, CASE WHEN fold = 5 THEN 'test' ELSE 'train' END AS split FROM f",
)
def split_fixed_cv(spark, sf):
    return sp.split_fixed_cv(table(spark, sf, "documents").select("doc_id"), "doc_id")


BLOCK_SQL = """CAST(CASE WHEN position < (n % 5) * (n // 5 + 1) THEN position // (n // 5 + 1)
          ELSE n % 5 + (position - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS INTEGER) AS fold"""


@query(
    "kfold_contiguous",
    f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS n
                   FROM customer) SELECT c_custkey, {BLOCK_SQL} FROM r""",
)
def kfold_contiguous(spark, sf):
    return sp.kfold(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query(
    "kfold_shuffled",
    f"WITH {rank_sql('customer', 'c_custkey', 42)} SELECT c_custkey, {BLOCK_SQL} FROM r",
)
def kfold_shuffled(spark, sf):
    return sp.kfold(table(spark, sf, "customer").select("c_custkey"), "c_custkey", shuffle=True)


@query(
    "split_by_group",
    """WITH RECURSIVE g AS (SELECT source, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY source),
       o AS (SELECT *, row_number() OVER (ORDER BY size DESC, first DESC) AS k FROM g),
       t AS (SELECT count(*) AS n FROM documents),
       w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS tr, CAST(0 AS BIGINT) AS va, CAST('' AS VARCHAR) AS split
             UNION ALL
             SELECT o.k,
               tr + CASE WHEN tr + size <= 0.8::DOUBLE * n THEN size ELSE 0 END,
               va + CASE WHEN tr + size > 0.8::DOUBLE * n AND tr + va + size <= 0.9::DOUBLE * n THEN size ELSE 0 END,
               CASE WHEN tr + size <= 0.8::DOUBLE * n THEN 'train'
                    WHEN tr + va + size <= 0.9::DOUBLE * n THEN 'valid' ELSE 'test' END
             FROM w JOIN o ON o.k = w.k + 1, t)
       SELECT doc_id, documents.source, w.split FROM documents JOIN o ON o.source = documents.source JOIN w ON w.k = o.k""",
)
def split_by_group(spark, sf):
    return sp.split_by_group(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source")
