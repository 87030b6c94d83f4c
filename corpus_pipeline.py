"""A corpus from documents to packed sequences: quality, near copies, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Stages that send texts to Python keep the session's batches small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.llm.decontaminate import find_leaks, row_key
from vectile.llm.jaccard_join import jaccard_components, sent
from vectile.llm.packing import pack_documents
from vectile.llm.pii import replace_entities
from vectile.llm.queries import PII_KEY, tokenizer
from vectile.llm.weak_labels import REJECT_FROM, score_documents, train
from vectile.plans.registry import table
from vectile.session import cut, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer doesn't reject; null and empty texts go."""
    small_batches(spark)
    model, _ = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, score_col="_score").where(F.col("_score") < REJECT_FROM).drop("_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 0.8 over five-word runs, that of the least id; texts without words are no copies.

    Rows are judged one by one: of rows that share an id, only the copies go, and rows without an id go before others.
    """
    small_batches(spark)
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    # ordered as a copy is chosen: least id, null last, then by content; the number tells equal rows apart
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*docs.columns).alias("content"), "_row")
    found = jaccard_components(rows.select(order.alias("_at"), "text"), id_col="_at", size=5, percent=80)
    gone = cut(found.where("component_id._row <> _at._row").select("_at._row"))
    return rows.join(sent(gone), "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    leaks = cut(find_leaks(docs, table(spark, sf_dir, "benchmark"), any_case=True).select(F.col("key").alias("_key")).distinct())
    return docs.withColumn("_key", row_key("doc_id", "text")).join(leaks, "_key", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return replace_entities(docs, key=PII_KEY).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), size=1024, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None  # fitted models and a tokenizer: tested against plain Python instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
