"""The registered queries of this package, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.llm.decision_list import BASE, apply_rules
from vectile.llm.decontaminate import mark_leaks
from vectile.llm.jaccard_join import jaccard_components
from vectile.llm.language_id import fit, held_out, predict
from vectile.llm.packing import pack_documents
from vectile.llm.pii import replace_entities
from vectile.llm.substring_dedup import remove_repeats
from vectile.llm.url_filter import Rule, judge_urls
from vectile.llm.wavelet import read_tokens, write_tokens
from vectile.llm.weak_labels import REJECT_FROM, score_documents, train
from vectile.llm.registered import ORACLES, QUERIES, query, tokenizer
from vectile.plans.registry import table
from vectile.session import scratch_path

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op1_substring_dedup",
    f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    win AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
    many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM win WHERE h IN (SELECT h FROM many)),
    word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), size=1024, end_id=0)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "wavelet")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2, fold=True)
    return read_tokens(spark, path).withColumnRenamed("id", "doc_id")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "rule")


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model).withColumn("score", F.round("score", 6))
    return scored.select("doc_id", "score", (F.col("score") < REJECT_FROM).alias("kept"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out("doc_id"))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "address_group")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True)
    return marked.withColumn("kept", ~F.col("leaked"))


PII_KEY = "surrogate key of the registered queries"


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key=PII_KEY, count_col="n_entities")


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


import vectile.llm.queries_more  # noqa: E402, F401  registers the rest
