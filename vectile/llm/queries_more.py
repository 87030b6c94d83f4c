"""The queries over conversations and spellings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectile.llm.chat_tree import read_chat_tree, write_chat_tree
from vectile.llm.prefix_trie import prefix_trie, rebuilt
from vectile.llm.registered import query, tokenizer
from vectile.llm.spelling import spelling_variants
from vectile.plans.registry import table
from vectile.session import scratch_path


def crc_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a SQL string expression, bit by bit."""
    byte = f"('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT"
    steps = f"flatten(list_transform(range(0, strlen({text})), lambda i: [{byte}, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({steps}, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT), 4294967295)"


ESCAPE_SQL = r"regexp_replace({}, '([<\[])(\\*(?:/?s>|/?INST\]|/?<?/?SYS>>|\|[A-Za-z0-9_]+\|>))', '\1\\\2', 'g')"
ROLE_SQL = ESCAPE_SQL.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")


@query(
    "op11_chat_tree",
    f"""
    WITH r AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM r),
    s AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS t,
            coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS l,
            sum(length('<|im_start|>') + length({ROLE_SQL}) + 1 + length({ESCAPE_SQL.format("text")}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
        FROM o GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM s
    """,
)
def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, vocabulary = scratch_path(spark, "chat-tree"), tokenizer("byte_bpe_50k.json")
    control = "</s>[INST] ok [/INST]"
    pair = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(pair)
    write_chat_tree(rows, path, vocabulary)
    return read_chat_tree(spark, path, vocabulary)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE occ AS MATERIALIZED (
        SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS k, w, count(*) AS c
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
        WHERE length(w) >= 6 GROUP BY ALL
    ),
    hashed AS MATERIALIZED (SELECT w, c, {crc_sql("k")} AS h FROM occ),
    c AS MATERIALIZED (
        SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n
        FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5
    ),
    gap AS MATERIALIZED (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS d FROM (SELECT word, unnest(range(0, length(word))) AS p FROM c)),
    near AS MATERIALIZED (
        SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.p = b.p AND a.d = b.d AND a.word <> b.word
        UNION SELECT a.word, c.word FROM gap a JOIN c ON a.d = c.word
        UNION SELECT c.word, a.word FROM gap a JOIN c ON a.d = c.word
    ),
    best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY c.n DESC, other) AS top, max(c.n) AS top_n FROM near JOIN c ON c.word = other GROUP BY 1),
    f AS MATERIALIZED (
        SELECT c.word, c.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 5 * c.n THEN top END AS form, CASE WHEN top_n >= 5 * c.n THEN top_n END AS form_n
        FROM c LEFT JOIN best USING (word)
    ),
    chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
    ends AS (SELECT chain.word, root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), shortest=6, least=5, ratio=5, slip_every=199)


@query(
    "op13_prefix_trie",
    f"""
    WITH r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS MATERIALIZED (
        SELECT c, {crc_sql("c::VARCHAR")} % 6 AS h, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS s FROM r GROUP BY c
    ),
    built AS MATERIALIZED (
        SELECT o.c, list_concat(CASE WHEN o.h = 0 OR b.s IS NULL THEN [] ELSE b.s[1:o.h] END, o.s[o.h + 1:]) AS s
        FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100
    ),
    pre AS (SELECT c, len(s) AS l, d, list_slice(s, 1, d) AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
    node AS MATERIALIZED (
        SELECT d, k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '')) AS ends_sha256 FROM pre GROUP BY d, k
    ),
    kids AS MATERIALIZED (SELECT a.d, a.k, count(b.d) AS n_children FROM node a LEFT JOIN node b ON b.d = a.d + 1 AND list_slice(b.k, 1, a.d) = a.k GROUP BY a.d, a.k),
    full_ AS MATERIALIZED (SELECT node.*, n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n - 1) * length(node.k[node.d].x) END AS v FROM node JOIN kids ON node.d = kids.d AND node.k = kids.k),
    sub AS (
        SELECT a.d, a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.v)::BIGINT AS saved_tokens
        FROM full_ a JOIN full_ b ON b.d >= a.d AND list_slice(b.k, 1, a.d) = a.k GROUP BY a.d, a.k
    )
    SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
    FROM full_ a JOIN sub ON sub.d = a.d AND sub.k = a.k LEFT JOIN node p ON p.d = a.d - 1 AND p.k = list_slice(a.k, 1, p.d)
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
