"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the common form each rare one goes to.

Of two words within one edit, the shorter (of equal lengths the lesser) gives its two disjoint chunks, its halves; the
longer gives positional grams as long as they are. One edit leaves one half whole, and, as it lies in the other half,
one of that half's two quarters as well. So the chunk joined on is a half with a quarter of the other, which keeps the
groups small. Whole parts stand at the same place or, behind an insertion, one place on: only grams within that shift of
a chunk's own place can join, so no others are made. What meets is verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.session import cut

LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORTEST = 4  # a word needs four quarters
HOT = 1_000  # words with a chunk that one part of a join key holds

_UPPER = "".join(map(chr, range(65, 91)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def text_words(docs: DataFrame, *, text_col: str = "text", pattern: str = LETTERS) -> DataFrame:
    """All columns and ``word``: every maximal run of the pattern in the text, A-Z lowered; null texts have none."""
    runs = F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(f"({pattern})"), 0)
    return docs.withColumn("word", F.explode(runs))


def slipped(word: Column, salt: Column, every: int) -> Column:
    """The word without one code point where ``every`` divides h = crc32 of ``<salt>:<word>``, the one at h modulo its length.

    A null salt is empty. This makes typing errors that any engine repeats.
    """
    h = F.crc32(F.concat(F.coalesce(salt.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(words: DataFrame, *, least: int, shortest: int) -> DataFrame:
    """(word, n) of the distinct words of ``words`` with at least that many occurrences and code points; null is no word."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _part(word: Column, at: Column, size: Column) -> Column:
    return F.substring(word, at + 1, size)


def _keys(word: Column, length: Column, shift: int, longer: int) -> list[Column]:
    """The four keys of a word cut as one of ``length`` code points for partners ``longer`` by 0 or 1.

    A key: its kind, that length and difference, a half, a quarter of the other half. Parts in front of the edit stand
    at their own place, parts behind it ``shift`` on.
    """
    half = F.floor(length / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
    zero = F.lit(0)
    left, right = _part(word, zero, half), _part(word, half + shift, length - half)
    kinds = [
        (left, _part(word, half, third - half)),  # the edit lies in the last quarter
        (left, _part(word, third + shift, length - third)),  # in the third
        (right, _part(word, zero, first)),  # in the second
        (right, _part(word, first + shift, half - first)),  # in the first
    ]
    return [F.concat_ws("/", F.lit(f"{k}{longer}"), length.cast("string"), a, b) for k, (a, b) in enumerate(kinds)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): all ordered pairs of distinct words that differ by exactly one inserted, deleted or replaced code point.

    ``words`` (word): repeated and null rows count once or not at all. Words under four code points have too few parts:
    use ``shortest`` to leave them out before. A chunk that many words share is dealt to parts by the word that gives it,
    and its grams go to each part, so no key holds more than about ``HOT`` words of one side.
    """
    own = words.select("word").where(F.length("word") >= SHORTEST).distinct()
    n, word = F.length("word"), F.col("word")
    chunks = own.select("word", F.explode(F.array(*_keys(word, n, 0, 0), *_keys(word, n, 0, 1))).alias("key"))
    grams = own.select(F.col("word").alias("other"), F.explode(F.array(*_keys(word, n, 0, 0), *_keys(word, n - 1, 1, 1))).alias("key"))
    crowded = cut(chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    if not crowded.isEmpty():  # nothing is lost either way: the parts of a key together meet as the whole would
        part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
        chunks = chunks.join(crowded, "key", "left").select("word", "key", part.alias("part"))
        grams = grams.join(crowded, "key", "left").select("other", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        met = chunks.join(grams.hint("merge"), ["key", "part"])
    else:
        met = chunks.join(grams.hint("merge"), "key")
    lesser = (F.length("word") < F.length("other")) | (F.col("word") < F.col("other"))
    pairs = met.where(lesser & (F.levenshtein("word", "other", 1) == 1)).select("word", "other").distinct()
    return pairs.select(F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))).alias("p")).select("p.*")


def group_variants(counts: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counts`` (word, n).

    ``form``: the near word of largest n (ties: the smallest in code-point order), if its n is at least ``ratio`` times
    the word's, else null; ``root``: where following forms ends, the word itself without one. A form has at least
    ``ratio`` times the count of its word, so chains are short; they are followed by doubling, in as many rounds as the
    logarithm of the longest.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or chains of forms could close")
    counts = cut(counts)
    pairs = cut(near_words(counts))
    near = pairs.join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    full = counts.join(best, "word", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    full = cut(full.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ))
    step = full.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut(step.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return full.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, ratio: int = 5, slip_every: int | None = None,
) -> DataFrame:
    """``group_variants`` over the words of whole texts; ``slip_every`` puts in the typing errors of ``slipped`` first.

    Null, empty and letterless texts give no words, an empty table gives no rows; repeated rows count as often as they
    occur. Other columns aren't read.
    """
    if shortest < SHORTEST:
        raise ValueError(f"shortest must be at least {SHORTEST}")
    rows = text_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).where(F.length("word") >= shortest)
    if slip_every:
        rows = rows.withColumn("word", slipped(F.col("word"), F.col("id"), slip_every))
    return group_variants(word_counts(rows, least=least, shortest=shortest), ratio=ratio)
