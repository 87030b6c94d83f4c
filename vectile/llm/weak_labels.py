"""Quality classifier from weak labels: EM rates overlapping heuristic labellers, posteriors train a hashed scorer.

Each labeller says bad, good or nothing of a document. Only the counts of vote patterns leave the executors (three to
the power of the labellers at most); EM estimates from them how often each labeller speaks and errs on either class,
and so a posterior for each pattern. A bounded sample with these soft labels trains a linear scorer over hashed words
and a few statistics, by gradient steps that Spark sums. The scorer then judges every document on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm import words as W
from vectile.llm.blobs import blob_rows
from vectile.llm.text_stats import counts, shares
from vectile.session import cut

BITS = 18
REJECT_FROM = 0.7  # score from which a document is rejected
TRAIN_ROWS = 24_000  # different texts the scorer learns from, drawn by a hash of the text; half of them suspected bad
LEXICON_ROWS = 6_000
LEXICON_WORDS = 2_000
PARTS = 8
SCALE = 3.0  # of a hashed word against the square root of the number of words
DENSE = ("symbol_share", "bar_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "top_share", "insult_share")

# Fixed word list: insults that one labeller looks for.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

LABELLERS = ("symbols", "bars", "shouting", "same_word", "same_lines", "same_passages", "insults", "spotless", "human")
_INSULTS = np.sort(W.word_hashes(W.words_of(pa.array([" ".join(INSULTS)]))))
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def plain_hashes(w: W.Words) -> np.ndarray:
    """Hashes of the words in lower case (A-Z), without one mark at the end; a word of one mark stays."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    end = w.end - (_PUNCT[w.buf[w.end - 1]] & (w.end - w.start > 1))
    return W.span_hashes(W._LOWER[w.buf], w.start, end)


def stem_hashes(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash of its first four bytes in lower case) of words of five bytes or more."""
    at = np.flatnonzero(w.end - w.start >= 5)
    low = W._LOWER[w.buf]
    four = np.zeros(len(at), dtype=np.uint64)
    for k in range(4):
        four |= low[w.start[at] + k].astype(np.uint64) << np.uint64(8 * k)
    return at, W.mix(four + np.uint64(1 << 40))


def votes(c: dict[str, np.ndarray], s: dict[str, np.ndarray], insults: np.ndarray) -> np.ndarray:
    """1 bad, 0 good, -1 nothing: a column per heuristic labeller.

    Each fault has a labeller that accuses or is silent, as one fault's absence says nothing of the others; a last one
    calls good what shows no trace of any.
    """
    enough = c["n_words"] >= 10
    bad = [
        s["symbol_share"] > 0.03,
        s["bar_share"] > 0.1,
        (s["upper_share"] > 0.4) & (s["mark_share"] > 0.2),
        (s["top_share"] > 0.4) & enough | (s["distinct_share"] < 0.1),
        (c["n_dup_lines"] >= 3) & (s["dup_line_share"] > 0.2),
        (s["repeat_share"] > 0.3) & enough,
        insults >= 2,
    ]
    spotless = enough & (s["symbol_share"] == 0) & (s["upper_share"] < 0.2) & (s["repeat_share"] < 0.1) & (insults == 0)
    cols = [np.where(x & (c["n_words"] > 0), 1, -1) for x in bad] + [np.where(spotless, 0, -1)]
    return np.stack(cols, axis=1)


def fit_accuracies(patterns: np.ndarray, n: np.ndarray, *, rounds: int = 200, tol: float = 1e-9):
    """EM over vote patterns (-1, 0, 1) with their counts.

    A document is bad if any labeller's fault is there, so a labeller may miss bad documents but rarely accuses a good
    one. (posterior of bad per pattern, table [class, labeller, vote + 1], converged). Smoothing keeps every vote possible.
    """
    k = patterns.shape[1]
    post = np.where((patterns == 1).any(axis=1), 0.9, 0.05)
    last = None
    table = np.zeros((2, k, 3))
    for _ in range(rounds):
        prior = np.clip((post * n).sum() / max(n.sum(), 1), 1e-4, 1 - 1e-4)
        for cls, weight in enumerate((n * (1 - post), n * post)):
            for v in range(3):
                table[cls, :, v] = ((patterns == v - 1) * weight[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        like = [np.log(table[c][np.arange(k), patterns + 1]).sum(axis=1) for c in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - prior) - like[1] - np.log(prior), -50, 50)))
        if last is not None and np.abs(post - last).max() < tol:
            return post, table, True
        last = post
    return post, table, False


@dataclass(frozen=True)
class Scorer:
    """weights of 2**BITS hashed words and stems, the dense statistics and the bias; the lexicon one statistic counts."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float
    lexicon: np.ndarray


def features(part_text, lexicon: np.ndarray = _INSULTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict, dict, np.ndarray]:
    """(row and slot of each distinct hashed word or stem, dense statistics, counts, shares, lexicon words per row)"""
    w, c = counts(part_text)
    s = shares(c)
    h = plain_hashes(w)
    who = w.row_of()
    n = len(w.rows) - 1
    at, stem = stem_hashes(w)
    known = _among(h, lexicon)
    known[at] |= _among(stem, lexicon)
    insults = np.bincount(who[known], minlength=n)
    both, owner = np.concatenate([h, stem]), np.concatenate([who, who[at]])
    slot = np.unique((owner.astype(np.int64) << BITS) | (both >> np.uint64(64 - BITS)).astype(np.int64))
    s["insult_share"] = np.minimum(insults, 4) / 4
    dense = np.stack([s[k] for k in DENSE], axis=1)
    return slot >> BITS, slot & ((1 << BITS) - 1), dense, c, s, insults


def _among(h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    return lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = LEXICON_ROWS) -> np.ndarray:
    """Sorted hashes of words and stems that mark texts labelled toxic, and the fixed insults.

    From at most ``rows`` toxic and as many other labelled ids, each text once: found in 1 toxic text of 60 and in 4,
    and 25 times likelier there than elsewhere. At most LEXICON_WORDS leave the executors.
    """
    bad = F.max(F.coalesce(F.col("toxic"), F.lit(0)))
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(bad.alias("toxic"))
    order = F.xxhash64("id", F.lit(3))
    drawn = known.where("toxic = 1").orderBy(order, "id").limit(rows).unionByName(known.where("toxic <> 1").orderBy(order, "id").limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id")

    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                w = W.words_of(part.column("text"))
                h, who = plain_hashes(w), w.row_of()
                at, stem = stem_hashes(w)
                pair = np.unique(np.stack([np.concatenate([who, who[at]]).astype(np.uint64), np.concatenate([h, stem])]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                cuts = np.searchsorted(pair[0], np.arange(part.num_rows + 1, dtype=np.uint64)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(pair[1].view(np.int64)))
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "toxic": part.column("toxic"), "words": lists})

    picked = texts.select(F.xxhash64("text").alias("key"), F.col("toxic").cast("int"), "text").mapInArrow(run, "key bigint, toxic int, words array<bigint>")
    picked = cut(picked.groupBy("key").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")))
    sizes = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return _INSULTS
    counted = picked.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rate = F.col("a") / float(sizes[1])
    telling = (F.col("a") >= max(4, sizes[1] / 60)) & (rate > 25 * (F.col("b") + 0.5) / float(sizes.get(0, 0) + 1))
    found = counted.where(telling).orderBy(F.desc("a"), "word").limit(LEXICON_WORDS).select("word").collect()
    return np.unique(np.concatenate([_INSULTS, np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64)]))


def _margins(model: Scorer, row: np.ndarray, slot: np.ndarray, dense: np.ndarray) -> np.ndarray:
    size = np.maximum(np.bincount(row, minlength=len(dense)), 1)
    return np.bincount(row, weights=model.weights[slot], minlength=len(dense)) * SCALE / np.sqrt(size) + dense @ model.dense + model.bias


def label_patterns(docs: DataFrame, labels: DataFrame, lexicon: np.ndarray = _INSULTS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, v0 .. v8): the votes on every document; key is a hash of its text.

    Labels with quality 0 or toxic 1 are the human labeller's bad, others its good; several for an id count as the
    worst; null ones as nothing. A null text gets no vote but the human one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    k = len(LABELLERS) - 1

    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                _, _, _, c, s, insults = features(part.column("text"), lexicon)
                v = votes(c, s, insults)
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column("id"), "key": part.column("key")} | {f"v{j}": pa.array(v[:, j], pa.int32()) for j in range(k)}
                )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, key bigint, " + ", ".join(f"v{j} int" for j in range(k))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    human = known.groupBy(F.col(id_col).alias("id")).agg(F.max(bad.cast("int")).alias("human"))
    voted = rows.mapInArrow(run, schema).join(human.hint("merge"), "id", "left")
    return voted.select("id", "key", *[f"v{j}" for j in range(k)], F.coalesce("human", F.lit(-1)).alias(f"v{k}"))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
    rounds: int = 25,
) -> tuple[Scorer, pd.DataFrame]:
    """(scorer, what EM says of each labeller). An empty table gives a scorer that keeps everything."""
    spark = docs.sparkSession
    cols = [f"v{j}" for j in range(len(LABELLERS))]
    lexicon = learn_lexicon(docs, labels, id_col=id_col, text_col=text_col)
    seen = cut(label_patterns(docs, labels, lexicon, id_col=id_col, text_col=text_col))
    found = seen.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).toPandas()  # 3 ** 9 rows at most
    nothing = Scorer(np.zeros(1 << BITS), np.zeros(len(DENSE)), -10.0, lexicon)
    if found.empty:
        return nothing, pd.DataFrame(columns=["labeller", "says_bad_of_bad", "says_bad_of_good"])
    post, table, _ = fit_accuracies(found[cols].to_numpy(), found["n"].to_numpy(dtype=float))
    report = pd.DataFrame({"labeller": LABELLERS, "says_bad_of_bad": table[1, :, 2], "says_bad_of_good": table[0, :, 2]})
    # as an Arrow table: from pandas, unless Arrow is switched on, every executor starts a second set of Python workers
    soft = F.broadcast(spark.createDataFrame(pa.table({c: pa.array(found[c], pa.int32()) for c in cols} | {"p": pa.array(post)})))
    texts = seen.join(soft, cols).groupBy("key").agg(F.avg("p").alias("p"))  # copies teach once
    suspect = F.col("p") > 0.5
    order = F.xxhash64("key", F.lit(7))
    drawn = texts.where(suspect).orderBy(order).limit(train_rows // 2).unionByName(texts.where(~suspect).orderBy(order).limit(train_rows // 2))
    rows = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    picked = rows.join(F.broadcast(drawn), "key").mapInArrow(_gathered(lexicon), "key bigint, p double, slots binary, dense binary")
    sample = cut(picked.repartition(PARTS, "key"))  # copies of a text land together, and count once
    total = sample.agg(F.countDistinct("key")).first()[0]
    if not total:
        return nothing, report
    # half of the sample is suspect, whatever the table: the bias goes back to the table's odds
    share = sample.dropDuplicates(["key"]).agg(F.avg("p")).first()[0]
    prior = texts.agg(F.avg("p")).first()[0]
    odds = lambda p: np.log(max(p, 1e-6) / max(1 - p, 1e-6))
    model = _descend(sample, total, rounds, lexicon)
    return Scorer(model.weights, model.dense, model.bias + min(0.0, float(odds(prior) - odds(share))), lexicon), report


def _gathered(lexicon: np.ndarray):
    schema = pa.schema([("key", pa.int64()), ("p", pa.float64()), ("slots", pa.binary()), ("dense", pa.binary())])

    def run(batches):
        sent: set[int] = set()  # at most the drawn texts
        for batch in batches:
            for part in W.pieces(batch, "text"):
                row, slot, dense, *_ = features(part.column("text"), lexicon)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                rows = []
                for k, (key, p) in enumerate(zip(part.column("key").to_pylist(), part.column("p").to_pylist(), strict=True)):
                    if key not in sent:
                        sent.add(key)
                        rows.append((key, p, slot[bounds[k] : bounds[k + 1]].astype(np.uint32).tobytes(), dense[k].tobytes()))
                yield blob_rows(rows, schema)

    return run


def _descend(sample: DataFrame, total: int, rounds: int, lexicon: np.ndarray, l2: float = 1e-4, rate: float = 0.8) -> Scorer:
    """Logistic loss by AdaGrad steps over the whole sample; a step's gradient is summed over PARTS partitions."""
    spark = sample.sparkSession
    size, d = 1 << BITS, len(DENSE)
    theta, seen = np.zeros(size + d + 1), np.full(size + d + 1, 1e-8)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(theta)

        def step(batches, now=now):
            grad, done = np.zeros(size + d + 1), set()
            model = Scorer(now.value[:size], now.value[size:-1], float(now.value[-1]), lexicon)
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns]
                keep = [k for k, key in enumerate(cols[0]) if not (key in done or done.add(key))]
                if not keep:
                    continue
                slots = [np.frombuffer(cols[2][k], np.uint32).astype(np.int64) for k in keep]
                sizes = np.array([len(x) for x in slots])
                row, slot = np.repeat(np.arange(len(keep)), sizes), np.concatenate(slots)
                dense = np.stack([np.frombuffer(cols[3][k], np.float64) for k in keep])
                miss = 1 / (1 + np.exp(-np.clip(_margins(model, row, slot, dense), -30, 30))) - np.array([cols[1][k] for k in keep])
                grad[:size] += np.bincount(slot, weights=(miss * SCALE / np.sqrt(np.maximum(sizes, 1)))[row], minlength=size)
                grad[size:-1] += miss @ dense
                grad[-1] += miss.sum()
            yield pa.record_batch({"grad": pa.array([grad.astype(np.float32).tobytes()], pa.binary())})

        grads = sample.coalesce(PARTS).mapInArrow(step, "grad binary").collect()  # PARTS rows of a megabyte
        grad = sum(np.frombuffer(g["grad"], np.float32).astype(float) for g in grads) / total + l2 * theta
        seen += grad * grad
        theta = theta - rate * grad / np.sqrt(seen)
        now.unpersist()
    return Scorer(theta[:size].astype(np.float32), theta[size:-1], float(theta[-1]), lexicon)


def score_documents(docs: DataFrame, model: Scorer, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` with the probability that the row is bad; null and empty texts get 1.

    ``score_col`` must be a new name.
    """
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is a column already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, text_col):
                row, slot, dense, c, *_ = features(part.column(text_col), sent.value.lexicon)
                p = 1 / (1 + np.exp(-np.clip(_margins(sent.value, row, slot, dense), -30, 30)))
                p = np.where(c["n_words"] == 0, 1.0, p)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
