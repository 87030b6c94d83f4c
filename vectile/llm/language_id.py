"""Language by string kernels: blended-spectrum n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge.

A text is the set of its byte n-grams, n = 1 .. 3 (A-Z lowered), hashed to a fixed width. The kernel of two texts is the
size of the common set over the root of both sizes. Landmark texts span the feature space (Nystroem); ridge regression
of +1/-1 targets per language is solved there. As the kernel is a scaled dot product, the landmarks and the solution
multiply out to one matrix, and texts are scored by batched products with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectile.llm import words as W

WIDTH = 1 << 13
PER_LANGUAGE = 1500  # texts of each language the ridge is fitted on, drawn by a hash of the id
LANDMARKS = 64  # of each language, from those
ROWS = 1024  # rows of a product


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # WIDTH x languages


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def presence(col) -> np.ndarray:
    """A row of WIDTH zeros and ones per text."""
    buf, rows = W.flat(col)
    out = np.zeros((len(rows) - 1, WIDTH), dtype=np.uint8)
    low = W._LOWER[buf].astype(np.uint32)
    who = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    code = np.zeros(len(low), dtype=np.uint32)
    for n in (1, 2, 3):
        size = len(low) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint32(257) + low[n - 1 :] + np.uint32(1)
        same = who[:size] == who[n - 1 :]
        slot = (code * np.uint32(2654435769)) >> np.uint32(32 - 13)
        out[who[:size][same], slot[same]] = 1
    return out


def has_letter(col) -> np.ndarray:
    buf, rows = W.flat(col)
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[rows[1:]] > total[rows[:-1]]
    for k in np.flatnonzero(~out & (rows[1:] > rows[:-1])):
        out[k] = any(ch.isalpha() for ch in buf[rows[k] : rows[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def fit(
    docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = 1e-3, seed: int = 5,
) -> KernelModel:
    """Learn from the rows where ``usable`` holds and text, id and language are not null.

    An id gives one text, that of the least hash, however many rows it has. At most ``per_language`` texts of a language leave the executors, as packed presence bits of a kilobyte, so the
    sample is bounded by the number of languages. No usable row: a model without languages.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))  # a row per language
    share = F.broadcast(sizes.select("lang", (F.lit(2.0 * per_language) / F.col("n")).alias("share")))
    near = rows.select("id", "lang", "draw").join(share, "lang").where(F.col("draw") < F.col("share")).select("id", "lang", "draw").distinct()
    order = Window.partitionBy("lang").orderBy("draw", "id")
    picked = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id", "lang", "k")

    def pack(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                bits = np.packbits(presence(part.column("text")), axis=1)
                yield pa.RecordBatch.from_pydict(
                    {"lang": part.column("lang"), "k": part.column("k"), "bits": pa.array([b.tobytes() for b in bits], pa.binary())}
                )

    # of an id's rows the one with the least text hash
    drawn = rows.join(F.broadcast(picked), ["id", "lang"]).groupBy("lang", "k").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = drawn.select("lang", "k", "text").mapInArrow(pack, "lang string, k int, bits binary").collect()
    found.sort(key=lambda r: (r["lang"], r["k"], bytes(r["bits"])))
    languages = tuple(sorted({r["lang"] for r in found}))
    if not languages:
        return KernelModel((), np.zeros((WIDTH, 0), np.float32))
    x = np.unpackbits(np.stack([np.frombuffer(r["bits"], np.uint8) for r in found]), axis=1)[:, :WIDTH].astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    lang = np.array([languages.index(r["lang"]) for r in found])
    y = np.where(lang[:, None] == np.arange(len(languages)), 1.0, -1.0)
    mark = np.array([r["k"] <= landmarks for r in found])
    marks = x[mark].astype(float)
    value, vector = np.linalg.eigh(marks @ marks.T)
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])  # the landmarks' kernel to the power of -1/2
    phi = (x @ marks.T.astype(np.float32)).astype(float) @ whiten
    balance = 1.0 / np.bincount(lang)[lang]  # every language counts alike
    gram = (phi * balance[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, (phi * balance[:, None]).T @ y)
    return KernelModel(languages, (marks.T @ (whiten @ solved)).astype(np.float32))


def predict(docs: DataFrame, model: KernelModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text. ``und`` and 0 if it is null or has no letter, or nothing was learned.

    score: the winning language's regression value, moved from -1 .. 1 to 0 .. 1 and clipped. Ties go to the first
    language by name. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        names = np.array([*sent.value.languages, "und"], dtype=object)
        weights = sent.value.weights
        for batch in batches:
            for part in W.pieces(batch, "text"):
                best, score = [], []
                for lo in range(0, part.num_rows, ROWS):
                    col = part.column("text").slice(lo, ROWS)
                    x = presence(col).astype(np.float32)
                    y = (x @ weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                    ok = has_letter(col) & (len(names) > 1)
                    top = y.argmax(axis=1) if len(names) > 1 else np.zeros(len(col), dtype=np.int64)
                    high = y[np.arange(len(col)), top] if len(names) > 1 else np.zeros(len(col))
                    best.append(np.where(ok, top, len(names) - 1))
                    score.append(np.where(ok, np.clip((high + 1) / 2, 0, 1), 0.0))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id"), "lang_pred": pa.array(names[np.concatenate(best)].tolist(), pa.string()),
                        "score": pa.array(np.round(np.concatenate(score).astype(float), 6), pa.float64()),
                    }
                )

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
