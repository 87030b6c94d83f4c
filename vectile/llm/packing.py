"""Token sequences of a fixed size from documents of any length, packed over the histogram of lengths."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm import words as W
from vectile.llm.tokens import Encoder
from vectile.session import cut

BUCKET_ROWS = 50_000


def pack_documents(
    docs: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 0, id_col: str = "doc_id",
    text_col: str = "text", fold: bool = False, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents laid into sequences of at most ``size`` tokens.

    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]). A document's ids are those of
    ``tokenizer`` (a file of the tokenizers library; ``fold`` if it ignores case) and ``end_id``; a null or empty
    text is ``end_id`` alone. Documents are cut into full sequences and a rest. Lengths are placed longest first,
    each into the patterns with most room; only their histogram reaches the driver. Documents then find their
    place by their rank among the pieces of their length. Equal rows are packed each for itself; other columns
    are not read. ``length`` sums to the tokens of all rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = f"id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", ids array<int>" if with_ids else ""
    parts = cut(rows.mapInArrow(_cut_rows(Encoder(tokenizer, fold), size, end_id, with_ids), schema))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    slots = parts.sparkSession.sparkContext.broadcast(_slots(patterns(counts, size)))
    ranked = _ranked(parts, sum(counts.values()))

    def place(batches):
        key, base, offset = slots.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            mine = (length << 44) | rank
            at = np.searchsorted(key, mine, side="right") - 1
            cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            cols["sequence_id"] = pa.array(base[at] + mine - key[at], pa.int64())
            cols["offset"] = pa.array(offset[at], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    out = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, out).withColumnRenamed("id", id_col)


def _cut_rows(encoder: Encoder, size: int, end_id: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                ids, bounds = encoder.encode(part.column("text"))
                n = np.diff(bounds) + 1
                out = np.full(int(n.sum()), end_id, dtype="<u4")
                first = np.cumsum(n) - n
                out[W.ranges(first, n - 1)] = ids
                pieces = -(-n // size)
                owner = np.repeat(np.arange(len(n)), pieces)
                start = W.ranges(np.zeros(len(n), dtype=np.int64), pieces) * size
                length = np.minimum(size, n[owner] - start)
                lo = first[owner] + start
                data = memoryview(out.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                cols = {
                    "id": part.column("id").take(pa.array(owner)), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(n[owner], pa.int64()),
                }
                if with_ids:
                    cuts = np.append(lo, len(out)).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(out.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _ranked(parts: DataFrame, n: int) -> DataFrame:
    """Adds each piece's rank among those of its length, counted by hash buckets so that no length is one task."""
    buckets = max(1, -(-n // BUCKET_ROWS))
    salted = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("r", F.row_number().over(own) - 1).join(begin.hint("merge"), ["length", "bucket"])
    return ranked.select(*parts.columns, (F.col("begin") + F.col("r")).cast("bigint").alias("rank"))


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in them): shortest pack first over the histogram, longest lengths first.

    A length goes to the patterns with most room while it fits there; what doesn't fit anywhere opens new
    sequences. A pattern that is only partly needed is split, so there are at most two new patterns a length.
    """
    heap: list[tuple[int, int]] = []  # (-room, pattern)
    many: list[int] = []
    held: list[list[int]] = []
    for length in sorted(counts, reverse=True):
        left, used = counts[length], []
        while left:
            if heap and -heap[0][0] >= length:
                room, p = heapq.heappop(heap)
                if many[p] > left:
                    many.append(many[p] - left)
                    held.append(list(held[p]))
                    used.append((room, len(many) - 1))
                    many[p] = left
            else:
                p, room = len(many), -size
                many.append(left)
                held.append([])
            left -= many[p]
            held[p].append(length)
            used.append((room + length, p))
            if left and (not heap or -heap[0][0] < length):
                for x in used:
                    heapq.heappush(heap, x)
                used = []
        for x in used:
            heapq.heappush(heap, x)
    return list(zip(many, held, strict=True))


def _slots(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys with the first sequence and the offset of the pieces from there on."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for count, lengths in plan:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            rows.append(((x << 44) | rank, base, offset))
            taken[x] = rank + count
            offset += x
        base += count
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
