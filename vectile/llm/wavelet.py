"""Token ids in wavelet matrices: one compressed file a shard, with access, counts and places without decoding it all.

A shard holds consecutive documents as one sequence of ids. Level by level, from the highest bit, the matrix stores
that bit of every id in the order so far, then moves ids with a zero before those with a one. Ones are summed every
512 bits, so a rank is a lookup and a few bytes. The files are Parquet with zstd, one row a shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.llm.blobs import parts_for, text_bytes
from vectile.llm.tokens import Encoder

SHARD_TOKENS = 8_000_000
SHARD_BYTES = 8 << 20  # text a shard is aimed at; one longer text makes a larger shard
STEP = 512
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class Wavelet:
    """A sequence of ids as bit planes. ``zeros``: ids with a zero at each level; ``sums``: ones before every step."""

    def __init__(self, n: int, zeros, planes, sums):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.sums = [np.frombuffer(s, np.uint32).astype(np.int64) for s in sums]

    @classmethod
    def build(cls, ids: np.ndarray) -> Wavelet:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, sums = [], [], []
        for b in range(levels - 1, -1, -1):
            one = (a >> a.dtype.type(b)) & a.dtype.type(1) == 1
            plane = np.packbits(one, bitorder="little")
            step = np.add.reduceat(_ONES[plane], np.arange(0, len(plane), STEP // 8)) if len(plane) else np.zeros(0, np.int64)
            sums.append((np.cumsum(step) - step).astype(np.uint32).tobytes())
            planes.append(plane.tobytes())
            zeros.append(len(a) - int(step.sum()))
            a = np.concatenate([a[~one], a[one]])
        return cls(len(ids), zeros, planes, sums)

    def decode(self) -> np.ndarray:
        levels = len(self.planes)
        a = np.zeros(self.n, dtype=np.uint16 if levels <= 16 else np.uint32)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            up[~one] = a[:z]
            up[one] = a[z:] | a.dtype.type(1 << b)
            a = up
        return a

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        plane, sums = self.planes[level], self.sums[level]
        if not len(plane):
            return np.zeros(len(at), dtype=np.int64)
        step = np.minimum(at // STEP, len(sums) - 1)
        out = sums[step].copy()
        byte, whole = step * (STEP // 8), at // 8
        for k in range(STEP // 8):
            out += np.where(byte + k < whole, _ONES[plane[np.minimum(byte + k, len(plane) - 1)]], 0)
        part = plane[np.minimum(whole, len(plane) - 1)] & ((1 << (at % 8)) - 1).astype(np.uint8)
        return out + np.where(whole < len(plane), _ONES[part], 0)

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for level, z in enumerate(self.zeros):
            one = (self.planes[level][at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            rank = self._rank(level, at)
            at = np.where(one, z + rank, at - rank)
            out = out * 2 + one
        return out

    def _span(self, token: int, lo: np.ndarray, hi: np.ndarray):
        for level, z in enumerate(self.zeros):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (z + a, z + b) if token >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id occurs in lo .. hi-1."""
        if token >> len(self.zeros):
            return 0
        a, b = self._span(token, np.array([lo]), np.array([self.n if hi is None else hi]))
        return int(b[0] - a[0])

    def locate(self, token: int) -> np.ndarray:
        """All positions of the id, ascending: from the last level's run back up by select."""
        if not self.n or token >> len(self.zeros):
            return np.zeros(0, dtype=np.int64)
        a, b = self._span(token, np.array([0]), np.array([self.n]))
        at = np.arange(a[0], b[0])
        for level in range(len(self.zeros) - 1, -1, -1):
            if not len(at):
                break
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            bit = token >> (len(self.zeros) - 1 - level) & 1
            at = np.flatnonzero(one)[at - self.zeros[level]] if bit else np.flatnonzero(~one)[at]
        return np.sort(at)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    fold: bool = False,
) -> None:
    """Write all documents' ids, ascending by id, as one file a shard under ``path``.

    A document's ids are those of ``tokenizer`` (a file of the tokenizers library; ``fold`` if it ignores case) and
    ``end_id``; a null or empty text is ``end_id`` alone. Null ids come first; rows with equal ids are ordered by
    text and each kept. Other columns are not read. An empty table writes no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = parts_for(spark, text_bytes(rows, "text"), SHARD_BYTES)
    id_type = rows.schema["id"].dataType.simpleString()
    encoder = Encoder(tokenizer, fold)

    def build(batches):
        ids, sizes, owners, total, k = [], [], [], 0, 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                found, bounds = encoder.encode(part.column("text"))
                size = np.diff(bounds) + 1
                out = np.full(int(size.sum()), end_id, dtype=np.uint32)
                out[W.ranges(np.cumsum(size) - size, size - 1)] = found
                ids.append(out)
                sizes.append(size)
                owners.append(part.column("id"))
                total += len(out)
                if total >= SHARD_TOKENS:
                    yield _shard(k, ids, sizes, owners)
                    ids, sizes, owners, total, k = [], [], [], 0, k + 1
        if ids:
            yield _shard(k, ids, sizes, owners)

    schema = f"shard bigint, n_tokens bigint, ids array<{id_type}>, sizes binary, zeros array<bigint>, planes array<binary>, sums array<binary>"
    dealt = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    dealt.mapInArrow(build, schema).write.option("compression", "zstd").parquet(path)


def _shard(k: int, ids: list, sizes: list, owners: list) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    w = Wavelet.build(flat)
    owner = pa.concat_arrays(owners)
    return pa.record_batch(
        {
            "shard": pa.array([(TaskContext.get().partitionId() << 20) | k], pa.int64()),
            "n_tokens": pa.array([len(flat)], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(owner)], pa.int32()), owner),
            "sizes": pa.array([np.concatenate(sizes).astype("<u4").tobytes()], pa.binary()),
            "zeros": pa.array([w.zeros], pa.list_(pa.int64())),
            "planes": pa.array([[p.tobytes() for p in w.planes]], pa.list_(pa.binary())),
            "sums": pa.array([[s.astype(np.uint32).tobytes() for s in w.sums]], pa.list_(pa.binary())),
        }
    )


def _opened(batches):
    """(row of the file, its matrix) for each shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            value = lambda c, row=row: row.column(c)[0].as_py()
            yield row, Wavelet(value("n_tokens"), value("zeros"), value("planes"), value("sums"))


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files.

    start: ids of all documents before it. ids_crc32: of the ids as little-endian 32-bit integers.
    """
    files = spark.read.parquet(path)
    id_type = files.schema["ids"].dataType.elementType.simpleString()

    def decode(batches):
        for row, w in _opened(batches):
            size = np.frombuffer(row.column("sizes")[0].as_py(), "<u4").astype(np.int64)
            ids = w.decode().astype("<u4")
            end = np.cumsum(size)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
            cols = {
                "id": row.column("ids").flatten(), "shard": pa.array(np.repeat(row.column("shard")[0].as_py(), len(size)), pa.int64()),
                "within": pa.array(end - size, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"id {id_type}, shard bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    out = files.mapInArrow(decode, schema).join(_begins(files).hint("merge"), "shard")
    return out.select("id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _begins(files: DataFrame) -> DataFrame:
    """(shard, tokens before it), summed by groups of shards so that no task holds all of them."""
    sizes = files.select("shard", "n_tokens", F.shiftright("shard", 30).alias("part"))
    groups = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("g"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("w", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return inner.join(groups, "part").select("shard", (F.col("g") + F.col("w")).alias("begin"))


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, n): occurrences of one id, from the planes' ranks alone."""

    def run(batches):
        for row, w in _opened(batches):
            yield pa.record_batch({"shard": row.column("shard"), "n": pa.array([w.count(token)], pa.int64())})

    return spark.read.parquet(path).mapInArrow(run, "shard bigint, n bigint")


def locate_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(id, position): every place of one id in the documents."""
    files = spark.read.parquet(path)

    def run(batches):
        for row, w in _opened(batches):
            end = np.cumsum(np.frombuffer(row.column("sizes")[0].as_py(), "<u4").astype(np.int64))
            at = w.locate(token)
            doc = np.searchsorted(end, at, side="right")
            first = np.concatenate([[0], end])[doc]
            yield pa.record_batch({"id": row.column("ids").flatten().take(pa.array(doc)), "position": pa.array(at - first, pa.int64())})

    return files.mapInArrow(run, f"id {files.schema['ids'].dataType.elementType.simpleString()}, position bigint")
