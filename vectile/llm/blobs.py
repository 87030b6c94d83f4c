"""Rows that carry many small values as packed arrays, so that a shuffle moves blocks rather than values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    return b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types, strict=True):
        a = np.frombuffer(blob, t, int(n), at)
        out.append(a)
        at += a.nbytes
    return out


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that occurs; positions stay in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return [(int(bucket[p[0]]), p) for p in parts]


def blob_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0])


def parts_for(spark, total: int, each: int) -> int:
    """How many partitions hold ``total`` bytes at ``each`` or less, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))
