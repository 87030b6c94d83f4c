"""Conversations as sequences of turn digests, sorted, with the turns that each shares with the one before it.

A turn is known by its digest, so that texts stay where they are; a conversation is one row of 16 bytes a turn. Equal
sequences are one row. Sorted, all that share their first turns stand together, and lcp[i], the number of turns shared
by the i-th and the one before, tells where: an array that is cut into blocks, one to a task, with the sums and minima of
whole blocks at hand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.session import pinned

DIGEST = 16
BLOCK_TURNS = 400_000  # turns of a block


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of a turn; null is empty. The role's length goes first, so that no other turn reads the same."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversation_turns(rows: DataFrame, *values: str, conv: str = "conv", turn: str = "turn") -> DataFrame:
    """(conv, turns): one row a conversation, its turns ordered by turn (null first), ties by digest.

    ``turns`` is an array of structs (turn, digest, *values). Repeated rows are turns of their own.
    """
    return rows.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "digest", *values))).alias("turns"))


def sequence(turns: Column | str) -> Column:
    """The digests of the turns one after the other, as bytes; byte order is then the order of sequences."""
    digests = F.transform(turns, lambda x: x["digest"])
    return F.unhex(F.array_join(digests, ""))


@dataclass
class Sorted:
    rows: DataFrame  # seq, other columns, part; a part that has rows is a block, in order within itself and among others
    parts: list[int]  # the parts with rows
    lcp: list[int]  # turns that a block's first sequence shares with the last one before, -1 for the first block


def sort_sequences(seqs: DataFrame, turns: int) -> Sorted:
    """Rows with distinct ``seq``, ``turns`` in all, sorted and cut into blocks. Only numbers of blocks reach the driver."""
    spark = seqs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    dealt = pinned(seqs.repartitionByRange(n, "seq").sortWithinPartitions("seq")).withColumn("part", F.spark_partition_id())
    ends = dealt.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))

    def shared(batches):
        # one row a block, in order and in one task; only the last sequence of the block before is kept
        last = None
        for batch in batches:
            parts, out = batch.column("part").to_pylist(), []
            for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
                out.append(-1 if last is None else _common(last, a))
                last = b
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "lcp": pa.array(out, pa.int32())})

    found = sorted(tuple(r) for r in ends.repartition(1).sortWithinPartitions("part").mapInArrow(shared, "part int, lcp int").collect())
    return Sorted(dealt, [r[0] for r in found], [r[1] for r in found])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = (np.frombuffer(z, np.uint8, n).reshape(-1, DIGEST) for z in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n // DIGEST


def shared_with_previous(col, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lcp, turns of each sequence, first turn of each) of a block's sequences; ``first`` is the first one's lcp."""
    buf, at = W.flat(col)
    flat = buf.view(np.uint64).reshape(-1, 2) if len(buf) else np.zeros((0, 2), np.uint64)
    start, size = at[:-1] // DIGEST, np.diff(at) // DIGEST
    many = np.minimum(size[:-1], size[1:])
    here = W.ranges(start[1:], many)
    there = W.ranges(start[:-1], many)
    differ = np.flatnonzero((flat[here] != flat[there]).any(axis=1))
    ends = np.cumsum(many)
    begin = ends - many
    where = np.append(differ, len(here))[np.searchsorted(differ, begin)]
    lcp = np.concatenate([[first], np.minimum(where, ends) - begin])[: len(size)]
    return lcp.astype(np.int64), size.astype(np.int64), start.astype(np.int64)


def over_blocks(ordered: Sorted, work: Callable[[int, pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """``work(block, its rows in order)`` of each block; a block is one partition."""
    number = {part: block for block, part in enumerate(ordered.parts)}

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            out = work(number[table.column("part")[0].as_py()], table)
            if out is not None:
                yield from out.combine_chunks().to_batches()

    return ordered.rows.mapInArrow(run, schema)


class Minima:
    """A sparse table: the minimum of any range by two looks, and how far a range can grow while it stays high."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values)]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2
        self.n = len(values)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo:hi], hi > lo."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), dtype=self.rows[0].dtype)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][lo[m]], self.rows[k][hi[m] - (1 << int(k))])
        return out

    def reach_right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first position from ``at`` on whose value is under ``depth``, n if none, by binary search."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = at < len(row)
            fits[fits] = row[at[fits]] >= depth[fits]
            at[fits] += 1 << k
        return at

    def reach_left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last position up to ``at`` whose value is under ``depth``, -1 if none, by binary search."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, back = self.rows[k], at - (1 << k) + 1
            fits = back >= 0
            fits[fits] = row[back[fits]] >= depth[fits]
            at[fits] -= 1 << k
        return at
