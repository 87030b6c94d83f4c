"""Dense global positions and running totals without a one-partition window.

Two ways to number rows 0..n-1:

* by hash key: the leading hex digits of the key are an even, order-preserving bucket, so counts per
  bucket give exact offsets and only rows of one bucket are sorted together;
* by any column order: Spark's range partitioning on the full (unique) order, written once to the
  shared folder so that partition numbers cannot move between the two passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectile.functions.keys import order_key
from vectile.session import pinned

_KEY, _BUCKET, _BEFORE, _COUNT = "__key", "__bucket", "__before", "__count"
_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its lower 33 bits


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], small: bool) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(F.broadcast(renamed) if small else renamed, cond).drop(*[f"__r_{c}" for c in on])


def _offsets(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket and the group total. At most 16^digits rows per group."""
    counts = keyed.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias(_COUNT))
    w = Window.partitionBy(*by)
    before = w.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by,
        _BUCKET,
        _COUNT,
        F.coalesce(F.sum(_COUNT).over(before), F.lit(0)).alias(_BEFORE),
        F.sum(_COUNT).over(w).alias("total"),
    )


def _with_bucket(df: DataFrame, id_col: str, seed: int | str, digits: int) -> DataFrame:
    return df.withColumn(_KEY, order_key(id_col, seed)).withColumn(_BUCKET, F.substring(_KEY, 1, digits))


def hash_positions(
    df: DataFrame, id_col: str, *, seed: int | str = 42, by: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """Add ``position`` (0-based, in md5 order, per ``by`` group) and ``total`` (rows in the group)."""
    keyed = _with_bucket(df, id_col, seed, digits)
    offsets = _offsets(keyed, by).drop(_COUNT)
    joined = _join_null_safe(keyed, offsets, [*by, _BUCKET], small=not by)
    w = Window.partitionBy(*by, _BUCKET).orderBy(_KEY, id_col)
    return joined.withColumn("position", F.col(_BEFORE) + F.row_number().over(w) - 1).drop(_KEY, _BUCKET, _BEFORE)


def take_lowest(
    df: DataFrame, id_col: str, n: int | Column, *, seed: int | str = 42, by: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """Exactly the ``n`` rows (per group) of lowest md5 key. ``n`` may use the ``total`` column.

    Buckets wholly below the cut pass without a shuffle; only the one bucket holding the cut is sorted.
    """
    n = F.lit(n) if isinstance(n, int) else n
    keyed = _with_bucket(df, id_col, seed, digits)
    offsets = (
        _offsets(keyed, by)
        .withColumn("__n", n)
        .where(F.col(_BEFORE) < F.col("__n"))
        .withColumn("__whole", F.col(_BEFORE) + F.col(_COUNT) <= F.col("__n"))
        .drop(_COUNT, "total")
    )
    joined = _join_null_safe(keyed, offsets, [*by, _BUCKET], small=not by)
    whole = joined.where("__whole").select(*df.columns)
    w = Window.partitionBy(*by, _BUCKET).orderBy(_KEY, id_col)
    edge = (
        joined.where("not __whole")
        .withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= F.col("__n") - F.col(_BEFORE))
        .select(*df.columns)
    )
    return whole.unionByName(edge)


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partitioned, sorted, written rows with their partition and row number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = pinned(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    return fixed.withColumn("__mid", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("__mid", 33).cast("int").alias("__part"),
        F.col("__mid").bitwiseAND(F.lit(_ROW_MASK)).alias("__row"),
    ).drop("__mid")


def range_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``position`` and ``total`` by any unique order. A tie-breaking id in ``order`` splits hot values."""
    ranged = _ranged(df, order)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias(_COUNT))
    w = Window.orderBy("__part")  # one row per partition
    offsets = counts.select(
        "__part",
        (F.sum(_COUNT).over(w) - F.col(_COUNT)).alias(_BEFORE),
        F.sum(_COUNT).over(Window.partitionBy()).alias("total"),
    )
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn("position", F.col(_BEFORE) + F.col("__row"))
        .drop("__part", "__row", _BEFORE)
    )


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], *, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``run_<c>`` (inclusive) and ``all_<c>`` for each summed column, per ``by`` group.

    ``order`` must be unique within a group. A hot group is spread over range partitions: totals per
    (group, partition) are the only thing a group-wide window sees.
    """
    ranged = _ranged(df, [*[F.col(c) for c in by], *order])
    parts = ranged.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("__part")
    offsets = parts.select(
        *by,
        "__part",
        *[(F.sum(f"__s_{c}").over(upto) - F.col(f"__s_{c}")).alias(f"__b_{c}") for c in sums],
        *[F.sum(f"__s_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, "__part").orderBy("__row")
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"__l_{c}") for c in sums])
    joined = _join_null_safe(local, offsets, [*by, "__part"], small=not by)
    return joined.select(
        *df.columns,
        *[(F.col(f"__b_{c}") + F.col(f"__l_{c}")).alias(f"run_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
        F.col("__part"),
        F.col("__row"),
    ).drop("__part", "__row")
