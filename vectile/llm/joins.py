"""Joins that one key may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 10_000


def attached(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Rows with the values of their key (one row each, null where there is none).

    Keys of over a 500th of all rows, 500 at most, are joined in parts: rows are dealt by a hash of all their columns, the
    value goes to every part.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bound = max(HOT, rows.count() // 500)
    hot = F.broadcast(counts.where(F.col("_n") > bound).select(key, F.ceil(F.col("_n") / bound).cast("int").alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = values.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied.hint("merge"), [key, "_part"], "left").drop("_part")
