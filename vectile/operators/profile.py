"""Projections, filters, profiles and codes over keyed tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.operators.ranking import range_positions

# -- projections ---------------------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def cast_labels(df: DataFrame, cols: Sequence[str], dataset_type: str) -> DataFrame:
    """Integer labels for classification, doubles for regression; bad values become null."""
    if dataset_type not in ("classification", "regression"):
        raise ValueError(f"{dataset_type} should be within ['classification', 'regression']")
    target = "int" if dataset_type == "classification" else "double"
    return df.withColumns({c: F.col(c).try_cast(target) for c in cols})


def drop_constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the columns of zero variance: one aggregate pass, then a plain projection."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not row[c]])


def _scalar_range(df: DataFrame, cols: Sequence[str]) -> Column:
    """One struct of (lo_<c>, hi_<c>) as an uncorrelated scalar subquery: no join. NaN is a missing value."""
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    stats = df.agg(*[F.min(x[c]).alias(f"lo_{c}") for c in cols], *[F.max(x[c]).alias(f"hi_{c}") for c in cols])
    return stats.select(F.struct(*stats.columns)).scalar()


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) over the values that are there; a constant column becomes 0, null and NaN stay."""
    ranged = df.withColumn("__r", _scalar_range(df, cols))
    scaled = {
        c: F.coalesce(
            F.try_divide(F.col(c).cast("double") - F.col(f"__r.lo_{c}"), F.col(f"__r.hi_{c}") - F.col(f"__r.lo_{c}")),
            F.when(F.col(c).isNotNull(), F.lit(0.0)),
        )
        for c in cols
    }
    return ranged.withColumns(scaled).drop("__r")


# -- aggregates ----------------------------------------------------------------------------------


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null, n_rows), one scan for all columns."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("__n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns])
    return wide.select(F.inline(pairs), F.col("__n").alias("n_rows"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct). One pre-aggregated (column, value) shuffle instead of one per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])
    return (
        df.select(F.inline(pairs))
        .groupBy("column_name", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_name")
        .agg(F.count("v").alias("n_distinct"))
    )


def describe_exact(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, exact interpolated percentiles, max per column, as long rows.

    Spark's exact ``percentile`` keeps every distinct value in one buffer. Here an approximate pass only
    proposes cut points; exact counts between them find the intervals holding the wanted ranks, and
    only those intervals are ranked, after equal values are counted together.
    """
    spark = df.sparkSession
    grid = [i / 256 for i in range(1, 256)]
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"n_{c}"),
            F.percentile_approx(F.col(c).cast("double"), grid, 2000).alias(f"q_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            F.min(c).cast("double").alias(f"min_{c}"),
            F.max(c).cast("double").alias(f"max_{c}"),
        ]
    head = df.agg(*aggs).first()
    binned = Bucketizer(
        splitsArray=[[-math.inf, *sorted(set(head[f"q_{c}"] or [0.0])), math.inf] for c in cols],
        inputCols=[f"v_{c}" for c in cols],
        outputCols=[f"s_{c}" for c in cols],
        handleInvalid="keep",
    ).transform(df.select(*[F.col(c).cast("double").alias(f"v_{c}") for c in cols]))
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"v_{c}").alias("v"), F.col(f"s_{c}").cast("int").alias("slot"))
        for c in cols
    ]
    long = binned.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
    slots = long.groupBy("column_name", "slot").agg(F.count(F.lit(1)).alias("n")).collect()  # <= 256 per column
    wanted = []  # (column, slot, rank inside the slot, global rank)
    for c in cols:
        n = head[f"n_{c}"]
        ranks = {int(f) for p in probs for f in ((n - 1) * p // 1, min((n - 1) * p // 1 + 1, n - 1)) if n}
        before = 0
        for r in sorted((s for s in slots if s["column_name"] == c), key=lambda s: s["slot"]):
            wanted += [(c, r["slot"], k - before, k) for k in ranks if before <= k < before + r["n"]]
            before += r["n"]
    picks = {}
    if wanted:
        want = spark.createDataFrame(wanted, "column_name string, slot int, k long, rank long")
        w = Window.partitionBy("column_name", "slot").orderBy("v")
        inside = (
            long.join(F.broadcast(want.select("column_name", "slot").distinct()), ["column_name", "slot"], "left_semi")
            .groupBy("column_name", "slot", "v")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(w))
        )
        hit = inside.join(F.broadcast(want), ["column_name", "slot"]).where(
            (F.col("k") >= F.col("upto") - F.col("n")) & (F.col("k") < F.col("upto"))
        )
        picks = {(r["column_name"], r["rank"]): r["v"] for r in hit.select("column_name", "rank", "v").collect()}
    rows = []
    for c in cols:
        n = head[f"n_{c}"]
        row = [c, n, head[f"mean_{c}"], head[f"std_{c}"], head[f"min_{c}"]]
        for p in probs:
            if n:
                at = (n - 1) * p
                lo, hi = picks[c, int(at // 1)], picks[c, int(min(at // 1 + 1, n - 1))]
                row.append(lo + (hi - lo) * (at - at // 1))
            else:
                row.append(None)
        rows.append((*row, head[f"max_{c}"]))
    names = ", ".join(f"p{round(p * 100)} double" for p in probs)
    return spark.createDataFrame(
        rows, f"column_name string, n long, mean double, std double, min double, {names}, max double"
    )


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """(column_name, bin, n): equal-width bins between min and max, the last one closed. Null and NaN are in none."""
    ranged = df.withColumn("__r", _scalar_range(df, cols))

    def bin_of(c: str) -> Column:
        width = (F.col(f"__r.hi_{c}") - F.col(f"__r.lo_{c}")) / bins
        at = F.floor(F.try_divide(F.col(c).cast("double") - F.col(f"__r.lo_{c}"), width))
        return F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")

    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), bin_of(c)).alias("bin")) for c in cols]
    )
    return (
        ranged.select(F.inline(cells)).where(F.col("bin").isNotNull())
        .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def grid_count(df: DataFrame, x: str, y: str, category: str, *, width: int = 400, height: int = 400) -> DataFrame:
    """(gx, gy, category, n): points per cell of a width x height grid and category."""
    ranged = df.withColumn("__r", _scalar_range(df, [x, y]))

    def cell(c: str, size: int) -> Column:
        span = F.col(f"__r.hi_{c}") - F.col(f"__r.lo_{c}")
        at = F.floor(F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"__r.lo_{c}"), span), F.lit(0.0)) * size)
        return F.least(at, F.lit(size - 1)).cast("int")

    return (
        ranged.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(cell(x, width).alias("gx"), cell(y, height).alias("gy"), category)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def equalize(cells: DataFrame) -> DataFrame:
    """Histogram-equalised shade per grid cell. Ranks the distinct counts, of which a grid has few."""
    per_cell = cells.groupBy("gx", "gy").agg(F.sum("n").alias("n"))
    levels = per_cell.groupBy("n").agg(F.count(F.lit(1)).alias("cells"))
    w = Window.orderBy("n")  # distinct counts of at most width x height cells
    shade = levels.select(
        "n", (F.sum("cells").over(w) / F.sum("cells").over(Window.partitionBy())).alias("shade")
    )
    return per_cell.join(shade, "n").select("gx", "gy", "n", "shade")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_keys, n_duplicates): later copies of an earlier key count as duplicates."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
            (F.sum("n") - F.count(F.lit(1))).alias("n_duplicates"),
        )
    )


def cluster_size_report(clusters: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Sizes with the reported thresholds: one row of counts over all clusters."""
    sizes = clusters.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.max("n").alias("largest"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") > 5).alias("over_5"),
        F.count_if(F.col("n") > 25).alias("over_25"),
        F.count_if(F.col("n") > 100).alias("over_100"),
    )


def score_mean_std(df: DataFrame, by: str, score: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


# -- keyed joins and codes -----------------------------------------------------------------------


def attach(left: DataFrame, right: DataFrame, id_col: str, how: str = "inner") -> DataFrame:
    """Labels or vectors to rows by key, in place of alignment by position."""
    return left.join(right, id_col, how)


def dedupe_keep_first(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """The row of lowest id per key; a null key is a key, a null id is the highest.

    Where rows of a key share its lowest id, all of them stay; an id on rows of several keys is judged for each key.
    Only a digest of the key and the id are aggregated, before the shuffle too, so hot keys stay small and long keys
    aren't carried; the rows come back by digest and id.
    """
    digest = F.coalesce(F.sha2(F.col(key).cast("string"), 256), F.lit(""))
    first = df.groupBy(digest.alias("__k")).agg(F.min(id_col).alias("__id"))
    held = df.withColumn("__d", digest)
    return held.join(first, (F.col("__d") == F.col("__k")) & held[id_col].eqNullSafe(first["__id"]), "left_semi").select(*df.columns)


def factorize(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """(value, code): codes 0.. in order of first appearance by id."""
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(id_col).alias("__first"))
    return range_positions(firsts, [F.col("__first")]).select(col, F.col("position").alias("code"))


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): codes 0.. in sorted order of the values."""
    values = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.lit(1).alias("__one"))
    return range_positions(values, [F.col(col)]).select(col, F.col("position").alias("code"))


def prefix_metrics(metrics: Mapping[str, Column], prefix: str) -> Column:
    """A map column of metrics with every key prefixed."""
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]
    return F.transform_keys(F.create_map(*pairs), lambda k, _: F.concat(F.lit(prefix), k))
