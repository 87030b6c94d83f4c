"""Exact-size draws, splits and folds. All repeatable: the order is md5(id:seed), never ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.operators.ranking import hash_positions, range_positions, take_lowest

FOLD_SEED = 69  # fixed value: the seed of the six-fold deal
N_FOLDS = 6  # fixed value


def sample_exact(df: DataFrame, id_col: str, n: int | None = None, *, seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows without replacement; every row when ``n`` is None."""
    if n is None:
        return df
    if strict and (have := df.count()) < n:
        raise ValueError(f"cannot draw {n} rows from {have}")
    return take_lowest(df, id_col, n, seed=seed)


def sample_per_group(df: DataFrame, id_col: str, group_col: str, quota: int, *, seed: int = 42) -> DataFrame:
    """``quota`` rows of each group (all of a smaller group)."""
    return take_lowest(df, id_col, quota, seed=seed, by=[group_col])


def shuffle_rank(df: DataFrame, id_col: str, *, seed: int = 42) -> DataFrame:
    """A full repeatable shuffle, as a ``position`` column."""
    return hash_positions(df, id_col, seed=seed).drop("total")


def split_fractions(
    df: DataFrame, id_col: str, *, train: float = 0.8, valid: float = 0.1, seed: int = 42
) -> DataFrame:
    """``split`` = train / valid / test, cut at int(train*n) and int((train+valid)*n) of the shuffled order."""
    pos, n = F.col("position"), F.col("total").cast("double")
    upper = round(train + valid, 12)
    return (
        hash_positions(df, id_col, seed=seed)
        .withColumn(
            "split",
            F.when(pos < F.floor(n * train), "train").when(pos < F.floor(n * upper), "valid").otherwise("test"),
        )
        .drop("position", "total")
    )


def split_train_test(df: DataFrame, id_col: str, *, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = train / test with ceil(test_size*n) test rows."""
    cut_at = F.ceil(F.col("total").cast("double") * test_size)
    return (
        hash_positions(df, id_col, seed=seed)
        .withColumn("split", F.when(F.col("position") < cut_at, "test").otherwise("train"))
        .drop("position", "total")
    )


def deal_folds(df: DataFrame, id_col: str, *, folds: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """Shuffle, then deal round-robin: fold sizes differ by at most one."""
    return (
        hash_positions(df, id_col, seed=seed)
        .withColumn("fold", (F.col("position") % folds).cast("int"))
        .drop("position", "total")
    )


def fold_experiments(folds: DataFrame, id_col: str) -> DataFrame:
    """Five (experiment, id, role) sets: the last fold is always test, fold i is valid in experiment i."""
    last = N_FOLDS - 1
    return folds.select(
        F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("experiment"),
        id_col,
        "fold",
    ).select(
        "experiment",
        id_col,
        F.when(F.col("fold") == last, "test")
        .when(F.col("fold") == F.col("experiment"), "valid")
        .otherwise("train")
        .alias("role"),
    )


def split_fixed_cv(df: DataFrame, id_col: str) -> DataFrame:
    """Folds 0-4 train, fold 5 test, no valid part."""
    return (
        deal_folds(df, id_col)
        .withColumn("split", F.when(F.col("fold") == N_FOLDS - 1, "test").otherwise("train"))
        .drop("fold")
    )


def _block_fold(pos: Column, n: Column, k: int) -> Column:
    """Contiguous blocks; the first n % k blocks are one row longer."""
    small = F.floor(n / k)
    extra = n % k
    head = extra * (small + 1)
    return F.when(pos < head, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor((pos - head) / F.greatest(small, F.lit(1)))
    ).cast("int")


def kfold(df: DataFrame, id_col: str, *, k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """k contiguous folds of the id order, or of the shuffled order."""
    ranked = hash_positions(df, id_col, seed=seed) if shuffle else range_positions(df, [F.col(id_col)])
    return ranked.withColumn("fold", _block_fold(F.col("position"), F.col("total"), k)).drop("position", "total")


def split_by_group(
    df: DataFrame, id_col: str, group_col: str, *, train: float = 0.8, valid: float = 0.1
) -> DataFrame:
    """No group on two sides. Groups go by size, largest first, into the first part with room.

    Within one size the fill is a run: so many groups still fit train, then so many fit valid, the rest
    is test. Only the distinct sizes with their multiplicity (at most sqrt(2n) rows) visit the driver.
    """
    spark = df.sparkSession
    groups = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("__size"), F.min(id_col).alias("__first"))
    sizes = groups.groupBy("__size").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("__size")).collect()
    n = sum(r["__size"] * r["m"] for r in sizes)
    room_train, room_both = train * n, round(train + valid, 12) * n
    n_train = n_valid = 0
    runs, before = [], 0
    for r in sizes:
        size, m = r["__size"], r["m"]
        t = min(m, max(0, int((room_train - n_train) // size)))
        n_train += t * size
        v = min(m - t, max(0, int((room_both - n_train - n_valid) // size)))
        n_valid += v * size
        runs.append((size, before, t, v))
        before += m
    ranked = range_positions(groups, [F.desc("__size"), F.desc("__first")])
    plan = spark.createDataFrame(runs, "__size long, __before long, __t long, __v long")
    k = F.col("position") - F.col("__before")
    placed = ranked.join(F.broadcast(plan), "__size").select(
        F.col(group_col).alias("__g"),
        F.when(k < F.col("__t"), "train").when(k < F.col("__t") + F.col("__v"), "valid").otherwise("test").alias("split"),
    )
    return df.join(placed, F.col(group_col).eqNullSafe(F.col("__g"))).drop("__g")
