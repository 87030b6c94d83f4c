"""Joins over vectors: pairs within a distance, nearest neighbours, copies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectile.functions import vectors as vx
from vectile.operators.blocks import EXACT_VALUES, TILE, Tiles, block_pairs, exact_pairs, map_block_pairs, pairwise, tile

SLACK = 1e-7  # the matrix form of a distance may be off by this much; candidates are then measured exactly


def collapse_copies(df: DataFrame, id_col: str, key_col: str) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): equal values count once, under their highest id.

    Representatives carry ``copies``; members map every id to its representative. A group of copies, of
    whatever size, then meets the pair work as one row, and never as all pairs among its members.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), F.md5(F.to_json(F.struct(key_col))).alias("h"))
    reps = keyed.groupBy("h").agg(
        F.max("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("key").alias(key_col)
    )
    members = keyed.select("id", "h").join(reps.select("h", "rep"), "h").select("id", "rep")
    return reps.select(F.col("rep").alias("id"), key_col, "copies"), members


def pairs_within(tiles: Tiles, radius: float, *, weight: str | None = None, measures: Sequence[str] = ()) -> DataFrame:
    """(i, j, d) with i < j and d <= radius, each pair once.

    With ``weight``, an extra column of the tiles, pairs carry the product of their weights as ``n_pairs``; with
    ``measures`` also the named distances. Both are made where the vectors are, so that no pair has to be joined with them.
    """
    metric, p = tiles.metric, tiles.p
    slack = SLACK * max(1.0, abs(radius))

    def close(left, right, same) -> Iterator[pd.DataFrame]:
        (la, a), (lb, b) = left, right
        ia, ib = la["id"].to_numpy(), lb["id"].to_numpy()
        for s in range(0, len(a), TILE):
            part = a[s : s + TILE]
            x, y = np.nonzero(pairwise(metric, part, b, p) <= radius + slack)
            if same:
                keep = ia[s + x] < ib[y]
                x, y = x[keep], y[keep]
            d = exact_pairs(metric, part, x, b, y, p)
            keep = d <= radius
            x, y, d = x[keep], y[keep], d[keep]
            i, j = ia[s + x], ib[y]
            found = {"i": np.minimum(i, j), "j": np.maximum(i, j), "d": d}
            if weight:
                found["n_pairs"] = la[weight].to_numpy()[s + x] * lb[weight].to_numpy()[y]
            step = max(1, EXACT_VALUES // max(a.shape[1], 1)) if measures else max(1, len(d))
            for t in range(0, len(d), step):
                z = slice(t, t + step)
                more = vx.distances_of(measures, part[x[z]], b[y[z]], p=p) if measures else {}
                yield pd.DataFrame({k: v[z] for k, v in found.items()} | more)

    space_radius = np.sqrt(radius) if metric == "sqeuclidean" else radius
    pairs = block_pairs(tiles, tiles.near_cells(space_radius))
    schema = "i long, j long, d double" + (", n_pairs long" if weight else "") + "".join(f", `{m}` double" for m in measures)
    return map_block_pairs(tiles.points, pairs, close, schema)


def similarity_join(
    df: DataFrame, id_col: str, vec_col: str, radius: float, *, metric: str = "euclidean", p: float = 3.0,
    weight: str | None = None, measures: Sequence[str] = (),
) -> DataFrame:
    """All pairs of rows within ``radius``, i < j.

    Rows that may repeat go through ``collapse_copies`` first, or every pair of copies is a result.
    """
    tiles = tile(df, id_col, vec_col, metric=metric, p=p, extra=[weight] if weight else [])
    return pairs_within(tiles, radius, weight=weight, measures=measures)


def pairs_of_copies(reps: DataFrame, *more: Column) -> DataFrame:
    """(id, id, 0, n_pairs, ...): a row for the pairs within each group of copies."""
    n = F.col("copies")
    return reps.where(n > 1).select(
        F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"), (n * (n - 1) / 2).cast("bigint").alias("n_pairs"), *more
    )


def weighted_pairs(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between representatives with ``n_pairs``: the pairs of rows each stands for.

    A group of copies adds one row (id, id, 0) for the pairs within it, so that nothing is lost and no group of
    copies is written out as all its pairs. ``reps`` and its members come from ``collapse_copies``.
    """
    if "n_pairs" in edges.columns:  # weighed where they were found
        return edges.unionByName(pairs_of_copies(reps))
    copies = reps.select("id", "copies")
    ends = edges.join(copies.toDF("i", "ci"), "i").join(copies.toDF("j", "cj"), "j")
    across = ends.select("i", "j", "d", (F.col("ci") * F.col("cj")).alias("n_pairs"))
    return across.unionByName(pairs_of_copies(reps))


def both_ways(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Ordered pairs; with ``ids``, the zero diagonal too. The sparse form of a square distance matrix."""
    out = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    if ids is not None:
        out = out.unionByName(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))
    return out


def knn_join(
    df: DataFrame, id_col: str, vec_col: str, k: int = 15, *, metric: str = "euclidean", p: float = 3.0
) -> DataFrame:
    """(i, j, d, rank): the k nearest other rows of each row; equal distances go to the lower id."""
    return knn_tiles(tile(df, id_col, vec_col, metric=metric, p=p, keep_nearest=k), k)


def knn_tiles(tiles: Tiles, k: int) -> DataFrame:
    metric, p = tiles.metric, tiles.p

    def nearest(ia, a, ib, b, same) -> Iterator[pd.DataFrame]:
        for s in range(0, len(a), TILE):
            part = a[s : s + TILE]
            d = pairwise(metric, part, b, p)
            if same:
                d[np.arange(len(part)), s + np.arange(len(part))] = np.inf
            if d.shape[1] > k:
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                x, y = np.nonzero(d <= kth + SLACK * np.maximum(1.0, np.abs(kth)))
            else:
                x, y = np.nonzero(np.isfinite(d))
            if same:
                off = ia[s + x] != ib[y]
                x, y = x[off], y[off]
            exact = exact_pairs(metric, part, x, b, y, p)
            order = np.lexsort((ib[y], exact, x))
            x, y, exact = x[order], y[order], exact[order]
            start = np.searchsorted(x, x, side="left")
            keep = np.arange(len(x)) - start < k
            yield pd.DataFrame({"i": ia[s + x[keep]], "j": ib[y[keep]], "d": exact[keep]})

    def run(left, right, same) -> Iterator[pd.DataFrame]:
        (la, a), (lb, b) = left, right
        ia, ib = la["id"].to_numpy(), lb["id"].to_numpy()
        yield from nearest(ia, a, ib, b, same)
        if not same:
            yield from nearest(ib, b, ia, a, False)

    pairs = block_pairs(tiles, tiles.neighbour_cells(k))
    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["i", "d", "j"])
        return found[found.groupby("i").cumcount() < k]

    found = map_block_pairs(tiles.points, pairs, run, "i long, j long, d double", merge=best)
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
