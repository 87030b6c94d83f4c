"""Blocked pair work over vectors: the base of range joins, neighbour joins, spanning trees and scores.

Rows are cut into blocks of bounded size and each task works on one pair of blocks with matrix
arithmetic, handing on only what passes (close pairs, top-k, partial sums). A block lies within one cell
of nearest-pivot space, so a pair of cells whose distance bound exceeds the search radius is never
scheduled; a hot cell, even one with a third of all rows, is simply many blocks. Nothing on the driver
grows with the data but the cell statistics, and there are at most ``MAX_CELLS`` cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectile.session import cut

MAX_CELLS = 256
MAX_BLOCK_ROWS = 8192  # rows of a block that are compared together
SHARES = 16  # a long table is cut into about so many blocks: each goes to the tasks of all others
BLOCK_VALUES = 4_000_000  # matrix values per block, whatever the vector width
EXACT_VALUES = 4_000_000  # vector values of candidate pairs measured at once
TILE = 512  # rows of a block compared at once
EPS = 1e-9
METRIC_SPACES = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski", "hamming", "jaccard", "canberra")


def pairwise(metric: str, a: np.ndarray, b: np.ndarray, p: float = 3.0) -> np.ndarray:
    """Distance matrix between the rows of two arrays."""
    if metric in ("euclidean", "sqeuclidean"):
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        np.maximum(sq, 0.0, out=sq)
        return np.sqrt(sq) if metric == "euclidean" else sq
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (a @ b.T) / norm
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):  # one row against a block: memory stays at one block
        gap = np.abs(b - row)
        if metric == "cityblock":
            out[i] = gap.sum(1)
        elif metric == "chebyshev":
            out[i] = gap.max(1)
        elif metric == "minkowski":
            out[i] = (gap**p).sum(1) ** (1.0 / p)
        elif metric == "hamming":
            out[i] = (gap != 0).mean(1)
        elif metric == "jaccard":
            either = ((b != 0) | (row != 0)).sum(1)
            out[i] = np.where(either > 0, ((gap != 0).sum(1)) / np.maximum(either, 1), 0.0)
        elif metric == "canberra":
            size = np.abs(b) + np.abs(row)
            out[i] = np.divide(gap, size, out=np.zeros_like(gap), where=size > 0).sum(1)
        elif metric == "braycurtis":
            with np.errstate(invalid="ignore", divide="ignore"):
                out[i] = gap.sum(1) / np.abs(b + row).sum(1)
        else:
            raise ValueError(f"unknown metric {metric}")
    return out


def exact_rows(metric: str, a: np.ndarray, b: np.ndarray, p: float = 3.0) -> np.ndarray:
    """Distances of aligned rows, without the cancellation of the matrix form."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    if metric == "sqeuclidean":
        return ((a - b) ** 2).sum(1)
    if not len(a):
        return np.zeros(0)
    return np.concatenate([pairwise(metric, a[i : i + 1], b[i : i + 1], p)[0] for i in range(len(a))])


def exact_pairs(
    metric: str, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, p: float = 3.0
) -> np.ndarray:
    """Distances of a[x] to b[y], a slice at a time: a block of copies makes every pair a candidate."""
    if not len(x):
        return np.zeros(0)
    step = max(1, EXACT_VALUES // max(a.shape[1], 1))
    return np.concatenate([exact_rows(metric, a[x[s : s + step]], b[y[s : s + step]], p) for s in range(0, len(x), step)])


@dataclass(frozen=True)
class Cell:
    code: int
    rows: int
    radius: float
    first_block: int
    blocks: int
    nearest: tuple[float, ...]  # smallest distances to the pivot, for neighbour bounds


@dataclass(frozen=True)
class Tiles:
    """``points``: id, vec, extra columns, block. ``gaps``: pivot distances, or None when pruning is off."""

    points: DataFrame
    cells: tuple[Cell, ...]
    gaps: np.ndarray | None
    metric: str
    p: float
    near: DataFrame | None = None  # (i, j, d) of some nearest rows of every row, where they are known

    def near_cells(self, radius: float) -> list[tuple[Cell, Cell]]:
        """Unordered cell pairs that can hold a pair within ``radius``."""
        out = []
        for x, a in enumerate(self.cells):
            for b in self.cells[x:]:
                if self.gaps is None or self._least(a, b) <= radius + EPS:
                    out.append((a, b))
        return out

    def _least(self, a: Cell, b: Cell) -> float:
        return max(0.0, self.gaps[a.code, b.code] - a.radius - b.radius)

    def neighbour_cells(self, k: int) -> list[tuple[Cell, Cell]]:
        """Unordered cell pairs that can hold one of the k nearest neighbours of either side.

        For each cell, the k-th smallest of (own radius + pivot gap + a point's reach) bounds the k-th
        distance of all its points; a farther cell cannot contribute.
        """
        if self.gaps is None:
            return self.near_cells(math.inf)
        bound = {}
        for a in self.cells:
            reach = sorted(a.radius + self.gaps[a.code, b.code] + r for b in self.cells for r in b.nearest)
            bound[a.code] = reach[k] if len(reach) > k else math.inf  # rank k: the point itself is rank 0
        return [
            (a, b)
            for x, a in enumerate(self.cells)
            for b in self.cells[x:]
            if self._least(a, b) <= max(bound[a.code], bound[b.code]) + EPS
        ]


def tile(
    df: DataFrame, id_col: str, vec_col: str, *, extra: Sequence[str] = (), metric: str = "euclidean", p: float = 3.0,
    keep_nearest: int = 0, block_rows: int | None = None, n_cells: int | None = None,
) -> Tiles:
    """Write (id, vec, extra, cell) once, then number the blocks from the cell sizes."""
    kind = "array<float>" if df.select(vec_col).dtypes[0][1] == "array<float>" else "array<double>"  # floats travel as floats
    points = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("vec"), *extra).where(F.col("vec").isNotNull())
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return Tiles(points.withColumns({"cell": F.lit(0), "block": F.lit(0)}), (), None, metric, p)
    most = max(64, BLOCK_VALUES // max(width, 1))
    rows = block_rows or min(most, max(64, min(MAX_BLOCK_ROWS, math.ceil(n / 8)), math.ceil(n / SHARES)))
    prune = metric in METRIC_SPACES
    want = n_cells or min(MAX_CELLS, max(1, n // (4 * rows if rows <= MAX_BLOCK_ROWS else 2 * rows)))
    pivots = np.zeros((1, width))
    if prune and want > 1:
        drawn = points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(want).select("vec").collect()
        pivots = np.unique(np.array([r["vec"] for r in drawn]), axis=0)
    # sqeuclidean is not a metric: its cells are built, and bounded, on the euclidean distance
    space = "euclidean" if metric == "sqeuclidean" else metric
    if len(pivots) == 1 or not prune:
        placed = points.withColumns({"cell": F.lit(0), "reach": F.lit(0.0)})
        prune = False
    else:

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    d = pairwise(space, matrix(b["vec"]), pivots, p)
                    cell = d.argmin(1)
                    yield b.assign(cell=cell.astype("int32"), reach=d[np.arange(len(b)), cell])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        placed = points.mapInPandas(assign, f"{schema}, cell int, reach double")
    placed = cut(placed)
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("reach").alias("radius")).collect()
    near: dict[int, list[float]] = {}
    if prune and keep_nearest:
        w = Window.partitionBy("cell").orderBy("reach", "id")
        for r in (
            placed.select("cell", "reach", F.row_number().over(w).alias("rn"))
            .where(F.col("rn") <= keep_nearest + 1)
            .collect()  # at most MAX_CELLS * (k + 1) numbers
        ):
            near.setdefault(r["cell"], []).append(r["reach"])
    cells, at = [], 0
    for r in sorted(stats, key=lambda s: s["cell"]):
        k = math.ceil(r["rows"] / rows)
        cells.append(Cell(r["cell"], r["rows"], r["radius"], at, k, tuple(near.get(r["cell"], ()))))
        at += k
    first = [0] * len(pivots)
    count = [1] * len(pivots)
    for c in cells:
        first[c.code], count[c.code] = c.first_block, c.blocks
    slot = F.pmod(F.xxhash64("id"), F.element_at(F.lit(count).cast("array<long>"), F.col("cell") + 1))
    block = (F.element_at(F.lit(first).cast("array<long>"), F.col("cell") + 1) + slot).cast("int")
    gaps = pairwise(space, pivots, pivots, p) if prune else None
    return Tiles(placed.withColumn("block", block).drop("reach"), tuple(cells), gaps, metric, p)


def block_pairs(tiles: Tiles, cell_pairs: Sequence[tuple[Cell, Cell]]) -> DataFrame:
    """(bi, bj) with bi <= bj: the block pairs of the given cell pairs, expanded on the executors."""
    spark = tiles.points.sparkSession
    rows = [(a.first_block, a.first_block + a.blocks - 1, b.first_block, b.first_block + b.blocks - 1) for a, b in cell_pairs]
    frame = spark.createDataFrame(rows, "a0 int, a1 int, b0 int, b1 int")
    if sum(a.blocks for a, _ in cell_pairs) > 10_000:
        frame = frame.withColumn("bi", F.explode(F.sequence("a0", "a1"))).repartition("bi")
    else:
        frame = frame.withColumn("bi", F.explode(F.sequence("a0", "a1")))
    return frame.withColumn("bj", F.explode(F.sequence("b0", "b1"))).where("bi <= bj").select("bi", "bj")


Side = tuple[pd.DataFrame, np.ndarray]


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows as doubles; sums of floats would lose digits."""
    return np.stack(vectors.to_numpy()).astype(float, copy=False)


def map_block_pairs(
    points: DataFrame, pairs: DataFrame, fn: Callable[[Side, Side, bool], Iterator[pd.DataFrame]], schema: str, *, split: bool = True,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Bring each pair of blocks together in one group of at most two blocks, and run ``fn`` on it.

    ``fn(left, right, same)`` gets each side as (frame without vectors, matrix) and yields result frames,
    so a dense pair streams out in parts. A long block is handed to it ``MAX_BLOCK_ROWS`` rows at a time (whole, without
    ``split``): the blocks say how often a row travels, these parts how much memory its comparisons take.
    """
    most = MAX_BLOCK_ROWS if split else 1 << 62
    left = points.join(pairs, points["block"] == pairs["bi"]).withColumn("__side", F.lit(0))
    right = points.join(pairs.where("bi < bj"), points["block"] == F.col("bj")).withColumn("__side", F.lit(1))
    both = left.unionByName(right).drop("block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        sides: list[list[Side]] = []
        for s in (0, 1):
            part = pdf[pdf["__side"] == s]
            sides.append([])
            for at in range(0, len(part), most):
                rows = part.iloc[at : at + most]
                sides[s].append((rows.drop(columns="vec").reset_index(drop=True), matrix(rows["vec"])))
        same = bool(pdf["bi"].iat[0] == pdf["bj"].iat[0])
        del pdf, part
        held: list[pd.DataFrame] = []
        for x, left in enumerate(sides[0]):
            for right in sides[0][x:] if same else sides[1]:
                found = fn(left, right, same and right is left)
                if merge is None:
                    yield from found
                    continue
                held += [f for f in found if len(f)]
                if held:
                    held = [merge(pd.concat(held, ignore_index=True))]
        yield from held

    return both.groupBy("bi", "bj").applyInPandas(run, schema)
