"""Vector expressions: named distances between two array columns, and pooling helpers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def _diff(a: Column, b: Column, fn) -> Column:
    return F.zip_with(a, b, fn)


def distance(metric: str, a: Column, b: Column, *, p: float = 3.0) -> Column:
    """The named distance between two array<double> columns of equal length."""
    if metric == "sqeuclidean":
        return total(_diff(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "euclidean":
        return F.sqrt(distance("sqeuclidean", a, b))
    if metric == "cityblock":
        return total(_diff(a, b, lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.array_max(_diff(a, b, lambda x, y: F.abs(x - y)))
    if metric == "minkowski":
        return F.pow(total(_diff(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))
    if metric == "cosine":
        return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    if metric == "correlation":
        n = F.size(a).cast("double")
        sa, sb = total(a), total(b)
        cov = dot(a, b) - sa * sb / n
        return F.lit(1.0) - F.try_divide(cov, F.sqrt((dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n)))
    if metric == "hamming":
        return F.try_divide(total(_diff(a, b, lambda x, y: (x != y).cast("double"))), F.size(a).cast("double"))
    if metric == "jaccard":
        differ = total(_diff(a, b, lambda x, y: ((x != y) & ((x != 0) | (y != 0))).cast("double")))
        either = total(_diff(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")))
        return F.coalesce(F.try_divide(differ, either), F.lit(0.0))
    if metric == "canberra":
        return total(_diff(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))))
    if metric == "braycurtis":
        up = total(_diff(a, b, lambda x, y: F.abs(x - y)))
        return F.try_divide(up, total(_diff(a, b, lambda x, y: F.abs(x + y))))
    raise ValueError(f"{metric} should be within {METRICS}")


def _ratio(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Null (NaN) where there is nothing to divide by, as ``try_divide`` gives."""
    return np.divide(up, down, out=np.full(np.shape(up), np.nan), where=down != 0)


def distances_of(metrics: Sequence[str], a: np.ndarray, b: np.ndarray, *, p: float = 3.0) -> dict[str, np.ndarray]:
    """What ``distance`` gives, for the aligned rows of two arrays; NaN stands for null."""
    gap, up = a - b, np.abs(a - b)
    squares, apart = (gap * gap).sum(1), a != b
    either = (a != 0) | (b != 0)
    n, sa, sb, ab = a.shape[1], a.sum(1), b.sum(1), (a * b).sum(1)
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    size = np.abs(a) + np.abs(b)
    made = {
        "euclidean": lambda: np.sqrt(squares),
        "sqeuclidean": lambda: squares,
        "cityblock": lambda: up.sum(1),
        "chebyshev": lambda: up.max(1),
        "minkowski": lambda: (up**p).sum(1) ** (1.0 / p),
        "cosine": lambda: 1.0 - _ratio(ab, np.sqrt(aa * bb)),
        "correlation": lambda: 1.0 - _ratio(ab - sa * sb / n, np.sqrt((aa - sa * sa / n) * (bb - sb * sb / n))),
        "hamming": lambda: apart.sum(1) / n,
        "jaccard": lambda: np.nan_to_num(_ratio((apart & either).sum(1).astype(float), either.sum(1).astype(float))),
        "canberra": lambda: np.divide(up, size, out=np.zeros_like(up), where=size != 0).sum(1),
        "braycurtis": lambda: _ratio(up.sum(1), np.abs(a + b).sum(1)),
    }
    with np.errstate(invalid="ignore"):
        return {m: made[m]() for m in metrics}


METRICS = (
    "euclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski", "cosine", "correlation", "hamming", "jaccard",
    "canberra", "braycurtis",
)
