"""Pooling of token vectors, and matrices within one record."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, by: str, vec: str, mask: str | None = None) -> DataFrame:
    """(by, pooled): element-wise mean of the vectors of a key, weighted by ``mask``.

    Sums are combined before the shuffle, so a key with any number of tokens sends one row per task.
    """
    v = array_to_vector(F.col(vec).cast("array<double>"))
    if mask is None:
        pooled = df.groupBy(by).agg(Summarizer.mean(v).alias("m"))
        return pooled.select(by, vector_to_array("m").alias("pooled"))
    w = F.col(mask).cast("double")
    out = df.groupBy(by).agg(Summarizer.sum(v, w).alias("s"), F.greatest(F.sum(w), F.lit(1e-9)).alias("n"))
    return out.select(by, F.transform(vector_to_array("s"), lambda x: x / F.col("n")).alias("pooled"))


def layer_sum(layers: Column, picked: Sequence[int]) -> Column:
    """Element-wise sum of the picked layers of an array of arrays."""
    out = F.element_at(layers, picked[0])
    for k in picked[1:]:
        out = F.zip_with(out, F.element_at(layers, k), lambda a, b: a + b)
    return out


def coulomb_matrix(atoms: Column) -> Column:
    """Rows of 0.5 Z^2.4 (diagonal) and Zi Zj / Rij of an array of (z, px, py, pz), within the record."""

    def entry(a: Column, i: Column, b: Column, j: Column) -> Column:
        sq = sum(((a[c] - b[c]) * (a[c] - b[c]) for c in ("px", "py", "pz")), F.lit(0.0))
        return F.when(i == j, F.lit(0.5) * F.pow(a["z"], F.lit(2.4))).otherwise(F.try_divide(a["z"] * b["z"], F.sqrt(sq)))

    return F.transform(atoms, lambda a, i: F.transform(atoms, lambda b, j: entry(a, i, b, j)))


def sorted_eigenvalues(df: DataFrame, id_col: str, matrix_col: str) -> DataFrame:
    """(id, values): eigenvalues of the symmetric matrix of each record, largest absolute value first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rows in b[matrix_col]:
                values = np.linalg.eigvalsh(np.array([np.asarray(r, dtype=float) for r in rows]))
                out.append(values[np.argsort(-np.abs(values), kind="stable")])
            yield pd.DataFrame({id_col: b[id_col], "values": out})

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, matrix_col).mapInPandas(run, f"`{id_col}` {id_type}, values array<double>")


def pad(values: Column, width: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(values), F.lit(0))))
