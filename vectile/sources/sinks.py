"""Writers: delimited text, vectors as text, one folder per split or fold, the metric log."""

from __future__ import annotations

import dataclasses
import lzma
import re
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, escape='"', mode="errorifexists")
    return path


def write_vectors_csv(df: DataFrame, path: str, vector_col: str) -> str:
    """CSV has no arrays: the vector travels as JSON text."""
    return write_csv(df.withColumn(vector_col, F.to_json(vector_col)), path)


def read_vectors_csv(spark: SparkSession, path: str, schema: str, vector_col: str, vector_type: str) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True, escape='"')
    return df.withColumn(vector_col, F.from_json(vector_col, vector_type))


def write_parts(df: DataFrame, path: str, part_col: str) -> str:
    """One folder per split or fold. Rows stay where they are: no group is gathered into one task."""
    df.write.partitionBy(part_col).csv(path, header=True, escape='"')
    return path


def write_archives(df: DataFrame, path: str, columns: Sequence[str]) -> int:
    """One xz-compressed tab-separated file per partition, streamed; returns the rows written.

    The file name is the partition number, so a task that is run again replaces its own file.
    """
    local = re.sub("^file:/*", "/", path)
    base = f"file://{local}" if local.startswith("/") else path

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        n = 0
        with (
            fs.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():05d}.tsv.xz") as raw,
            lzma.open(raw, "wb") as xz,
        ):
            xz.write(("\t".join(columns) + "\n").encode())
            for b in batches:
                xz.write(b.to_csv(sep="\t", index=False, header=False).encode())
                n += len(b)
        yield pd.DataFrame({"n": [n]})

    written = df.select(*columns).mapInPandas(pack, "n long").agg(F.sum("n")).first()[0]
    return written or 0


def write_scores_json(scores: DataFrame, folder: str, name: str, *, at: datetime | None = None) -> str:
    """Write scores as JSON lines into a folder of their own, named after ``name`` and the time; returns its path."""
    stamp = (at or datetime.now(UTC)).strftime("%Y-%m-%d-%H-%M-%S-%f")
    path = f"{folder.rstrip('/')}/{name}-{stamp}"
    scores.write.json(path, mode="errorifexists")
    return path


def log_metrics(metrics: DataFrame, path: str, run_id: str | Column) -> str:
    """Append (param, param_value, metric, value) rows of one run, or of the run that a column names."""
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return path


def log_config(spark: SparkSession, config, path: str, run_id: str) -> str:
    """One row per field of a dataclass configuration, beside the metrics of the run."""
    rows = [(k, str(v)) for k, v in dataclasses.asdict(config).items()]
    frame = spark.createDataFrame(rows, "field string, value string").withColumn("run_id", F.lit(run_id))
    frame.write.mode("append").partitionBy("run_id").parquet(path)
    return path
