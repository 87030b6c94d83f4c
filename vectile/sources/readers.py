"""Readers: delimited text, archives, one-record files, family loaders, the dataset catalog."""

from __future__ import annotations

import lzma
import re
import tarfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.functions.keys import order_key, unit_float
from vectile.functions.text import is_valid_text
from vectile.operators.ranking import take_lowest
from vectile.operators.sampling import sample_exact, split_by_group, split_fractions

# -- delimited text ------------------------------------------------------------------------------


def read_csv(
    spark: SparkSession, path: str, schema: str, *, names: Sequence[str] | None = None,
    columns: Sequence[str] | None = None, sep: str = ",",
) -> DataFrame:
    """CSV with a header and a given schema. ``names`` renames by position, ``columns`` prunes the scan."""
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, escape='"')
    if columns:
        df = df.select(*columns)
    return df.toDF(*names) if names else df


def read_archive(spark: SparkSession, path: str, columns: Sequence[str], *, sep: str = "\t") -> DataFrame:
    """Tab-separated members of .xz and .tar.xz files, all columns as text. One task per archive.

    xz cannot be split, so the archive is the unit. Only its path is a row; the task opens it and decompresses it
    as a stream, in batches of rows, so its size doesn't matter.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                fs, inner = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                plain = lzma.open(fs.open_input_file(unquote(inner)))  # Spark names files by their encoded path
                if name.endswith(".tar.xz"):
                    with tarfile.open(fileobj=plain, mode="r:") as tar:
                        for member in tar:
                            if member.isfile():
                                yield from _frames(tar.extractfile(member))
                else:
                    yield from _frames(plain)

    def _frames(stream) -> Iterator[pd.DataFrame]:
        yield from pd.read_csv(
            stream, sep=sep, dtype=str, names=list(columns), header=0, chunksize=8192, keep_default_na=False
        )

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def file_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path").agg(F.count(F.lit(1)).alias("n_files"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One molecule per file -> (path, n_atoms, atoms, smiles, props).

    Line 0 is the atom count, line 1 the properties from its third token on, then one line per atom
    (element, x, y, z, charge), the frequencies, and the SMILES line. ``*^`` stands for ``e`` in numbers.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    tokens = "[ \\t]+"

    def number(c: Column) -> Column:
        return F.replace(c, F.lit("*^"), F.lit("e")).try_cast("double")

    def atom(line: Column) -> Column:
        part = F.split(F.trim(line), tokens)
        return F.struct(
            part[0].alias("element"), number(part[1]).alias("x"), number(part[2]).alias("y"), number(part[3]).alias("z")
        )

    lines = files.select(F.col("_metadata.file_path").alias("path"), F.split("value", "\\r?\\n").alias("line"))
    counted = lines.withColumn("n_atoms", F.trim(F.col("line")[0]).try_cast("int")).where(F.col("n_atoms").isNotNull())
    props = F.split(F.trim(F.col("line")[1]), tokens)
    return counted.select(
        "path",
        "n_atoms",
        F.transform(F.slice("line", F.lit(3), F.col("n_atoms")), atom).alias("atoms"),
        F.split(F.trim(F.try_element_at("line", F.col("n_atoms") + 4)), tokens)[0].alias("smiles"),
        F.transform(F.slice(props, 3, F.greatest(F.size(props) - 2, F.lit(0))), number).alias("props"),
    )


# -- loaders over tables -------------------------------------------------------------------------


def load_family(
    df: DataFrame, id_col: str, *, sample_size: int | None = None, seed: int = 42, interacted_only: bool = False,
) -> DataFrame:
    """(id, text, labels): optionally the positive rows only, optionally an exact sample."""
    rows = df.where(F.col("labels") == 1) if interacted_only else df
    return sample_exact(rows, id_col, sample_size, seed=seed)


def load_multi_family(
    df: DataFrame, id_col: str, family_col: str, families: Sequence[str], *, sample_size: int = 3000, seed: int = 42,
    convert_labels: bool = False, strict: bool = False,
) -> DataFrame:
    """int(sample_size / families) positive rows of each family, labelled by family, in one pass.

    A family with fewer positive rows gives all it has; with ``strict`` it is an error.
    """
    names = sorted(families)
    quota = int(sample_size / len(names))
    rows = df.where((F.col("labels") == 1) & F.col(family_col).isin(names))
    if strict:
        sizes = {r[family_col]: r["count"] for r in rows.groupBy(family_col).count().collect()}  # a row per family named
        if short := {f: sizes.get(f, 0) for f in names if sizes.get(f, 0) < quota}:
            raise ValueError(f"{quota} positive rows of each family are asked for; too few in {short}")
    out = take_lowest(rows, id_col, quota, seed=seed, by=[family_col]).select(
        id_col, "text", F.col(family_col).alias("labels")
    )
    if convert_labels:
        out = out.withColumn("labels_protein", F.array_position(F.array(*map(F.lit, names)), F.col("labels")).cast("int") - 1)
    return out


def load_unlabelled(df: DataFrame, id_col: str, text_col: str, *, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Valid texts with the literal label 0."""
    rows = df.select(id_col, F.col(text_col).alias("text"), F.lit(0).alias("labels")).where(is_valid_text(F.col("text")))
    return sample_exact(rows, id_col, sample_size, seed=seed)


# -- catalog -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """One entry: reader, kind of labels, default split policy, tasks wanted by default (None = all)."""

    read: Callable[[SparkSession, str], DataFrame]
    dataset_type: str
    split: str
    tasks: Sequence[str]
    id_col: str
    text_col: str
    group_col: str | None = None
    tasks_wanted: Sequence[str] | None = field(default=None)


def load_dataset(
    spark: SparkSession, root: str, catalog: Mapping[str, Dataset], name: str, *, split: str | None = None,
    tasks_wanted: Sequence[str] | None = None, layout: str = "text",
) -> DataFrame:
    """The named dataset with a ``split`` column; tasks are chosen by name, not by position.

    ``text`` layout: (id, text, labels) with one label or an array. ``wide``: one column per task.
    """
    if name not in catalog:
        raise ValueError(f"{name} should be within {sorted(catalog)}")
    if layout not in ("text", "wide"):
        raise ValueError(f"{layout} should be within ['text', 'wide']")
    entry = catalog[name]
    policy = split or entry.split
    wanted = list(tasks_wanted or entry.tasks_wanted or entry.tasks)
    if missing := set(wanted) - set(entry.tasks):
        raise ValueError(f"{sorted(missing)} should be within {list(entry.tasks)}")
    df = entry.read(spark, root)
    if policy == "random":
        parts = split_fractions(df, entry.id_col)
    elif policy == "scaffold":
        parts = split_by_group(df, entry.id_col, entry.group_col)
    else:
        raise ValueError(f"{policy} should be within ['random', 'scaffold']")
    kind = "int" if entry.dataset_type == "classification" else "double"
    labels = [F.col(t).try_cast(kind).alias(t) for t in wanted]
    if layout == "wide":
        return parts.select(entry.id_col, F.col(entry.text_col).alias("smiles"), *labels, "split")
    packed = labels[0] if len(labels) == 1 else F.array(*labels)
    return parts.select(entry.id_col, F.col(entry.text_col).alias("text"), packed.alias("labels"), "split")


def gaussian_blobs(ids: DataFrame, id_col: str, centers: Sequence[Sequence[float]], *, std: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, blob, point): each id gets a centre and Gaussian noise, both from md5, so any layout agrees.

    The centre list is the caller's parameter (a handful of vectors), held as a literal.
    """
    ident = F.col(id_col).cast("string")
    k, d = len(centers), len(centers[0])
    blob = (F.conv(F.substring(order_key(id_col, f"{seed}:c"), 1, 8), 16, 10).cast("bigint") % k).cast("int")

    def noise(i: Column) -> Column:
        tag = F.concat(ident, F.lit(f":{seed}:"), i.cast("string"))
        u, v = unit_float(F.concat(tag, F.lit(":u"))), unit_float(F.concat(tag, F.lit(":v")))
        return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)

    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    noisy = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: noise(i) * F.lit(float(std)))
    return (
        ids.select(id_col, blob.alias("blob"))
        .withColumn("__c", F.element_at(table, F.col("blob") + 1))
        .withColumn("__z", noisy)
        .select(id_col, "blob", F.zip_with("__c", "__z", lambda a, b: a + b).alias("point"))
    )
