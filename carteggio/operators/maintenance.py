"""Tables below a folder: resets in order with counts and backup, repair of dangling references, versions of a schema."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def backup(spark: SparkSession, folder: str, target: str) -> None:
    """A copy of a folder by the file system."""
    fs, p = _fs(spark, folder)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, _fs(spark, target)[1], False, spark._jsc.hadoopConfiguration())


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df``, which may read the table at ``path``, over that table: first beside it, then in its place."""
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    fs.rename(_fs(spark, new)[1], p)


def reset(spark: SparkSession, folder: str, tables: Sequence[tuple[str, Column]], backup_to: str | None = None, confirm: bool = True) -> dict[str, int]:
    """Delete the rows of ``tables`` (name, condition) in the order given, children first; the number deleted per table.

    Absent tables count 0. With ``backup_to`` the folder is copied first; without ``confirm`` nothing is touched. A null
    condition keeps the row.
    """
    if not confirm:
        raise ValueError("a reset must be confirmed")
    if backup_to:
        backup(spark, folder, backup_to)
    out = {}
    for name, gone in tables:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if not exists(spark, path):
            out[name] = 0
            continue
        df = spark.read.parquet(path)
        out[name] = df.where(gone).count()
        if out[name]:
            replace(spark, df.where(~F.coalesce(gone, F.lit(False))), path)
    return out


#: What each stage of a study leaves behind, in the order in which it is deleted.
STAGES = {
    "cleaning": ("clean_texts", "semantic_contexts", "semantic_embeddings", "email_clusters", "clusters"),
    "context": ("semantic_contexts", "semantic_embeddings", "email_clusters", "clusters"),
    "embedding": ("semantic_embeddings", "email_clusters", "clusters"),
    "clustering": ("email_clusters", "clusters"),
}


def reset_stage(spark: SparkSession, folder: str, stage: str) -> dict[str, int]:
    """Delete what a stage and all later ones wrote."""
    return reset(spark, folder, [(t, F.lit(True)) for t in reversed(STAGES[stage])])


def violations(spark: SparkSession, folder: str, keys: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column, parent, rows, missing_table) for each declared (child, column, parent, key)."""
    out = []
    for child, column, parent, key in keys:
        if not all(exists(spark, f"{folder}/{t}.parquet") for t in (child, parent)):
            out.append((child, column, parent, 0, True))
            continue
        c, p = (spark.read.parquet(f"{folder}/{t}.parquet") for t in (child, parent))
        out.append((child, column, parent, c.where(F.col(column).isNotNull()).join(p.select(F.col(key).alias(column)), column, "left_anti").count(), False))
    return spark.createDataFrame(out, "child string, column string, parent string, rows long, missing_table boolean")


def repair(spark: SparkSession, folder: str, keys: Sequence[tuple[str, str, str, str]], backup_to: str | None = None) -> dict[str, int]:
    """Delete rows whose reference leads nowhere, in the order of ``keys``; the number deleted per child and column."""
    if backup_to:
        backup(spark, folder, backup_to)
    out = {}
    for child, column, parent, key in keys:
        path = f"{folder}/{child}.parquet"
        if not all(exists(spark, f"{folder}/{t}.parquet") for t in (child, parent)):
            continue
        c, p = spark.read.parquet(path), spark.read.parquet(f"{folder}/{parent}.parquet").select(F.col(key).alias(column)).distinct()
        bad = c.where(F.col(column).isNotNull()).join(p, column, "left_anti").count()
        out[f"{child}.{column}"] = bad
        if bad:
            columns = c.columns
            replace(spark, c.where(F.col(column).isNull()).unionByName(c.join(p, column, "left_semi").select(*columns)), path)
    return out


def migrate(df: DataFrame, columns: dict[str, str], version: int, now: int) -> tuple[DataFrame, int]:
    """``df`` with the columns (name -> type) it lacks as nulls, and the version it has then; never a step back."""
    if version > now:
        raise ValueError(f"the table has version {version}, newer than {now}")
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns]), now
