"""Relational patterns: newest row, best k per group, merges, rematching, trees, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the greatest ``by`` per ``keys``: an aggregation, so partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group. Spark cuts each group before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; where ``keep`` (over ``o.*``) holds the old row stays."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("o"))
    n = new.select(*keys, F.struct(*rest).alias("n"))
    stays = F.col("n").isNull() | (F.col("o").isNotNull() & keep if keep is not None else F.lit(False))
    return o.join(n, list(keys), "full").select(*keys, F.when(stays, F.col("o")).otherwise(F.col("n")).alias("r")).select(*keys, "r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``old`` and the first row per key of ``new`` whose key it lacks."""
    return old.unionByName(top_k(new.join(old, list(keys), "left_anti"), keys, order, 1).select(*old.columns))


def rematch(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Pair the n-th row of a key on the left with the n-th row of that key on the right."""
    number = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "_n"]).drop("_n")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; null references are none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def fold_events(events: DataFrame, key: str, field: str, value: str, order: Sequence[str]) -> DataFrame:
    """Current state of an event log: the newest value per key and field."""
    return events.groupBy(key, field).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("changes"))


def concat_distinct(c: Column | str, sep: str = ",") -> Column:
    """Different values in order, joined: an aggregate with a defined order."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)
