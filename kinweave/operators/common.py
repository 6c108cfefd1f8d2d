"""Ranking and size checks that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once, however often later expressions use them.

    A projection would be inlined into those; a generator of one row is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def small(df: DataFrame, most: int = DEFAULTS.broadcast_rows) -> DataFrame:
    """df with a broadcast hint if it has `most` rows or fewer, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """df with the 1-based rank within keys, down to k rows; the filter lets Spark cut each task's share to k first."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col(rank) <= k)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)
