"""Counters, interval roll-ups, greatest frequencies, counting sort and partition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators import order


def counted(df: DataFrame, value: Column, name: str = "v") -> DataFrame:
    """(v, n)."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def intervals(df: DataFrame, value: Column, width: float) -> DataFrame:
    """(bucket, n): an edge belongs to the interval above it."""
    return counted(df, F.floor(value / F.lit(float(width))).cast("long"), "bucket")


def most_frequent(df: DataFrame, value: Column) -> DataFrame:
    """Every value that reaches the greatest count."""
    c = counted(df, value)
    return c.join(F.broadcast(c.agg(F.max("n").alias("n"))), "n", "left_semi")


def sorted_counts(df: DataFrame, value: Column) -> DataFrame:
    """Counting sort: the histogram in order of values, by range partitions."""
    return counted(df, value).orderBy("v")


def sorted_rows(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Rows with their place in total order: ranges of keys, each sorted in its partition, and places counted over the ranges."""
    return order.positioned(df, *columns, partitions=partitions)


def per_range(df: DataFrame, key: Column, width: int) -> DataFrame:
    """(part, n): rows of each range partition."""
    return counted(df, F.floor(key / F.lit(width)).cast("long"), "part")


def per_hash(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """(part, n): rows of each hash partition, the hash being the key itself."""
    return counted(df, F.pmod(key, F.lit(parts)).cast("long"), "part")
