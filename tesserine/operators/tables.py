"""Keyed tables: insert, lookup with default, and lookups in distributed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value): the first write of a key wins, first by `order`."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def found(keys: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """keys with the table's value, the default where the key is missing."""
    return keys.join(table, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def missing(keys: DataFrame, table: DataFrame, on: Column) -> DataFrame:
    """Keys that the table lacks."""
    return keys.join(table, on, "left_anti")


def fetched(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """requests (rank, at, ...) with the value of owners (rank, at, value)."""
    return requests.join(owners, ["rank", "at"])


def inserted_by(rows: DataFrame, equal: Column, value: str, *order: str) -> DataFrame:
    """(key, value): as inserted, for keys that are equal if an expression of the row, their normal form, is: it takes the part of a hash and an equality of one's own."""
    return inserted(rows.withColumn("key", equal), "key", value, *order)


def presized(n: Column, error: float = 0.05) -> Column:
    """Capacity for n expected keys of a Bloom filter with that error: (n (1 + error)**2 + 1000) * 2, in whole numbers."""
    scale = round((1 + error) ** 2 * 10_000)
    return ((F.floor(n * scale / 10_000) + 1000) * 2).cast("long")


def loaded(parts: DataFrame, n: str, ranks: int) -> DataFrame:
    """size, capacity, mean load and whole mean keys a part, of a table in `ranks` parts with n keys each."""
    total = parts.agg(F.sum(n).cast("long").alias("size"), F.count("*").alias("parts")).withColumn("capacity", presized(F.col("size")))
    return total.select("size", "capacity", F.round(F.col("size") * float(ranks) / F.col("capacity") / F.col("parts"), 9).alias("load"), F.expr(f"size div {ranks}").alias("average"))
