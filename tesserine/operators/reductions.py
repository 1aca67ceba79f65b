"""Reductions: seven operations, on scalars and vectors, in three scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {
    "plus": lambda c: F.sum(c).cast("long"),
    "multiplies": lambda c: F.product(c),
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "min": F.min,
    "max": F.max,
}


def reduced(df: DataFrame, value: Column, *by: str, operations: tuple[str, ...] = tuple(OPERATIONS)) -> DataFrame:
    """The named reductions of value, of all rows or of each group (a group is a local scope)."""
    return df.groupBy(*by).agg(*(OPERATIONS[o](value).alias(o) for o in operations))


def to_all(df: DataFrame, aggregate: Column, name: str) -> DataFrame:
    """Every row with the reduction of all rows: one value, sent to all tasks."""
    one = df.agg(aggregate.alias(name)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def to_one(ranks: DataFrame, value: Column, root: int, default: Column) -> DataFrame:
    """(rank, value): the root has the reduction over all ranks, every other rank the default."""
    total = ranks.agg(value.alias("value")).withColumn("rank", F.lit(root).cast("long"))
    return ranks.select("rank").distinct().join(F.broadcast(total), "rank", "left").withColumn("value", F.coalesce("value", default))


def by_position(df: DataFrame, vector: str, *aggregates: Column) -> DataFrame:
    """Element-wise reduction: one row a position, aggregates over column x."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(*aggregates)
