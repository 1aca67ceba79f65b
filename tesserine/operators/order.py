"""Places of rows in a total order, and running totals along it, without one global window.

Rows are dealt out by ranges of their keys and sorted there; a range's number of
rows (or total) is added up over the ranges before it, which are as many as there
are tasks; that small table alone goes through a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.session import stored


def ranged(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """df as a written table, sorted by `order`, with order_range (a number that grows with the keys) and order_row (the place in the range)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of equal keys are dealt out as well, unless they are equal in everything
    keys = [*order, F.xxhash64(*df.columns)]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return stored(rows.withColumn("order_row", at), "ranges").select(*df.columns, F.shiftright("order_row", 33).alias("order_range"), F.col("order_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("order_row"))


def before(totals: DataFrame, value: str) -> DataFrame:
    """(order_range, base): the sum of value over the ranges before each one of (order_range, value)."""
    over = Window.orderBy("order_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("order_range", F.coalesce(F.sum(value).over(over), F.lit(0)).cast("long").alias("base"))


def positioned(df: DataFrame, *order: str, name: str = "position", partitions: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in the order of the columns; where they are equal for two rows, either may stand first."""
    rows = ranged(df, *order, partitions=partitions)
    bases = before(rows.groupBy("order_range").agg(F.count("*").alias("n")), "n")
    # a row for each task: this is small at any size of df
    return rows.join(F.broadcast(bases), "order_range").select(*df.columns, (F.col("base") + F.col("order_row")).alias(name))


def running(df: DataFrame, value: str, *order: str, name: str = "start", partitions: int | None = None) -> DataFrame:
    """df with the sum of value over the rows before each one in the order of the columns, whose values are unique."""
    rows = ranged(df, *order, partitions=partitions)
    bases = before(rows.groupBy("order_range").agg(F.sum(value).alias("n")), "n")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("order_range").orderBy("order_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("own", own).join(F.broadcast(bases), "order_range").select(*df.columns, (F.col("own") + F.col("base")).cast("long").alias(name))
