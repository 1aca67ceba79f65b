"""Sparse matrices as (row, col, val) and products with vectors (idx, x)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators import order
from tesserine.session import shared_path, stored


def product(matrix: DataFrame, vector: DataFrame, steps: int = 1) -> DataFrame:
    """(row, y): after `steps` accumulations of A x with the vector left as it is, steps times A x. Decimal sums, so order does not matter."""
    terms = matrix.join(vector, F.col("col") == F.col("idx"))
    return terms.groupBy("row").agg((F.sum(F.col("val").cast("decimal(18,4)") * F.col("x")) * steps).cast("double").alias("y"))


def powered(matrix: DataFrame, vector: DataFrame, steps: int) -> DataFrame:
    """x <- A x, `steps` times, each result a written table."""
    for _ in range(steps):
        vector = stored(product(matrix, vector).select(F.col("row").alias("idx"), F.col("y").alias("x")), "power")
    return vector


def by_column(matrix: DataFrame) -> DataFrame:
    """Entries in column-major order."""
    return matrix.orderBy("col", "row", "val")


def sliced(matrix: DataFrame, rows: tuple[int, int], cols: tuple[int, int], shape: tuple[int, int] | None = None) -> DataFrame:
    """Entries of [rows) x [cols), counted from the slice's corner; upper bounds end at the shape."""
    (a, b), (c, d) = rows, cols
    if shape:
        b, d = min(b, shape[0]), min(d, shape[1])
    inside = (F.col("row") >= a) & (F.col("row") < b) & (F.col("col") >= c) & (F.col("col") < d)
    return matrix.filter(inside).select((F.col("row") - a).alias("row"), (F.col("col") - c).alias("col"), "val")


def split_product(matrix: DataFrame, vector: DataFrame, low: int, high: int) -> DataFrame:
    """The product from three disjoint ranges of columns: left, own and right block."""
    c = F.col("col")
    parts = [matrix.filter(x) for x in (c < low, (c >= low) & (c < high), c >= high)]
    return product(parts[0].unionAll(parts[1]).unionAll(parts[2]), vector)


def checked(matrix: DataFrame, m: int | None = None, n: int | None = None) -> DataFrame:
    """nnz, nonzeros, sums of values and columns, and whether all indices lie in range."""
    inside = (F.col("row") >= 0) & (F.col("col") >= 0)
    inside = inside & (F.col("row") < m) if m is not None else inside
    inside = inside & (F.col("col") < n) if n is not None else inside
    return matrix.agg(F.count("*").alias("nnz"), F.count_if(F.col("val") != 0).alias("nonzeros"), F.sum(F.col("val").cast("decimal(18,4)")).cast("double").alias("sum_val"), F.sum("col").cast("long").alias("sum_col"), F.bool_and(inside).alias("in_range"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many entries only a and only b have, as multisets; equal matrices give 0 and 0. One full pass: signed counts by entry."""
    both = a.select("row", "col", "val", F.lit(1).alias("n")).unionByName(b.select("row", "col", "val", F.lit(-1).alias("n")))
    net = both.groupBy("row", "col", "val").agg(F.sum("n").alias("n"))
    return net.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).cast("long").alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).cast("long").alias("only_b"))


def row_pointers(matrix: DataFrame) -> DataFrame:
    """(row, length, start): the CSR row lengths and their prefix sums, by ranges of rows."""
    return order.running(matrix.groupBy("row").agg(F.count("*").alias("length")), "length", "row")


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df as a written table in buckets of a column, each sorted by it: a join on the column with another such table moves neither."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", shared_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def products(matrix: DataFrame, vectors: list[DataFrame], buckets: int | None = None) -> list[DataFrame]:
    """(row, y) for each vector, over one matrix laid out by blocks of columns.

    The matrix is written once; a product then moves its vector and the partial
    sums of rows, which are as many as rows for each block at most.
    """
    n = buckets or int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(matrix.select("row", "col", "val"), "col", n)
    return [product(blocks, bucketed(v.select("idx", "x"), "idx", n).hint("merge")) for v in vectors]
