"""Queries over sparse matrices: rows are orders, columns are parts, values are quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.operators import matrices
from tesserine.plans.registry import query
from tesserine.session import shared_path, table
from tesserine.sources import files, sinks


def coo(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))


def vector(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").alias("x"))


PRODUCT = "select l_orderkey as row, ({k} * sum(l_quantity::decimal(18,4) * p_size))::double as y from lineitem join part on l_partkey = p_partkey group by l_orderkey"


@query(PRODUCT.format(k=1))
def q_spmv(spark, sf_dir):
    return matrices.product(coo(spark, sf_dir), vector(spark, sf_dir))


@query(PRODUCT.format(k=5))
def q_spmv_k(spark, sf_dir):
    return matrices.product(coo(spark, sf_dir), vector(spark, sf_dir), 5)


@query(PRODUCT.format(k=1))
def q_spmv_split(spark, sf_dir):
    return matrices.split_product(coo(spark, sf_dir), vector(spark, sf_dir), 500, 1500)


@query("select l_orderkey as row, sum(l_quantity::decimal(18,4) * p_size)::double as y, sum(l_quantity::decimal(18,4) * (p_partkey % 7))::double as z from lineitem join part on l_partkey = p_partkey group by l_orderkey")
def q_spmv_blocked(spark, sf_dir):
    """Two products over one stored layout of the matrix."""
    other = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_partkey") % 7).alias("x"))
    y, z = matrices.products(coo(spark, sf_dir), [vector(spark, sf_dir), other])
    return y.join(z.withColumnRenamed("y", "z"), "row")


@query("select l_orderkey-1000 as row, l_partkey-100 as col, l_quantity as val from lineitem where l_orderkey >= 1000 and l_orderkey < 5000 and l_partkey >= 100 and l_partkey < 1500")
def q_matrix_slice(spark, sf_dir):
    return matrices.sliced(coo(spark, sf_dir), (1000, 5000), (100, 1500))


@query("select count(*)::bigint nnz, count(*) filter (l_quantity <> 0)::bigint nonzeros, sum(l_quantity::decimal(18,4))::double sum_val, sum(l_partkey)::bigint sum_col, bool_and(l_orderkey >= 0 and l_partkey >= 0) in_range from lineitem")
def q_matrix_stats(spark, sf_dir):
    return matrices.checked(coo(spark, sf_dir))


@query("select l_orderkey as row, l_partkey as col, l_quantity as val from lineitem order by 1, 2, 3")
def q_coo_sorted(spark, sf_dir):
    return coo(spark, sf_dir).orderBy("row", "col", "val")


@query("select l_orderkey as row, l_partkey as col, l_quantity as val from lineitem order by 2, 1, 3")
def q_coo_by_column(spark, sf_dir):
    return matrices.by_column(coo(spark, sf_dir))


@query("""with a as (select l_orderkey r, l_partkey c, l_quantity v from lineitem), b as (select * from a where v <> 50)
select (select count(*) from (select * from a except all select * from b))::bigint only_a, (select count(*) from (select * from b except all select * from a))::bigint only_b""")
def q_matrix_equal(spark, sf_dir):
    a = coo(spark, sf_dir)
    return matrices.difference(a, a.filter("val <> 50"))


@query("select l_orderkey // 1000 as block, count(*)::bigint nnz from lineitem group by 1")
def q_block_partition(spark, sf_dir):
    return coo(spark, sf_dir).groupBy(F.expr("row div 1000").alias("block")).agg(F.count("*").alias("nnz"))


@query("""with l as (select l_orderkey as row, count(*)::bigint as length from lineitem group by 1)
select row, length, coalesce(sum(length) over (order by row rows between unbounded preceding and 1 preceding), 0)::bigint as start from l""")
def q_row_pointers(spark, sf_dir):
    return matrices.row_pointers(coo(spark, sf_dir))


@query("select l_orderkey as row, l_partkey as col, l_quantity as val from lineitem")
def q_mtx_scan(spark, sf_dir):
    path, a = shared_path(spark, "matrix") + ".mtx", coo(spark, sf_dir)
    m, n = a.agg(F.max("row") + 1, F.max("col") + 1).first()
    sinks.matrix_market(a, path, m or 0, n or 0)
    return files.matrix(spark, path)


@query("select l_orderkey as row, l_partkey as col, l_quantity as val from lineitem")
def q_csr_scan(spark, sf_dir):
    """The matrix written as parts of one binary file and read by ranges of its entries."""
    path, a = shared_path(spark, "matrix") + ".binary", coo(spark, sf_dir)
    m, n = a.agg(F.max("row") + 1, F.max("col") + 1).first()
    sinks.binary_csr(a, path, m or 0, n or 0, part=20_000)
    return files.binary_csr(spark, path, entries=15_000)
