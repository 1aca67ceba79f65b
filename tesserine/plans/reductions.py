"""Queries of reductions, histograms, sorts and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.operators import histograms, reductions
from tesserine.plans.registry import query
from tesserine.session import table


@query("""select n_regionkey, sum(n_nationkey+1)::bigint plus, product(n_nationkey+1)::double multiplies, bit_and((n_nationkey+1)::bigint) bit_and, bit_or((n_nationkey+1)::bigint) bit_or,
bit_xor((n_nationkey+1)::bigint) bit_xor, min((n_nationkey+1)::bigint) "min", max((n_nationkey+1)::bigint) "max" from nation group by n_regionkey""")
def q_reduce_ops(spark, sf_dir):
    return reductions.reduced(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("long") + 1, "n_regionkey")


@query("""select o_orderkey, (select sum(o_totalprice::decimal(18,2))::double from orders) total from orders""")
def q_reduce_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return reductions.to_all(o, F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), "total").select("o_orderkey", "total")


@query("select r as rank, case when r = 3 then (select sum(o_custkey) from orders) else 0 end::bigint as value from (select distinct (o_orderkey % 15)::bigint r from orders)")
def q_reduce_one(spark, sf_dir):
    ranks = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 15).alias("rank"), "o_custkey")
    return reductions.to_one(ranks, F.sum("o_custkey").cast("long"), 3, F.lit(0).cast("long")).select("rank", "value")


@query("""select o_orderstatus, sum(o_custkey)::bigint plus, bit_and(o_custkey) bit_and, bit_or(o_custkey) bit_or, bit_xor(o_custkey) bit_xor, min(o_custkey) "min", max(o_custkey) "max" from orders group by o_orderstatus""")
def q_reduce_local(spark, sf_dir):
    return reductions.reduced(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_orderstatus", operations=("plus", "bit_and", "bit_or", "bit_xor", "min", "max"))


@query("""with e as (select (unnest(range(0, len(embedding))))::int pos, unnest(embedding)::double x from embeddings)
select pos, min(x) "min", max(x) "max", sum(floor(x*1000000)::bigint)::bigint micros from e group by pos""")
def q_reduce_vector(spark, sf_dir):
    x = F.col("x").cast("double")
    return reductions.by_position(table(spark, sf_dir, "embeddings"), "embedding", F.min(x).alias("min"), F.max(x).alias("max"), F.sum(F.floor(x * 1000000).cast("long")).cast("long").alias("micros"))


@query("select l_partkey as v, count(*)::bigint n from lineitem group by 1")
def q_counter(spark, sf_dir):
    return histograms.counted(table(spark, sf_dir, "lineitem"), F.col("l_partkey"))


@query("select floor(value/10.0)::bigint bucket, count(*)::bigint n from events group by 1")
def q_interval_histogram(spark, sf_dir):
    return histograms.intervals(table(spark, sf_dir, "events"), F.col("value"), 10)


@query("with c as (select l_partkey v, count(*)::bigint n from lineitem group by 1) select v, n from c where n = (select max(n) from c)")
def q_max_frequency(spark, sf_dir):
    return histograms.most_frequent(table(spark, sf_dir, "lineitem"), F.col("l_partkey")).select("v", "n")


@query("select l_quantity::bigint as v, count(*)::bigint n from lineitem group by 1 order by 1")
def q_counting_sort(spark, sf_dir):
    return histograms.sorted_counts(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"))


@query("select l_quantity, l_orderkey, l_linenumber, l_partkey, row_number() over (order by l_quantity, l_orderkey, l_linenumber, l_partkey) - 1 as position from lineitem")
def q_sort_position(spark, sf_dir):
    """Each row's place in the order of quantities; ties go by order, line and part."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    return histograms.sorted_rows(rows, "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")


@query("select l_orderkey // 1000 as part, count(*)::bigint n from lineitem group by 1")
def q_range_partition(spark, sf_dir):
    return histograms.per_range(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), 1000)


@query("select (l_orderkey % 15)::bigint as part, count(*)::bigint n from lineitem group by 1")
def q_hash_partition_stats(spark, sf_dir):
    return histograms.per_hash(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), 15)


@query("""select event_type as name, count(*)::bigint steps, min(value) "min", max(value) "max", (sum(value::decimal(18,4))::double / count(*)) mean, sum(value::decimal(18,4))::double total from events group by 1""")
def q_timer_stats(spark, sf_dir):
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("steps"), F.min("value").alias("min"), F.max("value").alias("max"), (total / F.count("*")).alias("mean"), total.alias("total"))


@query("select event_id, (sum(value::decimal(18,4)) over w)::double / count(*) over w running from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def q_running_avg(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", (F.sum(F.col("value").cast("decimal(18,4)")).over(w).cast("double") / F.count("*").over(w)).alias("running"))
