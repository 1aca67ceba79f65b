"""Queries over keyed tables, joins, sketches and broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import hashing
from tesserine.operators import sketches, tables
from tesserine.plans.registry import query
from tesserine.session import stored, table

FIRST = "f as (select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) first_order from orders group by o_custkey)"


def first_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("first_order", F.col("o_orderkey"))
    return tables.inserted(o, "o_custkey", "first_order", "o_orderdate", "o_orderkey")


@query(f"with {FIRST} select o_custkey, first_order from f")
def q_hashmap_insert(spark, sf_dir):
    return first_orders(spark, sf_dir)


@query(f"with {FIRST} select c_custkey, coalesce(first_order, -1) first_order from customer left join f on c_custkey = o_custkey")
def q_hashmap_find(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    t = first_orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey")
    return tables.found(keys, t, "c_custkey", "first_order", F.lit(-1).cast("long"))


@query("""with o as (select vec_id, unnest(range(0, len(embedding)))::bigint as at, unnest(embedding)::double as value from embeddings)
select r.vec_id, o.at, o.value from embeddings r join o on o.vec_id = r.vec_id + 1""")
def q_dist_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    owners = e.select(F.col("vec_id").alias("rank"), F.posexplode("embedding").alias("at", "x")).select("rank", F.col("at").cast("long").alias("at"), F.col("x").cast("double").alias("value"))
    ask = e.select("vec_id", (F.col("vec_id") + 1).alias("rank"), F.explode(F.sequence(F.lit(0).cast("long"), F.size("embedding").cast("long") - 1)).alias("at"))
    return tables.fetched(ask, owners).select("vec_id", "at", "value")


@query("with f as (select (o_custkey % 100)::bigint as key, arg_min(o_orderkey, (o_orderdate, o_orderkey)) first_order from orders group by 1) select key, first_order from f")
def q_hashmap_custom(spark, sf_dir):
    """Keys that are equal by a rule of one's own."""
    o = table(spark, sf_dir, "orders").withColumn("first_order", F.col("o_orderkey"))
    return tables.inserted_by(o, F.col("o_custkey") % 100, "first_order", "o_orderdate", "o_orderkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size <= 10)")
def q_bloom_semi(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size <= 10").select("p_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # Spark adds a Bloom filter of its own before the exchange where the sizes are worth it
    return rows.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def q_dangling_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return tables.missing(rows, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def q_broadcast(spark, sf_dir):
    # regions are a fixed list of five
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("""with n as (select count(*) n from part), p as (select unnest([0.01, 0.05, 0.1])::double p)
select p, ceil(n * (-ln(p) / (ln(2)*ln(2))) / 64)::bigint words, ceil(ln(2) * (-ln(p) / (ln(2)*ln(2))))::bigint hashes from n, p""")
def q_bloom_sizing(spark, sf_dir):
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n")).select("n", F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1)))).alias("p"))
    bits = -F.log("p") / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))
    return n.select("p", F.ceil(F.col("n") * bits / 64).cast("long").alias("words"), F.ceil(F.log(F.lit(2.0)) * bits).cast("long").alias("hashes"))


def sized(spark, sf_dir, error: float) -> tuple[DataFrame, sketches.Size]:
    """Parts and the size of a filter for all of them: the size of a filter is part of its plan, so it is counted first."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p, sketches.Size.of(max(1, p.count()), error)


HELD = "select count(*) filter (p_size <= 25)::bigint held, count(*) filter (p_size <= 25)::bigint found, true as few_wrong from part"


@query(HELD)
def q_bloom_membership(spark, sf_dir):
    """Keys held, keys found, and whether few others are let through; none that is held may be missing."""
    p, size = sized(spark, sf_dir, 0.01)
    some = sketches.possible(p, F.col("p_partkey"), sketches.built(p.filter("p_size <= 25"), F.col("p_partkey"), size), size)
    return _judged(some, p)


@query(HELD)
def q_bloom_classic(spark, sf_dir):
    p, size = sized(spark, sf_dir, 0.01)
    some = sketches.classic_possible(p, "p_partkey", sketches.classic(p.filter("p_size <= 25"), F.col("p_partkey"), size), size)
    return _judged(some.join(p, "p_partkey"), p)


def _judged(some: DataFrame, p: DataFrame) -> DataFrame:
    met = some.select("p_size", F.lit(1).alias("met")).unionByName(p.select("p_size", F.lit(0).alias("met")))
    inside = F.col("p_size") <= 25
    n = lambda test: F.count_if(test)
    wrong, others = n(~inside & (F.col("met") == 1)), n(~inside & (F.col("met") == 0))
    return met.agg(n(inside & (F.col("met") == 0)).alias("held"), n(inside & (F.col("met") == 1)).alias("found"), (wrong <= F.greatest(F.lit(3), others * 0.1)).alias("few_wrong"))


@query("select count(*)::bigint n, true as close from part")
def q_bloom_cardinality(spark, sf_dir):
    """Keys, and whether the filter's estimate of them is within 15 per cent."""
    p, size = sized(spark, sf_dir, 0.01)
    guess = sketches.cardinality(sketches.built(p, F.col("p_partkey"), size), size)
    n = p.agg(F.count("*").alias("n"))
    both = n.select("n", F.lit(None).cast("long").alias("estimate")).unionByName(guess.select(F.lit(None).cast("long").alias("n"), "estimate")).agg(F.max("n").alias("n"), F.max("estimate").alias("estimate"))
    return both.select("n", (F.abs(F.col("estimate") - F.col("n")) <= 0.15 * F.col("n")).alias("close"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) > 1 as seen from orders where o_custkey is not null")
def q_bloom_add(spark, sf_dir):
    """Whether a filter had each order's customer before, by date; with an error of 1e-12 it is never wrong here."""
    o = table(spark, sf_dir, "orders").filter("o_custkey is not null").select("o_orderkey", "o_custkey", "o_orderdate")
    size = sketches.Size.of(max(1, o.count()), 1e-12)
    return sketches.added(o, F.col("o_custkey"), size, "o_orderdate", "o_orderkey").select("o_orderkey", "seen")


@query("""with l as (select l_returnflag as part, count(distinct l_partkey)::bigint as n from lineitem group by 1 union all select 'all', count(distinct l_partkey)::bigint from lineitem)
select part, n, true as close from l""")
def q_hll_union(spark, sf_dir):
    """Distinct parts of each kind of line and of all lines, and whether the stored sketches and their union come within 5 per cent."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("part"), "l_partkey")
    kept = stored(sketches.distinct_sketches(rows, F.col("l_partkey"), "part", bits=14), "sketches")
    guess = sketches.united(kept, "part").unionByName(sketches.united(kept.withColumn("part", F.lit("all")), "part"))
    exact = rows.groupBy("part").agg(F.count_distinct("l_partkey").alias("n")).unionByName(rows.agg(F.count_distinct("l_partkey").alias("n")).select(F.lit("all").alias("part"), "n"))
    return exact.join(guess, "part").select("part", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


#: The mix of part keys, times a spread that fills 64 bits, on whole numbers of 128 bits.
MIX = """with a as (select p_partkey, ((p_partkey * 11400714819323198485::hugeint) % 18446744073709551616::hugeint) as k from part),
b as (select p_partkey, (18446744073709551615::hugeint - k + k * 2097152 % 18446744073709551616::hugeint) % 18446744073709551616::hugeint as k from a),
c as (select p_partkey, xor(k, k // 16777216) as k from b), d as (select p_partkey, k * 265 % 18446744073709551616::hugeint as k from c),
e as (select p_partkey, xor(k, k // 16384) as k from d), f as (select p_partkey, k * 21 % 18446744073709551616::hugeint as k from e),
g as (select p_partkey, xor(k, k // 268435456) as k from f), h as (select p_partkey, (k + k * 2147483648 % 18446744073709551616::hugeint) % 18446744073709551616::hugeint as k from g)
select p_partkey, (case when k >= 9223372036854775808::hugeint then k - 18446744073709551616::hugeint else k end)::bigint as mixed from h"""


@query(MIX)
def q_mix64(spark, sf_dir):
    """A mix of 64 bits of numbers that fill them."""
    spread = F.pmod(F.col("p_partkey").cast("decimal(20,0)") * F.lit("11400714819323198485").cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)"))
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    signed = F.when(spread >= half, spread - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(spread).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", hashing.mix64(signed).alias("mixed"))


@query(HELD)
def q_bloom_chained(spark, sf_dir):
    """Membership by a filter whose bits come from one mix after the other."""
    p, size = sized(spark, sf_dir, 0.01)
    size = sketches.Size(size.words, size.hashes, chain=True)
    some = sketches.possible(p, F.col("p_partkey"), sketches.built(p.filter("p_size <= 25"), F.col("p_partkey"), size), size)
    return _judged(some, p)
