"""Queries of strings, calls, user functions, streams and file scans."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tesserine.functions import text
from tesserine.operators import calls
from tesserine.plans.genomics import COUNTS, READS, K, reads
from tesserine.plans.registry import query
from tesserine.session import shared_path, table
from tesserine.sources import files, sinks
from tesserine.streaming import counters, keyed


@query(r"""select page_id, len(string_split(url,'/')) - (case when url like '%/' then 1 else 0 end)::bigint as parts, replace(url,' ','_') no_spaces,
case when contains(url,'/') then list_last(string_split(url,'/')) else '' end base, regexp_replace(url,'\.[^.]*$','') stem from pages""")
def q_string_utils(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.split_tokens(u, "/")).cast("long").alias("parts"), text.replace_spaces(u).alias("no_spaces"), text.basename(u).alias("base"), text.without_extension(u).alias("stem"))


@query("select page_id, replace(url, 'http', 'ht') as found from pages")
def q_find_replace(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.replaced(F.col("url"), "http", "ht").alias("found"))


@query("select o_orderkey, o_orderkey / 1e3 as us, o_orderkey / 1e6 as ms, o_orderkey / 1e9 as s from orders")
def q_time_units(spark, sf_dir):
    ns = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.micros(ns).alias("us"), text.millis(ns).alias("ms"), text.seconds(ns).alias("s"))


def _sql_size(unit: str, power: int) -> str:
    d = 200 * (1 << power)
    v = f"((20000*n+{d // 2})//{d})"
    return f"when n >= {1 << power} then ({v}//100)::varchar||'.'||lpad(({v}%100)::varchar,2,'0')||'{unit}'"


@query("with d as (select doc_id, n_chars*1000 as n from documents) select doc_id, case " + " ".join(_sql_size(u, p) for u, p in (("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10))) + " else n::varchar||'B' end as size from d")
def q_size_str(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.size_str(F.col("n_chars") * 1000).alias("size"))


@query("""with c as (select o_orderpriority, count(*)::bigint n, (select count(*) from orders)::bigint total from orders group by 1)
select o_orderpriority, n::varchar||' ('||((20000*n+total)//(2*total)//100)::varchar||'.'||lpad(((20000*n+total)//(2*total)%100)::varchar,2,'0')||'%)' share from c""")
def q_perc_str(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).join(F.broadcast(o.agg(F.count("*").alias("total"))))
    return n.select("o_orderpriority", text.perc_str(F.col("n"), F.col("total")).alias("share"))


@query("select o_orderkey as read_number, (1 + o_orderkey % 2)::int as pair from orders")
def q_read_id_parse(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit("/"), (1 + F.col("o_orderkey") % 2).cast("string")).alias("id"))
    return files.read_ids(ids).select("read_number", "pair")


@query("select o_orderkey, 'x'||o_orderkey::varchar||'/'||(1 + o_orderkey % 2)::varchar as name from orders")
def q_fastq_name(spark, sf_dir):
    x, p, k = F.concat(F.lit("@x"), F.col("o_orderkey").cast("string")), (1 + F.col("o_orderkey") % 2).cast("string"), F.col("o_orderkey") % 3
    header = F.when(k == 0, F.concat(x, F.lit("/"), p)).when(k == 1, F.concat(x, F.lit("-R"), p)).otherwise(F.concat(x, F.lit(" "), p, F.lit(":Y:0:ACGT")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.fastq_name(header).alias("name"))


@query("select (l_orderkey % 15)::bigint target, l_linenumber::bigint a, l_quantity::bigint b, (l_linenumber * l_quantity)::bigint result from lineitem")
def q_rpc_map(spark, sf_dir):
    ask = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 15).alias("target"), F.col("l_linenumber").cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b"))
    return calls.called(ask, lambda b: pc.multiply(b.column(1), b.column(2)), "bigint")


@query("select (l_orderkey % 15)::bigint target, count(*)::bigint requests, count(*)::bigint executions from lineitem group by 1")
def q_rpc_counts(spark, sf_dir):
    return calls.executions(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 15).alias("target")))


@query("select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def q_row_roundtrip(spark, sf_dir):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    sent = table(spark, sf_dir, "lineitem").select(F.to_json(F.struct(*cols)).alias("j"))
    return sent.select(F.from_json("j", "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string").alias("r")).select("r.*")


@query("select n_nationkey, (n_nationkey * n_regionkey + 1)::bigint as y from nation")
def q_udf_scalar(spark, sf_dir):
    @F.pandas_udf("bigint")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return a.astype("int64") * b + 1

    return table(spark, sf_dir, "nation").select("n_nationkey", f("n_nationkey", "n_regionkey").alias("y"))


@query("select o_orderpriority, bit_xor(o_orderkey) as x from orders group by 1")
def q_udaf_reduce(spark, sf_dir):
    """A reduction by a user's function: partial results by batch in the scan's stage, then the same function over those."""
    import functools
    import operator

    def part(batches):
        for b in batches:
            got: dict = {}
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[k] = got[k] ^ v if k in got else v
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["o_orderpriority", "v"])

    @F.pandas_udf("bigint")
    def merged(v: pd.Series) -> int:
        return functools.reduce(operator.xor, v)

    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return o.mapInArrow(part, "o_orderpriority string, v bigint").groupBy("o_orderpriority").agg(merged("v").alias("x"))


@query(f"with {READS}, w as (select doc_id, unnest(list_transform(range(1, length(s)-{K}+2), lambda i: substr(s,i::int,{K}))) kmer from r where length(s) >= {K}) select doc_id, kmer, count(*)::bigint n from w group by 1, 2")
def q_udtf_kmers(spark, sf_dir):
    @F.udtf(returnType="kmer string, n bigint")
    class Kmers:
        def eval(self, s: str):
            from collections import Counter

            yield from Counter(s[i : i + K] for i in range(len(s) - K + 1)).items()

    spark.udtf.register("tesserine_kmers", Kmers)
    return reads(spark, sf_dir).lateralJoin(Kmers(F.col("s").outer())).select("doc_id", "kmer", "n")


@query("select event_type, count(*)::bigint n from events group by 1")
def q_stream_counter(spark, sf_dir):
    return counters.counted(spark, f"{sf_dir}/events.parquet", "event_type")


@query("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) first_order from orders where o_custkey is not null group by o_custkey")
def q_stream_table(spark, sf_dir):
    """Each customer's first order, from a stream of writes with state for each key."""
    rows = counters.files(spark, f"{sf_dir}/orders.parquet").filter("o_custkey is not null")
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"))
    writes = rows.select(F.col("o_custkey").alias("key"), stamp.alias("stamp"), F.col("o_orderkey").alias("value"))
    return keyed.table(keyed.written(writes)).select(F.col("key").alias("o_custkey"), F.col("value").alias("first_order"))


@query("""with w as (select max(ts) - interval 2 hour as mark from events)
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as "start", event_type, count(*)::bigint n from events, w where date_trunc('hour', ts) + interval 1 hour <= date_trunc('milliseconds', mark) group by 1, 2""")
def q_stream_windows(spark, sf_dir):
    found = counters.windowed(spark, f"{sf_dir}/events.parquet", "ts", "1 hour", "2 hours", "event_type")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(f"with {READS} select 'r'||doc_id::varchar||'/1' as id, s as seq, repeat('I', length(s)) as qual from r")
def q_fastq_scan(spark, sf_dir):
    path = shared_path(spark, "reads")
    sinks.fastq(reads(spark, sf_dir).select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("/1")).alias("id"), F.col("s").alias("seq"), F.repeat(F.lit("I"), F.length("s")).alias("qual")), path)
    return files.fastq(spark, path)


@query(f"with {READS} select 'r'||doc_id::varchar||'/'||i::varchar as id, s as seq, repeat('@', length(s)) as qual from r, unnest([1, 2]) t(i)")
def q_fastq_split(spark, sf_dir):
    """Pairs of records whose qualities look like headers, from ranges of 32 kB."""
    path = shared_path(spark, "pairs")
    mates = reads(spark, sf_dir).select("doc_id", "s", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("i"))
    sinks.fastq(mates.select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("/"), "i").alias("id"), F.col("s").alias("seq"), F.repeat(F.lit("@"), F.length("s")).alias("qual")), path)
    return files.fastq(spark, path, split=32 << 10, pairs=True)


@query(f"with {COUNTS} select kmer, substr(kmer,1,1) b_ext, case when cnt % 2 = 0 then 'F' else substr(kmer,{K},1) end f_ext from c where cnt >= 2")
def q_kmer_table_scan(spark, sf_dir):
    from tesserine.operators import kmers

    path = shared_path(spark, "kmers")
    last = F.when(F.col("cnt") % 2 == 0, "F").otherwise(F.substring("kmer", K, 1))
    sinks.kmer_rows(kmers.repeated(reads(spark, sf_dir)).select("kmer", F.substring("kmer", 1, 1).alias("b_ext"), last.alias("f_ext")), path)
    return files.kmer_table(spark, path, files.kmer_width(spark, path))


@query(f"with {READS} select (4*count(*))::bigint as lines from r")
def q_line_count(spark, sf_dir):
    path = shared_path(spark, "reads")
    sinks.fastq(reads(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq"), F.col("s").alias("qual")), path)
    return files.line_count(spark, path)


