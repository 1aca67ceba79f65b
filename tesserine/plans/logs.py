"""Queries of log parsing; the lines are rendered from events and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text
from tesserine.operators import logs
from tesserine.plans.registry import query
from tesserine.session import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines an event, a file a user: the header and the value."""
    e = table(spark, sf_dir, "events")
    head = F.concat(F.lit("srun -N="), (1 + F.col("user_id") % 32).cast("string"), F.lit(" --ntasks-per-node=2 "), "event_type")
    value = F.concat(F.lit("total time "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" s"))
    return e.select(F.col("user_id").alias("file"), F.posexplode(F.array(head, value)).alias("p", "line"), "event_id").select("file", (2 * F.col("event_id") + F.col("p")).alias("at"), "line")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parsed(lines(spark, sf_dir)).withColumns({"y": F.col("value").cast("double"), "core_num": F.col("node_num") * 32})


ROWS = "p as (select user_id as file, 2*event_id+1 as at, (1+user_id%32)::bigint node_num, 2::bigint tasks, event_type task, value::decimal(18,2)::double y, ((1+user_id%32)*32)::bigint core_num from events)"


@query(f"with {ROWS} select * from p")
def q_log_parse(spark, sf_dir):
    return rows(spark, sf_dir).select("file", "at", "node_num", "tasks", "task", "y", "core_num")


@query("""with s as (select event_id, case event_id % 5 when 0 then '-nan' when 1 then user_id::varchar when 2 then value::decimal(18,2)::varchar when 3 then event_type else '1e3' end as v from events)
select event_id, case when event_id % 5 = 1 then v::bigint end as_long, case event_id % 5 when 0 then 'nan'::double when 2 then v::double when 4 then 1000.0 end::double as_double, case when event_id % 5 = 3 then v end as_text from s""")
def q_log_typed(spark, sf_dir):
    k = F.col("event_id") % 5
    v = F.when(k == 0, "-nan").when(k == 1, F.col("user_id").cast("string")).when(k == 2, F.col("value").cast("decimal(18,2)").cast("string")).when(k == 3, F.col("event_type")).otherwise("1e3")
    whole, real, rest = text.literal(F.col("v"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", whole.alias("as_long"), real.alias("as_double"), rest.alias("as_text"))


@query(f"with {ROWS} select \"at\", task, y * 1000 as ms from p where node_num >= 4")
def q_log_filter(spark, sf_dir):
    return rows(spark, sf_dir).filter("node_num >= 4").select("at", "task", (F.col("y") * 1000).alias("ms"))


def by_task(spark, sf_dir, **aggregates):
    return logs.grouped(rows(spark, sf_dir), "y", "task", "node_num", **aggregates)


GROUPED = "with " + ROWS + " select task, node_num, {a} from p where y is not null and not isnan(y) and y <> 0 group by task, node_num"


@query(GROUPED.format(a='min(y) y'))
def q_log_min(spark, sf_dir):
    return by_task(spark, sf_dir, y=F.min("y"))


@query(GROUPED.format(a='max(y) y'))
def q_log_max(spark, sf_dir):
    return by_task(spark, sf_dir, y=F.max("y"))


@query(GROUPED.format(a='sum(y::decimal(18,2))::double / count(*) y'))
def q_log_mean(spark, sf_dir):
    return by_task(spark, sf_dir, y=F.sum(F.col("y").cast("decimal(18,2)")).cast("double") / F.count("*"))


@query(GROUPED.format(a='round(median(y), 6) med, round(stddev_samp(y), 6) std'))
def q_log_median_std(spark, sf_dir):
    return by_task(spark, sf_dir, med=F.round(F.median("y"), 6), std=F.round(F.stddev_samp("y"), 6))


def branched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a user; events of even number as three-line records, of odd number as two-line ones, each behind its header and a line that means nothing."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    text_of = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    value = F.col("value").cast("decimal(18,2)")
    head = text_of("srun -N=", 1 + F.col("user_id") % 32, " --ntasks-per-node=2 ", F.col("event_type"))
    three = [text_of("payload: ", F.col("event_id") % 64, " B in a batch"), text_of("spent ", value, " us on it"), text_of("volume: ", F.col("event_id"), " MB")]
    two = [text_of("payload: ", F.col("event_id") % 64, " B alone"), text_of("volume: ", F.col("event_id"), " MB")]
    lines = F.when(F.col("event_id") % 2 == 0, F.array(head, F.lit("noise"), *three)).otherwise(F.array(head, F.lit("noise"), *two))
    return e.select(F.col("user_id").alias("file"), F.posexplode(lines).alias("p", "line"), "event_id").select("file", (8 * F.col("event_id") + F.col("p")).alias("at"), "line")


BRANCHES = logs.Node(
    [r"srun -N=(\d+) --ntasks-per-node=\d+ (.+)"],
    ["node_num", "task"],
    [
        logs.Node([r"payload: (\d+) B in a batch", r"spent (.+) us on it", r"volume: (\d+) MB"], ["payload", "overhead", "total"]),
        logs.Node([r"payload: (\d+) B alone", r"volume: (\d+) MB"], ["payload", "total"]),
    ],
)


@query("""select user_id as file, 8*event_id + (case when event_id % 2 = 0 then 4 else 3 end) as at, (1+user_id%32)::bigint node_num, event_type task, (event_id % 64)::bigint payload,
case when event_id % 2 = 0 then value::decimal(18,2)::double end overhead, event_id as total from events where user_id is not null""")
def q_log_graph(spark, sf_dir):
    """Records of a header and one of two branches, by a graph of patterns."""
    found = logs.graph(branched(spark, sf_dir), BRANCHES)
    whole = {c: F.col(c).cast("long") for c in ("node_num", "payload", "total")}
    return found.withColumns(whole | {"overhead": F.col("overhead").cast("double")})


@query("""select 8*event_id + (case when event_id % 2 = 0 then 4 else 3 end) as at, (1+user_id%32)::bigint node_num, event_type task, (event_id % 64)::bigint payload,
case when event_id % 2 = 0 then value::decimal(18,2)::double end overhead, event_id as total from events where user_id is not null""")
def q_log_segments(spark, sf_dir):
    """The records of all users as one log, read in segments of about 150 events."""
    one = branched(spark, sf_dir).withColumn("file", F.lit("all"))
    whole = {c: F.col(c).cast("long") for c in ("node_num", "payload", "total")}
    found = logs.graph(one, BRANCHES, segment=1200).withColumns(whole | {"overhead": F.col("overhead").cast("double")})
    return found.select("at", "node_num", "task", "payload", "overhead", "total")


@query("""with e as (select user_id as file, event_id, event_id % 3 = 0 as broken, lag(event_id % 3 = 0) over (partition by user_id order by event_id) as after_broken from events where user_id is not null)
select file, count(*) filter (not broken)::bigint as records, count(*) filter (after_broken)::bigint as faults from e group by file""")
def q_log_faults(spark, sf_dir):
    """Records and faults a file, where every third event has a header only."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    head = F.concat(F.lit("srun -N="), (1 + F.col("user_id") % 32).cast("string"), F.lit(" --ntasks-per-node=2 "), "event_type")
    done = F.concat(F.lit("Finished in "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" s at noon"))
    rows = e.select(F.col("user_id").alias("file"), F.posexplode(F.when(F.col("event_id") % 3 == 0, F.array(head)).otherwise(F.array(head, done))).alias("p", "line"), "event_id")
    lines = rows.select("file", (2 * F.col("event_id") + F.col("p")).alias("at"), "line")
    found = logs.linear(lines, [r"srun -N=(\d+) --ntasks-per-node=\d+ (.+)", r"Finished in (.+) s at .*"], ["node_num", "task", "total_time"])
    counts = found.groupBy("file").agg(F.count_if(F.col("fault").isNull()).alias("records"), F.count_if(F.col("fault").isNotNull()).alias("faults"))
    return e.select(F.col("user_id").alias("file")).distinct().join(counts, "file", "left").select("file", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


@query("select event_id, (value::decimal(18,2) + event_id)::double as overhead from events")
def q_log_overhead(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("decimal(18,2)").alias("a"), F.col("event_id").cast("decimal(18,0)").alias("b"))
    return e.select("event_id", logs.overhead("a", "b").cast("double").alias("overhead"))
