"""Queries over k-mers of the documents' letters, and over chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import bases, text
from tesserine.operators import chains, kmers, observed, tables
from tesserine.plans.registry import query
from tesserine.session import stored, table

K = bases.K
READS = "r as (select doc_id, lang, translate(upper(regexp_replace(lower(text),'[^acgtn]','','g')),'N','G') s from documents)"
WINDOWS = f"{READS}, k as (select doc_id, lang, unnest(list_transform(range(2, length(s)-{K}+1), lambda i: substr(s,i::int,{K}))) km from r where length(s) >= {K + 2})"
COUNTS = f"{WINDOWS}, c as (select least(km, reverse(translate(km,'ACGT','TGCA'))) kmer, count(*)::bigint cnt from k group by 1)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", bases.read_of(F.col("text")).alias("s"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.counts(reads(spark, sf_dir))


@query(f"with {COUNTS} select kmer, cnt from c where cnt >= 2")
def q_kmer_count(spark, sf_dir):
    return kmers.repeated(reads(spark, sf_dir))


@query(f"with {COUNTS} select kmer, cnt from c where cnt >= 2 order by kmer")
def q_kmer_count_sorted(spark, sf_dir):
    return kmers.repeated(reads(spark, sf_dir)).orderBy("kmer")


def packed_counts_sql(k: int) -> str:
    return f"select {k} as k, least(km, reverse(translate(km,'ACGT','TGCA'))) as kmer, count(*)::bigint as cnt from (select unnest(list_transform(range(2, length(s)-{k}+1), lambda i: substr(s,i::int,{k}))) as km from r where length(s) >= {k + 2}) group by 1, 2 having count(*) >= 2"


@query(f"with {READS} " + " union all ".join(map(packed_counts_sql, (13, 31, 51))))
def q_kmer_packed(spark, sf_dir):
    """Counts of at least 2 for three widths, with keys of one and two longs."""
    out = None
    for k in (13, 31, 51):
        own = kmers.unpacked_counts(kmers.packed_counts(reads(spark, sf_dir), k).filter("cnt >= 2"), k).select(F.lit(k).alias("k"), "kmer", "cnt")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"with {COUNTS} select kmer, cnt from c where cnt >= 2")
def q_kmer_two_pass(spark, sf_dir):
    """Repeated k-mers by two filters and a second pass."""
    return kmers.unpacked_counts(kmers.repeats_only(reads(spark, sf_dir)).filter("cnt >= 2"), K)


@query(f"with {COUNTS} select count(*) filter (cnt >= 2)::bigint as repeats, count(*) filter (cnt >= 2)::bigint as counted, true as few_admitted from c")
def q_kmer_two_pass_error(spark, sf_dir):
    """Repeated k-mers, those that the two filters let through, and whether few that occur once came with them."""
    error, n = 0.05, F.col("cnt")
    partials = stored(kmers.packed_partials(reads(spark, sf_dir)), "kmers")
    met = kmers.repeats_of(partials, error).select("cnt", F.lit(1).alias("met")).unionByName(kmers.summed(partials).select("cnt", F.lit(0).alias("met")))
    count = lambda test: F.count_if(test)
    few = count((n == 1) & (F.col("met") == 1)) <= F.greatest(F.lit(3), count((n == 1) & (F.col("met") == 0)) * 2 * error)
    return met.agg(count((n >= 2) & (F.col("met") == 0)).alias("repeats"), count((n >= 2) & (F.col("met") == 1)).alias("counted"), few.alias("few_admitted"))


def packed_canonical_sql(k: int) -> str:
    return f"select {k} as k, doc_id, least(km, reverse(translate(km,'ACGT','TGCA'))) as canonical from (select doc_id, substr(s, 1, {k}) as km from r where length(s) >= {k})"


@query(f"with {READS} " + " union all ".join(map(packed_canonical_sql, (13, 31, 51))))
def q_kmer_key_canonical(spark, sf_dir):
    """The canonical form of each read's first k-mer, by shifts and masks of its key. Reads are made once, for all widths."""
    widths = (13, 31, 51)
    starts = reads(spark, sf_dir).select("doc_id", F.substring("s", 1, max(widths)).alias("s"))
    # each width in a column of its own: inside a condition words would be written out anew at every use, and the code grow too long to compile
    least = [bases.kmer_of(bases.canonical_key(bases.key_of(F.substring("s", 1, k), k), k), k).alias(f"c{k}") for k in widths]
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("canonical")) for k in widths))).alias("x")
    own = starts.select("doc_id", "s", *least).select("doc_id", F.length("s").alias("n"), every)
    return own.filter(F.col("n") >= F.col("x.k")).select("x.k", "doc_id", "x.canonical")


@query(f"with {READS}, w as (select doc_id, unnest(list_transform(range(1, length(s)-{K}+2), lambda i: substr(s,i::int,{K}))) km from r where length(s) >= {K}) select doc_id, count(*)::bigint n, min(km) first_kmer, max(km) last_kmer from w group by doc_id")
def q_kmer_explode(spark, sf_dir):
    return kmers.extremes(reads(spark, sf_dir), "doc_id")


@query(f"with {READS} select doc_id, s from r")
def q_base_encode(spark, sf_dir):
    return reads(spark, sf_dir).select("doc_id", "s")


@query(f"with {READS} select doc_id, reverse(translate(s,'ACGT','TGCA')) rc from r")
def q_revcomp(spark, sf_dir):
    return reads(spark, sf_dir).select("doc_id", bases.revcomp(F.col("s")).alias("rc"))


@query(f"with {READS} select doc_id, least(s, reverse(translate(s,'ACGT','TGCA'))) canonical from r")
def q_canonical(spark, sf_dir):
    return reads(spark, sf_dir).select("doc_id", bases.canonical(F.col("s")).alias("canonical"))


@query(f"with {COUNTS} select kmer, b base, substr(kmer,2)||b fwd, b||substr(kmer,1,{K - 1}) bwd from c, unnest(['A','C','G','T']) t(b) where cnt >= 2")
def q_kmer_neighbors(spark, sf_dir):
    base = F.explode(F.array(*map(F.lit, "ACGT"))).alias("base")
    rows = kmers.repeated(reads(spark, sf_dir)).select("kmer", base)
    return rows.withColumns({"fwd": bases.forward(F.col("kmer"), F.col("base")), "bwd": bases.backward(F.col("kmer"), F.col("base"))})


@query(f"""with {READS}, w as (select s, unnest(range(2, length(s)-{K}+1)) i from r where length(s) >= {K + 2}),
e as (select substr(s,i::int,{K}) km, substr(s,i::int-1,1) b, substr(s,i::int+{K},1) f from w),
n as (select substr(km,2)||f kmer, 1 a, 0 z from e union all select b||substr(km,1,{K - 1}), 0, 1 from e)
select kmer, sum(a)::bigint n_next, sum(z)::bigint n_last from n group by kmer""")
def q_next_prev_kmer(spark, sf_dir):
    return kmers.sides(reads(spark, sf_dir))


@query(f"with {COUNTS} select kmer, list_reduce(list_transform(string_split(rpad(translate(kmer,'ACGT','0123'),12,'0'),''), lambda x: x::bigint), lambda a, x: a*4+x)::bigint packed from c where cnt >= 2")
def q_pack_2bit(spark, sf_dir):
    return kmers.repeated(reads(spark, sf_dir)).select("kmer", bases.packed(F.col("kmer")).alias("packed"))


def packed_sql(k: int) -> str:
    """Windows of k bases packed to a signed number of 64 bits, and unpacked again."""
    width = 4 * ((k + 3) // 4)
    number = f"list_reduce(list_transform(string_split(rpad(translate(km,'ACGT','0123'),{width},'0'),''), lambda x: x::hugeint), lambda a, x: a*4+x)"
    signed = f"(case when {number} >= 9223372036854775808::hugeint then {number} - 18446744073709551616::hugeint else {number} end)::bigint"
    return f"with {READS}, w as (select doc_id, substr(s, 1, {k}) km from r where length(s) >= {k}) select doc_id, {signed} as packed, km as unpacked from w"


def packed_starts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    km = reads(spark, sf_dir).filter(F.length("s") >= k).select("doc_id", bases.packed(F.substring("s", 1, k), k).alias("packed"))
    return km.withColumn("unpacked", bases.unpacked(F.col("packed"), k))


@query(packed_sql(13))
def q_pack_13(spark, sf_dir):
    return packed_starts(spark, sf_dir, 13)


@query(packed_sql(31))
def q_pack_31(spark, sf_dir):
    return packed_starts(spark, sf_dir, 31)


@query(f"with {READS} select doc_id, substr(s, 1, 51) as kmer, 2::bigint as words from r where length(s) >= 51")
def q_unpack_51(spark, sf_dir):
    """51 bases packed to words and unpacked again."""
    w = reads(spark, sf_dir).filter(F.length("s") >= 51).select("doc_id", bases.packed_words(F.substring("s", 1, 51), 51).alias("w"))
    return w.select("doc_id", bases.unpacked_words(F.col("w"), 51).alias("kmer"), F.size("w").cast("long").alias("words"))


@query("select p_partkey, (list_reduce(list_prepend(5381::hugeint, list_transform(string_split(p_name,''), lambda x: ascii(x)::hugeint)), lambda h, b: (b+33*h)%18446744073709551616::hugeint))::varchar as hash from part")
def q_djb2_wrapped(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bases.djb2_wrapped(F.col("p_name")).cast("string").alias("hash"))


@query("select p_partkey, list_reduce(list_prepend(5381::bigint, list_transform(string_split(p_name,''), lambda x: ascii(x)::bigint)), lambda h, b: (b+33*h)%2147483647)::bigint hash from part")
def q_djb2_mod(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bases.djb2(F.col("p_name")).alias("hash"))


@query(f"with {COUNTS} select t::bigint threshold, count(*) filter (cnt < t)::bigint purged, count(*) filter (cnt >= t)::bigint kept from c, unnest([2,3]) x(t) group by t")
def q_kmer_purge_stats(spark, sf_dir):
    rows = counts(spark, sf_dir).groupBy(F.least("cnt", F.lit(3)).alias("c")).agg(F.count("*").alias("n"))
    t = rows.select("c", "n", F.explode(F.array(F.lit(2), F.lit(3))).alias("threshold"))
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return t.groupBy(F.col("threshold").cast("long").alias("threshold")).agg(part(F.col("c") < F.col("threshold")).alias("purged"), part(F.col("c") >= F.col("threshold")).alias("kept"))


@query(f"with {COUNTS} select kmer from c where cnt = 1")
def q_singletons(spark, sf_dir):
    return counts(spark, sf_dir).filter("cnt = 1").select("kmer")


@query(f"""with {WINDOWS}, u as (select lang, count(*)::bigint total, count(distinct least(km, reverse(translate(km,'ACGT','TGCA'))))::bigint uniq from k group by lang)
select lang, total, uniq, uniq::varchar||' ('||((20000*uniq+total)//(2*total)//100)::varchar||'.'||lpad(((20000*uniq+total)//(2*total)%100)::varchar,2,'0')||'%)' ratio from u""")
def q_unique_ratio(spark, sf_dir):
    pairs = kmers.canonical(reads(spark, sf_dir), keep=("lang",)).groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    u = pairs.groupBy("lang").agg(F.sum("n").cast("long").alias("total"), F.count("*").alias("uniq"))
    return u.withColumn("ratio", text.perc_str(F.col("uniq"), F.col("total")))


@query(f"with {READS} select lang, count(*)::bigint reads, (4*count(*))::bigint lines, sum(case when length(s) >= {K + 2} then length(s)-{K + 1} else 0 end)::bigint kmers from r group by lang")
def q_read_totals(spark, sf_dir):
    n = F.length("s")
    return reads(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("reads"), (4 * F.count("*")).alias("lines"), F.sum(F.when(n >= K + 2, n - (K + 1)).otherwise(0)).cast("long").alias("kmers"))


@query(f"with {READS} select count(*)::bigint reads, (4*count(*))::bigint lines, sum(length(s))::bigint bases, sum(case when length(s) >= {K + 2} then length(s)-{K + 1} else 0 end)::bigint kmers from r")
def q_read_totals_observed(spark, sf_dir):
    """Totals of the reads that the one job that writes them out leaves behind."""
    n, watch = F.length("s"), observed.Watch("read")
    rows = watch.on(reads(spark, sf_dir), "reads written", reads=F.count("*"), lines=4 * F.count("*"), bases=F.sum(n).cast("long"), kmers=F.sum(F.when(n >= K + 2, n - (K + 1)).otherwise(0)).cast("long"))
    stored(rows, "reads")
    return spark.createDataFrame([watch.totals("reads written")], "reads bigint, lines bigint, bases bigint, kmers bigint")


@query(f"with {READS} select count(*)::bigint records, sum(greatest(length(s)-{K}+1,0))::bigint kmers from r")
def q_estimate_kmers(spark, sf_dir):
    return reads(spark, sf_dir).agg(F.count("*").alias("records"), F.sum(F.greatest(F.length("s") - K + 1, F.lit(0))).cast("long").alias("kmers"))


SAMPLED = f"""with {READS}, f as (select lang, s, n_chars, row_number() over (partition by lang order by doc_id) as nth from r join (select doc_id as d, n_chars from documents) on d = doc_id),
w as (select lang, sum(n_chars)::bigint as whole from f group by lang),
p as (select lang, count(*)::bigint as n_read, sum(n_chars)::bigint as bytes, sum(case when nth <= 20 and length(s) >= {K} then length(s) - {K} + 1 else 0 end)::bigint as kmers from f where nth <= 21 group by lang),
t as (select sum(n_read)::bigint as n_read, sum(kmers)::bigint as kmers, sum(whole // (bytes // n_read))::bigint as n_all from p join w using (lang))
select floor(n_read / (n_read::double / n_all))::bigint records, floor(4 * n_read / (n_read::double / n_all))::bigint as lines, floor(kmers / (n_read::double / n_all))::bigint kmers from t"""


@query(SAMPLED)
def q_estimate_sampled(spark, sf_dir):
    """The estimate from the first records of each file; a language's documents stand for a file, with a limit of 20 records."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", bases.read_of(F.col("text")).alias("s"))
    return kmers.estimated(rows, "lang", "doc_id", F.col("n_chars"), 20)


@query(f"with {COUNTS} select count(*)::bigint size from c")
def q_dht_size(spark, sf_dir):
    return counts(spark, sf_dir).agg(F.count("*").alias("size"))


@query(f"""with {COUNTS}, p as (select (cnt % 8)::bigint as part, count(*)::bigint n from c group by 1), a as (select ((count(*) * 11025 // 10000 + 1000) * 2)::bigint as capacity from c)
select sum(n)::bigint as size, any_value(capacity) as capacity, round(avg(n * 8.0 / capacity), 9) as load, sum(n)::bigint // 8 as average from p, a""")
def q_dht_load(spark, sf_dir):
    """Size, presized capacity, mean load of eight parts and whole mean keys of a part."""
    parts = counts(spark, sf_dir).groupBy((F.col("cnt") % 8).alias("part")).agg(F.count("*").alias("n"))
    return tables.loaded(parts, "n", 8)


@query(f"""with {COUNTS}, b as (select item_id, translate(upper(regexp_replace(lower(text),'[^acgtn]','','g')),'N','G') s from benchmark),
w as (select item_id, unnest(list_transform(range(1, length(s)-{K}+2), lambda i: substr(s,i::int,{K}))) km from b where length(s) >= {K}),
q as (select distinct item_id, least(km, reverse(translate(km,'ACGT','TGCA'))) kmer from w)
select item_id, q.kmer, coalesce(cnt,0)::bigint cnt from q left join c using (kmer)""")
def q_kmer_lookup(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", bases.read_of(F.col("text")).alias("s"))
    keys = kmers.canonical(b, trim=0, keep=("item_id",)).distinct()
    return kmers.looked_up(keys, kmers.counts_of(reads(spark, sf_dir), keys)).select("item_id", "kmer", "cnt")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as nodes: each turn but the first follows the one before it."""
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    return c.select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("before"), F.substring("role", 1, 1).alias("value"), "conv_id")


CHAIN = "g as (select conv_id, turn, role, turn - row_number() over (partition by conv_id order by turn) + 1 as gap from conversations), w as (select * from g where gap = 0)"


@query("select conv_id, max(turn) as turn from conversations group by conv_id")
def q_chain_stops(spark, sf_dir):
    """Rows that no other follows."""
    n = nodes(spark, sf_dir)
    stops = chains.stops(n.select("id", "before", "conv_id"))
    return stops.select("conv_id", F.substring_index("id", "/", -1).cast("long").alias("turn"))


@query("select conv_id, turn from conversations where turn = 0")
def q_chain_starts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", "turn")


@query(f"with {CHAIN} select conv_id::varchar||'/0' as start, count(*)::bigint n from w group by conv_id")
def q_chain_length(spark, sf_dir):
    return chains.ends(nodes(spark, sf_dir).select("id", "before")).filter("whole").groupBy("start").agg(F.count("*").alias("n"))


@query(f"with {CHAIN} select conv_id::varchar||'/0' as start, count(*)::bigint n, string_agg(substr(role,1,1), '' order by turn) contig from w group by conv_id")
def q_contigs(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return chains.strings(chains.ends(n.select("id", "before")), n.select("id", "value"))


@query(f"with {CHAIN} select count(distinct conv_id)::bigint contigs, count(*)::bigint nodes, count(*) filter (turn = 0)::bigint starts from w")
def q_contig_stats(spark, sf_dir):
    found = chains.ends(nodes(spark, sf_dir).select("id", "before")).filter("whole")
    return found.groupBy("start").agg(F.count("*").alias("n")).agg(F.count("*").alias("contigs"), F.sum("n").cast("long").alias("nodes"), F.count("*").alias("starts"))
