"""Filters that tell what they have seen, sketches, the keyed stream, stored layouts and observed totals."""

import random

import pytest
from pyspark.sql import functions as F

from tesserine.functions import bases, hashing
from tesserine.operators import kmers, matrices, observed, sketches
from tesserine.sources import files
from tesserine.streaming import keyed


def located(spark, keys, size):
    word, mask = sketches.located(F.col("k"), size)
    return {r.k: (r.w, r.m & (1 << 64) - 1) for r in spark.createDataFrame([(k,) for k in sorted(set(keys))], "k long").select("k", word.alias("w"), mask.alias("m")).collect()}


@pytest.mark.parametrize("error", [0.5, 0.01])
def test_added_is_sequential(spark, error):
    """The same answers as one filter that takes the keys one by one, false ones included."""
    rng = random.Random(3)
    rows = [(rng.randrange(400), i, rng.choice(["x", None])) for i in range(3000)] + [(7, 3000 + i, "hot") for i in range(2000)]
    size = sketches.Size.of(400, error)
    place, words, want = located(spark, [r[0] for r in rows], size), {}, {}
    for k, i, _ in rows:
        w, m = place[k]
        want[i] = words.get(w, 0) & m == m
        words[w] = words.get(w, 0) | m
    df = spark.createDataFrame(rows, "k long, i int, `a.b` string").repartition(5)
    found = sketches.added(df.toDF("k", "i", "c"), F.col("k"), size, "i").collect()
    assert {r.i: r.seen for r in found} == want and sorted((r.k, r.i, r.c) for r in found) == sorted(rows, key=lambda r: (r[0], r[1]))
    first = {k: i for k, i, _ in reversed(rows)}
    wrong = sum(want[i] for i in first.values())  # keys that are seen although they are new
    assert 0 < wrong if error > 0.1 else wrong <= 0.03 * len(first)
    assert sketches.added(df.toDF("k", "i", "c").limit(0), F.col("k"), size, "i").collect() == []


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_filter_as_value_or_table(spark, most):
    """Both ways keep the same rows: all that the filter holds, and the same false ones."""
    held, asked = spark.range(0, 3000, 3), spark.range(6000).withColumn("x", F.lit("a"))
    size = sketches.Size.of(1000, 0.05)
    filter_ = sketches.built(held, F.col("id"), size)
    some = sketches.possible(asked, F.col("id"), filter_, size, most)
    assert some.columns == ["id", "x"]
    got = {r.id for r in some.collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1000 + 5000 * 0.12
    assert got == {r.id for r in sketches.possible(asked, F.col("id"), filter_, size).collect()}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join Inner" in plan.split("Subquery")[0]) == (most == 0)
    wide = sketches.classic(held, F.col("id"), size)
    one = {r.id for r in sketches.classic_possible(asked, "id", wide, size, most).collect()}
    assert one >= set(range(0, 3000, 3)) and len(one) < 1000 + 5000 * 0.1
    assert one == {r.id for r in sketches.classic_possible(asked, "id", wide, size).collect()}
    assert sketches.possible(asked, F.col("id"), sketches.cleared(filter_), size, most).count() == 0


@pytest.mark.parametrize("k", [11, 40])
def test_two_passes(spark, sf_dir, k):
    reads = spark.read.parquet(f"{sf_dir}/documents.parquet").select(bases.read_of(F.col("text")).alias("s"))
    every = {r.kmer: r.cnt for r in kmers.counts(reads, k).collect()}
    got = {r.kmer: r.cnt for r in kmers.unpacked_counts(kmers.repeats_only(reads, k, error=0.05), k).collect()}
    assert {x: n for x, n in got.items() if n > 1} == {x: n for x, n in every.items() if n > 1}
    once = sum(n == 1 for n in every.values())
    assert once > 1000 and sum(n == 1 for n in got.values()) <= 0.1 * once and all(every[x] == n for x, n in got.items())


def test_sketches_unite(spark):
    df = spark.range(40_000).select((F.col("id") % 4).alias("part"), (F.col("id") % 9000).alias("k"))
    kept = sketches.distinct_sketches(df, F.col("k"), "part", bits=14)
    for r in sketches.united(kept, "part").collect():
        assert abs(r.estimate - df.filter(F.col("part") == r.part).select("k").distinct().count()) <= 0.05 * 9000
    assert abs(sketches.united(kept).first().estimate - 9000) <= 450
    assert sketches.united(kept.limit(0), "part").collect() == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ask long, stamp string, value long")


def test_keyed_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    def batch(number, rows):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("key string, ask long, stamp string, value long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return keyed.run(stream, -1, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))

    batch(0, [("a", None, "2", 20), ("a", None, "1", 10), ("b", 1, None, None), ("a", 2, None, None)])
    found = run()
    assert sorted(map(tuple, keyed.answers(found).collect())) == [("a", 2, 10), ("b", 1, -1)]
    assert {r.key: r.value for r in keyed.table(found).collect()} == {"a": 10}
    # another start: the state is there, a later write does not win, an earlier stamp does
    batch(1, [("a", None, "3", 30), ("a", 3, None, None), ("b", None, "5", 50), ("b", 4, None, None)])
    batch(2, [("b", None, "4", 40), ("b", 5, None, None), ("c", 6, None, None)])
    found = run()
    got = {(r.key, r.ask): r.value for r in keyed.answers(found).collect()}
    assert got[("a", 3)] == 10 and got[("c", 6)] == -1 and got[("b", 5)] in (40,) and got[("b", 4)] in (40, 50) and len(got) == 6
    assert {r.key: r.value for r in keyed.table(found).collect()} == {"a": 10, "b": 40}
    assert sorted(map(str, run().collect())) == sorted(map(str, found.collect()))  # nothing new, nothing twice


def test_stored_layout_does_not_move(spark):
    rng = random.Random(2)
    cells = [(rng.randrange(50), rng.randrange(40), float(rng.randrange(9))) for _ in range(600)]
    matrix = spark.createDataFrame(cells, "row long, col long, val double")
    vectors = [{c: rng.randrange(5) for c in range(40)} for _ in range(2)]
    frames = [spark.createDataFrame(sorted(v.items()), "idx long, x long") for v in vectors]
    for y, v in zip(matrices.products(matrix, frames, 4), vectors, strict=True):
        want = {}
        for r, c, x in cells:
            want[r] = want.get(r, 0) + x * v[c]
        assert {r.row: r.y for r in y.collect()} == want
        plan = y._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        assert "Exchange" not in join.split("Initial Plan")[0] and "Bucketed: true" in join


def test_observed_totals(spark):
    tracker = spark.sparkContext.statusTracker()
    watch = observed.Watch("read")
    rows = watch.on(spark.range(100, numPartitions=3), "reads", n=F.count("*"), sum=F.sum("id"))
    rows = watch.on(rows.filter("id % 2 = 0"), "even reads", n=F.count("*"))
    rows = watch.on(rows, "other", n=F.count("*"))
    spark.sparkContext.setJobGroup("observed", "one job")
    watch.timed("reads", lambda: rows.write.format("noop").mode("overwrite").save())
    assert watch.totals("reads") == {"n": 100, "sum": 4950} and watch.totals("even reads") == {"n": 50} and watch.totals("other") == {}
    assert len(tracker.getJobIdsForGroup("observed")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    steps, total, mean = watch.seconds("reads")
    assert steps == 1 and total == mean > 0 and watch.seconds("other") == (0, 0, 0.0)


def test_mix(spark):
    top = 1 << 64

    def mixed(x):
        x = (~x + (x << 21)) % top
        x = (x ^ x >> 24) * 265 % top
        x = (x ^ x >> 14) * 21 % top
        return (x ^ x >> 28) * ((1 << 31) + 1) % top

    rng = random.Random(9)
    rows = [0, 1, -1, -(1 << 63), (1 << 63) - 1, *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in rows], "x long")
    size = sketches.Size(7, 5, chain=True)
    word, mask = sketches.located(F.col("x"), size)
    for r in df.select("x", hashing.mix64(F.col("x")).alias("m"), word.alias("w"), mask.alias("b"), hashing.unsigned_mod(F.col("x"), 1000).alias("u")).collect():
        h = mixed(r.x % top)
        assert r.m % top == h and r.w == h % 7 and r.u == r.x % top % 1000
        bits = 0
        for _ in range(5):
            h = mixed(h)
            bits |= 1 << h % 64
        assert r.b % top == bits


def test_unsorted_matrices_are_refused(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate real general\n3 3 3\n"
    (tmp_path / "a.mtx").write_text(head + "1 2 5\n1 2 6\n3 1\n")
    assert sorted(map(tuple, files.matrix(spark, str(tmp_path / "a.mtx")).collect())) == [(0, 1, 5.0), (0, 1, 6.0), (2, 0, 1.0)]
    for body in ("2 1 1\n1 1 1\n", "1 2 1\n1 1 1\n"):
        (tmp_path / "b.mtx").write_text(head + body)
        with pytest.raises(Exception, match="entries are not sorted"):
            files.matrix(spark, str(tmp_path / "b.mtx")).collect()


def test_chained_places_come_by_batches(spark):
    """Not by a function for each bit of each row; keys that are null have no place, others in their batch do."""
    size = sketches.Size(97, 6, chain=True)
    df = spark.createDataFrame([(None,), (0,), (-1,), (1 << 62,), (5,)], "x long")
    word, mask = sketches.located(F.col("x"), size)
    rows = df.select("x", word.alias("w"), mask.alias("m"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "transform(" not in plan
    got = {r.x: (r.w, r.m) for r in rows.collect()}
    assert got[None] == (None, None) and len(got) == 5 and all(0 <= w < 97 for x, (w, _) in got.items() if x is not None)
    plain = df.filter("x is not null").select("x", sketches.located(F.col("x"), size)[1].alias("m"))
    assert all(got[r.x][1] == r.m for r in plain.collect())
    held = sketches.as_value(spark.createDataFrame([(2, 7), (0, 5)], "word long, bits long"), sketches.Size(4, 1))
    assert "lambda" not in spark.range(1).select(held)._jdf.queryExecution().optimizedPlan().toString() and spark.range(1).select(held).first()[0] == [5, 0, 7, 0]
