"""Readers and writers by round trip, parser graphs against hand-made logs, packing of any width, late rows of streams."""

import datetime
import gzip
import os

import pytest
from pyspark.sql import functions as F

from tesserine.functions import bases, text
from tesserine.operators import calls, chains, kmers, logs, matrices, sketches, tables
from tesserine.sources import files, sinks
from tesserine.streaming import counters, keyed


def lines_of(path):
    return sorted(x for p in path.glob("part-*") for x in (gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read().splitlines())


def test_writers(spark, tmp_path):
    sinks.kmer_dump(spark.createDataFrame([("ACG", 3), ("TTT", 2)], "kmer string, cnt long"), str(tmp_path / "dump"))
    assert lines_of(tmp_path / "dump") == ["ACG 3", "TTT 2"] and all(p.suffix == ".gz" for p in (tmp_path / "dump").glob("part-*"))
    sinks.contigs(spark.createDataFrame([("s", "ACGT")], "start string, contig string"), str(tmp_path / "contigs"))
    assert lines_of(tmp_path / "contigs") == ["ACGT"]
    sinks.product(spark.createDataFrame([(0, 1.5), (9, 2.0)], "row long, y double"), str(tmp_path / "y"), rows=5)
    assert lines_of(tmp_path / "y") == ["0\t1.5"]
    logged = spark.createDataFrame([("b", 2), ("a", 1)], "task string, node_num int")
    sinks.log_csv(logged, str(tmp_path / "csv"), "task")
    assert sorted(map(tuple, files.csv_table(spark, str(tmp_path / "csv")).collect())) == [("a", 1), ("b", 2)]
    sinks.json_state(logged, str(tmp_path / "json"))
    assert sorted((r.task, r.node_num) for r in files.json_state(spark, str(tmp_path / "json")).collect()) == [("a", 1), ("b", 2)]


def test_readers(spark, tmp_path):
    sinks.kmer_rows(spark.createDataFrame([("ACGTA", "F", "C")], "kmer string, b_ext string, f_ext string"), str(tmp_path / "k"))
    assert files.kmer_width(spark, str(tmp_path / "k")) == 5
    assert [tuple(r) for r in files.kmer_table(spark, str(tmp_path / "k"), 5).collect()] == [("ACGTA", "F", "C")]
    (tmp_path / "a.log").write_text("x\ny\n")
    (tmp_path / "b.log").write_text("z\n")
    got = sorted((r.file[-5:], r.at, r.line) for r in files.log_lines(spark, str(tmp_path / "*.log")).collect())
    assert got == [("a.log", 0, "x"), ("a.log", 1, "y"), ("b.log", 0, "z")]


def test_generators(spark):
    n = 20_000
    v = [r.v for r in files.exponential_ints(spark, n, 4.0, 1000, 3).collect()]
    assert len(v) == n and min(v) >= 0 and max(v) < 1000 and abs(sum(v) / n - 238) < 15  # mean 250, less what folds over
    u = [r.v for r in files.uniform_ints(spark, n, 64, 3).collect()]
    assert set(u) == set(range(64)) and abs(sum(u) / n - 31.5) < 1


@pytest.mark.parametrize("k", [1, 4, 11, 13, 16, 29, 31, 32, 51, 64])
def test_packing(spark, k):
    reads = ["ACGT" * 16, "T" * 64, "A" * 64, "GATTACA" * 10]
    df = spark.createDataFrame([(r[:k],) for r in reads], "s string")
    s = F.col("s")
    if k <= 32:
        rows = df.select("s", bases.packed(s, k).alias("p")).select("s", "p", bases.unpacked(F.col("p"), k).alias("u")).collect()
        for r in rows:
            value = int("".join(str("ACGT".index(c)) for c in r.s).ljust(4 * ((k + 3) // 4), "0"), 4)
            assert r.p % (1 << 64) == value and r.u == r.s
        assert len({r.p for r in rows}) == len({r.s for r in rows})
    else:
        with pytest.raises(ValueError):
            bases.packed(s, k)
    assert all(r.u == r.s for r in df.select("s", bases.unpacked_words(bases.packed_words(s, k), k).alias("u")).collect())


def test_hash_and_complement(spark):
    df = spark.createDataFrame([("",), ("abc",), ("x" * 40,)], "s string")

    def djb2(s):
        h = 5381
        for c in s.encode():
            h = (c + 33 * h) % (1 << 64)
        return h

    assert all(int(r.h) == djb2(r.s) for r in df.select("s", bases.djb2_wrapped(F.col("s")).alias("h")).collect())
    assert spark.range(1).select(bases.strict_revcomp(F.lit("ACN0"))).first()[0] == "0NGT"
    with pytest.raises(Exception, match="not a base"):
        spark.range(1).select(bases.strict_revcomp(F.lit("ACX"))).collect()


def test_canonical_windows(spark):
    reads = ["ACGTTGCATTA", "AC", "", "GGGGGGG"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "n long, s string")
    for trim in (0, 1):
        got = sorted((r.n, r.kmer) for r in kmers.canonical(df.withColumnRenamed("n", "read"), 3, trim, ("read",)).toDF("n", "kmer").collect())
        windows = [(i, s[at : at + 3]) for i, s in enumerate(reads) for at in range(trim, len(s) - 2 - trim)]
        assert got == sorted((i, min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))) for i, x in windows)


def test_counts_of_keys(spark):
    df = spark.createDataFrame([("CACGTAGGTCACGTA",), ("CACGTAC",)], "s string")
    every = {r.kmer: r.cnt for r in kmers.counts(df, 5).collect()}
    keys = spark.createDataFrame([(k,) for k in [*list(every)[:2], "AAAAA"]], "kmer string")
    assert {r.kmer: r.cnt for r in kmers.counts_of(df, keys, 5).collect()} == {k: every[k] for k in list(every)[:2]}


def test_sampled_estimate(spark):
    rows = [("a", i, "ACGTA", 10) for i in range(50)] + [("b", i, "ACG", 10) for i in range(10)]
    df = spark.createDataFrame(rows, "f string, i long, s string, size long")
    row = kmers.estimated(df, "f", "i", F.col("size"), 9, 5).first()
    # 10 records of each are read of 60; the tenth is counted as read, its k-mers are not
    assert (row.records, row.lines, row.kmers) == (60, 240, 27)


def test_long_and_cyclic_chains(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(100)] + [(f"r{i}", f"r{(i - 1) % 7}") for i in range(7)] + [("tail", "r3")]
    found = chains.ends(spark.createDataFrame(rows, "id string, before string"))
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows) and all(got[f"c{i}"].start == "c0" and got[f"c{i}"].place == i and got[f"c{i}"].whole for i in range(100))
    nodes = spark.createDataFrame(rows, "id string, before string")
    assert {r.id for r in chains.cycles(found, nodes).collect()} == {*(f"r{i}" for i in range(7)), "tail"}
    assert {r.id for r in chains.stops(nodes).collect()} == {"c99", "tail"}


def test_classic_filter(spark):
    size = sketches.Size.of(500, 0.01)
    f = sketches.classic(spark.range(500), F.col("id"), size)
    found = {r.id for r in sketches.classic_possible(spark.range(1000), "id", f, size).collect()}
    assert found >= set(range(500)) and len(found) < 550
    assert sketches.memory(size) == 8 * size.words and sketches.cleared(f).count() == 0
    assert sketches.classic_possible(spark.range(10), "id", sketches.cleared(f), size).count() == 0


def test_tables_of_ones_own_equality(spark):
    rows = spark.createDataFrame([("A", 1, 2), ("a", 2, 1), ("b", 3, 0)], "k string, v int, at int")
    assert {r.key: r.v for r in tables.inserted_by(rows, F.lower("k"), "v", "at").collect()} == {"a": 2, "b": 3}
    assert spark.range(1).select(tables.presized(F.lit(100))).first()[0] == (110 + 1000) * 2


def test_calls_meet_at_their_target(spark):
    from pyspark import TaskContext

    import pyarrow as pa

    asked = spark.range(200).select((F.col("id") % 5).alias("target"), "id")
    rows = calls.called(asked, lambda b: pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int64()), "bigint", "target").collect()
    assert len(rows) == 200 and all(len({r.result for r in rows if r.target == t}) == 1 for t in range(5))


def test_slices_end_at_the_shape(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (2, 1, 2.0), (3, 3, 4.0)], "row long, col long, val double")
    assert sorted(map(tuple, matrices.sliced(m, (2, 9), (1, 9), (4, 4)).collect())) == [(0, 0, 2.0), (1, 2, 4.0)]
    assert [tuple(r) for r in matrices.by_column(m).collect()] == [(0, 0, 1.0), (2, 1, 2.0), (3, 3, 4.0)]
    y = matrices.powered(m, spark.createDataFrame([(0, 1.0), (1, 1.0), (3, 2.0)], "idx long, x double"), 2).collect()
    assert {r.idx: r.x for r in y} == {0: 1.0, 3: 32.0}


TREE = logs.Node(
    [r"srun (\d+)"],
    ["nodes"],
    [
        logs.Node([r"group (\w+)"], ["group"], [logs.Node([r"size (\d+)", r"time (\S+)", r"rate (\S+)"], ["size", "time", "rate"]), logs.Node([r"short (\d+)"], ["size"])]),
        logs.Node([r"alone (\d+)"], ["size"]),
    ],
)


def rows_of(spark, lines, make=lambda df: logs.graph(df, TREE)):
    df = spark.createDataFrame([(f, i, x) for f, xs in lines.items() for i, x in enumerate(xs)], "file string, at long, line string")
    return sorted((r.file, r.at, {k: v for k, v in r.asDict().items() if v is not None and k not in ("file", "at")}) for r in make(df).collect())


def test_parser_graph(spark):
    lines = ["size 1", "srun 2", "noise", "group g", "size 5", "??", "time -nan", "rate 1e3", "short 7", "group h", "short 8", "srun 3", "alone 9"]
    assert rows_of(spark, {"f": lines}) == [
        ("f", 7, {"nodes": "2", "group": "g", "size": "5", "time": "-nan", "rate": "1e3"}),
        ("f", 10, {"nodes": "2", "group": "h", "size": "8"}),
        ("f", 12, {"nodes": "3", "size": "9"}),
    ]


def test_parser_graph_breaks_off(spark):
    # a header inside an unfinished record is used up; one between nodes begins a record
    assert rows_of(spark, {"f": ["srun 1", "group g", "size 5", "srun 2", "alone 3", "srun 4", "alone 5"]}) == [("f", 6, {"nodes": "4", "size": "5"})]
    assert rows_of(spark, {"f": ["srun 1", "srun 2", "alone 3"], "e": ["alone 1"], "g": []}) == [("f", 2, {"nodes": "2", "size": "3"})]


def test_linear_parser(spark):
    make = lambda df: logs.linear(df, [r"a (\d)", r"b (\d)", r"c (\d)"], ["x", "y", "z"])
    lines = ["b 0", "a 1", "b 2", "a 3", "b 4", "-", "c 5", "a 6"]
    got = rows_of(spark, {"f": lines, "g": ["a 1", "b 1", "c 1"]}, make)
    assert got == [("f", 3, {"fault": "1"}), ("f", 6, {"x": "3", "y": "4", "z": "5"}), ("g", 2, {"x": "1", "y": "1", "z": "1"})]
    df = spark.createDataFrame([(1.5, 2.0)], "a double, b double")
    assert df.select(logs.overhead("a", "b")).first()[0] == 3.5


def test_late_rows(spark, tmp_path):
    def put(name, *minutes):
        rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), "k") for m in minutes]
        spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / name))

    put("w0", 5, 10, 70)
    put("w1", 15, 400)
    put("w2", 390)
    put("w3", 20, 65, 395)
    (tmp_path / "all").mkdir()
    for i in range(4):
        part = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        part.rename(tmp_path / "all" / f"{i}.parquet")
        os.utime(tmp_path / "all" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    found = counters.windowed(spark, str(tmp_path / "all"), "ts", "1 hour", "30 minutes", "k", at_once=1)
    got = {int((r.window.start - datetime.datetime(2024, 1, 1)).total_seconds()) // 3600: r.n for r in found.collect()}
    # 20 and 65 come when 400 - 30 has passed their windows; the window of 390 to 400 is still open at the end
    assert got == {0: 3, 1: 1}


def test_text_helpers(spark):
    row = spark.range(1).select(text.replaced(F.lit("aXbX"), "X", "--"), text.micros(F.lit(1500)), text.millis(F.lit(2_000_000)), text.seconds(F.lit(10**9))).first()
    assert tuple(row) == ("a--b--", 1.5, 2.0, 1.0)
    assert spark.range(1).select(text.perc_str(F.lit(1), F.lit(8))).first()[0] == "1 (12.50%)"


def test_stream_of_writes_alone(spark, tmp_path):
    """Keys written to in several batches; an earlier stamp that comes later wins."""
    parts = [[(1, "b", 10), (2, "a", 20)], [(1, "a", 11), (3, "c", None)], [(2, "b", 21), (1, "c", 12)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "key long, stamp string, value long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("key long, stamp string, value long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    checkpoint, out = str(tmp_path / "_state"), str(tmp_path / "_out")
    found = keyed.written(stream, checkpoint, out)
    assert {r.key: r.value for r in keyed.table(found).collect()} == {1: 11, 2: 20, 3: None}
    # nothing new: it goes on from its checkpoint and puts nothing out again
    assert keyed.written(stream, checkpoint, out).count() == found.count() == 6
