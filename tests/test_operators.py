"""Closed forms, hand-made cases and properties of the base operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.functions import bases, text
from tesserine.operators import chains, histograms, kmers, logs, matrices, reductions, sketches, tables
from tesserine.sources import binary, files, sinks

K = 5


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def counted(reads, k):
    out = {}
    for s in reads:
        for i in range(1, len(s) - k):
            w = s[i : i + k]
            c = min(w, revcomp(w))
            out[c] = out.get(c, 0) + 1
    return out


def test_windows_of_short_reads(spark):
    reads = ["", "A" * (K - 1), "A" * K, "A" * (K + 1), "A" * (K + 2)]
    df = spark.createDataFrame([(r,) for r in reads], "s string")
    trimmed = [len(r[0]) for r in df.select(bases.windows(F.col("s"), K, 1)).collect()]
    whole = [len(r[0]) for r in df.select(bases.windows(F.col("s"), K)).collect()]
    assert trimmed == [0, 0, 0, 0, 1] and whole == [0, 0, 1, 2, 3]


def test_encoding(spark):
    df = spark.createDataFrame([("acgtnU", "ACGT", "T")], "s string, k string, b string")
    row = df.select(bases.encoded(F.col("s")), bases.revcomp(F.col("k")), bases.canonical(F.lit("TTT")), bases.forward(F.col("k"), F.col("b")), bases.backward(F.col("k"), F.col("b"))).first()
    assert tuple(row) == ("ACGTGT", "ACGT", "AAA", "CGTT", "TACG")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGT", max_size=40), max_size=8))
def test_counts_match_brute_force(spark, reads):
    df = spark.createDataFrame([(r,) for r in reads], "s string")
    assert {r.kmer: r.cnt for r in kmers.counts(df, K).collect()} == counted(reads, K)


def test_singletons_never_pass(spark):
    df = spark.createDataFrame([("CACGTAGGT",), ("CACGTAC",)], "s string")
    expected = {k: v for k, v in counted(["CACGTAGGT", "CACGTAC"], K).items() if v >= 2}
    assert {r.kmer: r.cnt for r in kmers.repeated(df, K, 1).collect()} == expected


@pytest.mark.parametrize("length", [1, 2, 3, 8, 17])
def test_chain(spark, length):
    rows = [(str(i), str(i - 1) if i else None, "abc"[i % 3]) for i in range(length)]
    nodes = spark.createDataFrame(rows, "id string, before string, value string")
    found = chains.strings(chains.ends(nodes.select("id", "before")), nodes.select("id", "value")).collect()
    assert [(r.start, r.n, r.contig) for r in found] == [("0", length, "".join("abc"[i % 3] for i in range(length)))]


def test_broken_and_cyclic_chains(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("x", "gone"), ("y", "x"), ("p", "r"), ("q", "p"), ("r", "q")], "id string, before string")
    found = chains.ends(nodes)
    assert {r.id for r in found.filter("whole").collect()} >= {"a", "b"}
    assert {r.id for r in found.filter("not whole").collect()} == {"x", "y"}
    assert {r.id for r in chains.cycles(found, nodes).collect()} == {"p", "q", "r"}


def test_contigs_from_generated_table(spark):
    contigs = files.random_chains(spark, 5, 30, 7)
    table = files.chain_table(contigs, 7).cache()
    assert table.filter("b_ext = 'F'").count() == 5 and table.filter("f_ext = 'F'").count() == 5
    assert table.count() == 5 * 24


def test_product(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((6, 5)) < 0.5, rng.integers(1, 9, (6, 5)), 0)
    a[0] = 0  # an empty row gives no row
    x = rng.integers(1, 5, 5)
    m = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, val double")
    v = spark.createDataFrame([(i, int(x[i])) for i in range(5)], "idx long, x int")
    y = {r.row: r.y for r in matrices.product(m, v, 3).collect()}
    assert y == {i: 3.0 * (a @ x)[i] for i in range(6) if a[i].any()}
    assert {r.row: r.y for r in matrices.split_product(m, v, 1, 3).collect()} == {i: 1.0 * (a @ x)[i] for i in range(6) if a[i].any()}
    assert matrices.difference(m, m).first() == (0, 0)
    pointers = {r.row: (r.length, r.start) for r in matrices.row_pointers(m).collect()}
    counts = np.count_nonzero(a, axis=1)
    assert pointers == {i: (counts[i], counts[:i].sum()) for i in range(6) if counts[i]}


def test_matrix_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.5), (2, 0, -1.0), (2, 2, 4.0)], "row long, col long, val double")
    expected = sorted(map(tuple, m.collect()))
    sinks.matrix_market(m, str(tmp_path / "a.mtx"), 3, 3)
    assert sorted(map(tuple, files.matrix(spark, str(tmp_path / "a.mtx")).collect())) == expected
    assert files.matrix_sizes(spark, str(tmp_path / "a.mtx")) == (3, 3, 3)
    sinks.binary_csr(m, str(tmp_path / "b.binary"), 3, 3)
    assert sorted(map(tuple, files.matrix(spark, str(tmp_path / "b.binary")).collect())) == expected
    for order in "<>":
        data = np.array([binary.PETSC, 3, 3, 3, 1, 0, 2, 1, 0, 2], order + "i4").tobytes() + np.array([2.5, -1, 4], order + "f8").tobytes()
        path = tmp_path / f"c{ord(order)}.pm"
        path.write_bytes(data)
        assert sorted(map(tuple, files.matrix(spark, str(path)).collect())) == expected
    with pytest.raises(ValueError):
        files.matrix(spark, "x.unknown")


def test_single_matrix_market_file(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n2 2 2\n1 1 3\n2 1 4\n")
    assert sorted(map(tuple, files.matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 0, 3.0), (1, 0, 4.0)]


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r 1/1\nACGT  \n+\n@III\n@r2/2\nAC\n+\nII\n")
    assert sorted(map(tuple, files.fastq(spark, str(tmp_path / "r.fastq")).collect())) == [("r2/2", "AC", "II"), ("r_1/1", "ACGT", "@III")]
    (tmp_path / "bad.fastq").write_text("@r/1\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        files.fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_tables(spark):
    rows = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 20, 5)], "k int, v int, at int")
    first = tables.inserted(rows, "k", "v", "at")
    assert {r.k: r.v for r in first.collect()} == {1: 11, 2: 20}
    keys = spark.createDataFrame([(1,), (3,)], "k int")
    assert {r.k: r.v for r in tables.found(keys, first, "k", "v", F.lit(0)).collect()} == {1: 11, 3: 0}


def test_reductions(spark):
    n = 15
    df = spark.range(n).select(F.col("id").alias("rank"))
    assert df.agg(F.sum("rank")).first()[0] == 105
    assert {r["rank"]: r["value"] for r in reductions.to_one(df, F.sum("rank"), 4, F.lit(0).cast("long")).collect()} == {i: 105 if i == 4 else 0 for i in range(n)}
    v = df.select(F.array(*(F.lit(i) for i in range(4))).alias("v"))
    assert {r.pos: r.s for r in reductions.by_position(v, "v", F.sum("x").alias("s")).collect()} == {i: i * n for i in range(4)}
    row = reductions.reduced(spark.createDataFrame([(3,), (5,)], "x long"), F.col("x")).first()
    assert tuple(row) == (8, 15.0, 1, 7, 6, 3, 5)


def test_histograms(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,), (10.0,)], "x double")
    assert {r.v for r in histograms.most_frequent(df, F.col("x")).collect()} == {1.0, 2.0}
    assert {r.bucket: r.n for r in histograms.intervals(df, F.col("x"), 10).collect()} == {0: 4, 1: 1}
    assert [r.v for r in histograms.sorted_counts(df, F.col("x")).collect()] == [1.0, 2.0, 10.0]


def test_bloom(spark):
    n = 2000
    held, others = spark.range(n), spark.range(n, 2 * n)
    size = sketches.Size.of(n, 0.01)
    f = sketches.built(held, F.col("id"), size).cache()
    assert sketches.possible(held, F.col("id"), f, size).count() == n
    assert sketches.possible(others, F.col("id"), f, size).count() < 0.1 * n
    assert abs(sketches.cardinality(f, size).first()[0] - n) < 0.15 * n


def test_logs(spark):
    lines = ["noise", "total time 9 s", "srun -N=2 --ntasks-per-node=4 a", "x", "total time 1.5 s", "total time 7 s", "srun -N=2 --ntasks-per-node=4 b", "srun -N=4 --ntasks-per-node=4 b", "total time -nan s"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, at long, line string")
    found = sorted((r.task, r.node_num, r.value) for r in logs.parsed(df).collect())
    assert found == [("a", 2, "1.5"), ("b", 4, "-nan")]
    assert logs.faults(df).first()[0] == 1


def test_text(spark):
    one = spark.range(1)
    row = one.select(text.basename(F.lit("a/b.c")), text.basename(F.lit("b")), text.without_extension(F.lit("x.tar.gz")), text.split_tokens(F.lit("a,b,"), ","), text.size_str(F.lit(1536)), text.size_str(F.lit(12)), text.perc_str(F.lit(1), F.lit(3))).first()
    assert tuple(row) == ("b.c", "", "x.tar", ["a", "b"], "1.50KB", "12B", "1 (33.33%)")
    names = [one.select(text.fastq_name(F.lit(h))).first()[0] for h in ("@x/1", "@x-R2", "@x 1:Y:0:AC")]
    assert names == ["x/1", "x/2", "x/1"]
