"""Packed keys, places in a total order, and binary matrices by ranges, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import bases
from tesserine.operators import kmers, matrices, order
from tesserine.sources import binary, files, sinks


def canonical(s):
    return min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))


@pytest.mark.parametrize("k", [1, 2, 13, 31, 32, 33, 47, 51, 63, 64])
def test_keys(spark, k):
    rng = random.Random(k)
    rows = ["".join(rng.choices("ACGT", k=k)) for _ in range(200)] + ["A" * k, "T" * k, "G" * k, ("AT" * k)[:k]]
    df = spark.createDataFrame([(r, rows[-i]) for i, r in enumerate(rows)], "s string, o string")
    own, other = bases.key_of(F.col("s"), k), bases.key_of(F.col("o"), k)
    text = lambda words: bases.kmer_of(words, k)
    got = df.select("s", "o", text(own).alias("same"), text(bases.revcomp_key(own, k)).alias("rc"), text(bases.canonical_key(own, k)).alias("c"), bases.less_key(own, other).alias("less")).collect()
    for r in got:
        assert r.same == r.s and r.rc == r.s[::-1].translate(str.maketrans("ACGT", "TGCA")) and r.c == canonical(r.s) and r.less == (r.s < r.o)
    codes = np.array(["ACGT".index(c) for c in "".join(rows)], np.uint64)
    words = kmers.packed_windows(codes, k)
    every = "".join(rows)
    keys = [sum(int(w[i]) << (64 * (len(words) - 1 - j)) for j, w in enumerate(words)) for i in range(len(words[0]))]
    want = [int(canonical(every[i : i + k]).translate(str.maketrans("ACGT", "0123")), 4) for i in range(len(every) - k + 1)]
    assert keys == want
    with pytest.raises(ValueError, match="1 to 64"):
        bases.key_words(65)


@pytest.mark.parametrize("k", [31, 32, 51, 64])
def test_words_with_the_first_bit_alone(spark, k):
    """A word that is the least long (G or, in a whole word of fewer bases, G and A behind it) is unpacked as any other; also the ends of the range."""
    rows = ["G" + "A" * (k - 1), "C" * (k - 32) + "G" + "A" * min(k - 1, 31), "C" * max(0, k - 32) + "CT" + "T" * (min(k, 32) - 2), "T" * k]
    rows = [r for r in rows if len(r) == k]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = df.select("s", bases.kmer_of(bases.key_of(F.col("s"), k), k).alias("same"), bases.unpacked_words(bases.packed_words(F.col("s"), k), k).alias("whole")).collect()
    assert len(got) >= 3 and all(r.same == r.s == r.whole for r in got)


def test_queries_of_the_least_long(spark, tmp_path):
    """q_kmer_packed and q_kmer_key_canonical against their SQL where a key's last word is G and 31 A."""
    import duckdb

    from tesserine.plans import genomics
    from tesserine.plans.registry import SQL

    read = "CGA" * 6 + "CG" + "A" * 40
    rows = [(1, "x", read), (2, "x", "T" + read), (3, "x", read[::-1]), (4, "y", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("q_kmer_packed", "q_kmer_key_canonical"):
        got = sorted(map(tuple, getattr(genomics, name)(spark, str(tmp_path)).collect()))
        assert got and got == sorted(duckdb.sql(SQL[name]).fetchall())


def test_canonical_keys_make_reads_once(spark, tmp_path):
    """q_kmer_key_canonical scans documents once for its widths; reads of every length to 53, the empty one and null too, against a plain loop."""
    from tesserine.plans import genomics

    rng = random.Random(5)
    rows = [(i, "x", None if i == 60 else "".join(rng.choices("ACGT", k=i % 54))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = genomics.q_kmer_key_canonical(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = sorted((k, i, canonical(t[:k])) for i, _, t in rows for k in (13, 31, 51) if t and len(t) >= k)
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("k", [3, 32, 40])
def test_packed_counts(spark, k, monkeypatch):
    rng = random.Random(k)
    reads = ["", "A", None, *("".join(rng.choices("ACGT", k=rng.randrange(1, 120))) for _ in range(80))] + ["ACGT" * 30] * 3 + ["G" * 300]
    df = spark.createDataFrame([(r,) for r in reads], "s string")
    want = Counter(canonical(r[i : i + k]) for r in reads if r for i in range(1, len(r) - k))
    got = kmers.unpacked_counts(kmers.packed_counts(df, k), k)
    assert {r.kmer: r.cnt for r in got.collect()} == want
    assert {r.kmer: r.cnt for r in kmers.counts(df, k).collect()} == want


@pytest.mark.parametrize("k", [3, 32, 40])
def test_sides_and_extremes(spark, k):
    """Against plain loops, and no window leaves the scan's tasks as a text."""
    rng = random.Random(k)
    reads = ["", "A", None, *("".join(rng.choices("ACGT", k=rng.randrange(1, 120))) for _ in range(80)), "G" + "A" * 80, *("ACGTA" * 16)[: k + 3].split(), "T" * (k + 2)]
    df = spark.createDataFrame(list(enumerate(reads)), "i long, s string")
    after, ahead = Counter(), Counter()
    for r in reads:
        for i in range(1, len(r or "") - k):
            after[r[i + 1 : i + 1 + k]] += 1
            ahead[r[i - 1 : i - 1 + k]] += 1
    found = kmers.sides(df, k)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.kmer: (r.n_next, r.n_last) for r in found.collect()} == {x: (after[x], ahead[x]) for x in after.keys() | ahead.keys()}
    if k > 32:
        with pytest.raises(ValueError, match="32 bases"):
            kmers.extremes(df, "i", k=k)
        return
    every = {i: [r[j : j + k] for j in range(len(r) - k + 1)] for i, r in enumerate(reads) if r and len(r) >= k}
    assert {r.i: (r.n, r.first_kmer, r.last_kmer) for r in kmers.extremes(df, "i", k=k).collect()} == {i: (len(w), min(w), max(w)) for i, w in every.items()}


def test_long_reads_go_by_parts():
    """A read over one part's windows has every window once."""
    import pyarrow as pa

    rng = random.Random(1)
    read = "".join(rng.choices("ACGT", k=1000))
    whole = Counter(canonical(read[i : i + 5]) for i in range(1, 995))
    old, kmers.WINDOWS = kmers.WINDOWS, 64
    try:
        class Frame:
            def filter(self, _):
                return self

            def select(self, _):
                return self

            def mapInArrow(self, run, schema):  # noqa: N802
                return list(run(iter([pa.RecordBatch.from_arrays([pa.array([read])], ["s"])])))

        batches = kmers.packed_partials(Frame(), 5)
    finally:
        kmers.WINDOWS = old
    got = Counter()
    for b in batches:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got["".join("ACGT"[w >> 2 * j & 3] for j in reversed(range(5)))] += n
    assert got == whole and len(batches) > 10


def test_recurring_windows_are_added_up(spark, monkeypatch):
    """A task gives a row for each k-mer that recurs, not one for each WINDOWS windows; of more k-mers than it keeps it gives some, and loses none."""
    import pyarrow as pa

    class Frame:
        def filter(self, _):
            return self

        def select(self, _):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter([pa.RecordBatch.from_arrays([pa.array([read])], ["s"])])))

    monkeypatch.setattr(kmers, "WINDOWS", 64)
    rng = random.Random(2)
    some = ["".join(rng.choices("ACGT", k=8)) for _ in range(40)]
    for read, most in (("ACGTA" * 400, 10), ("".join(x * 20 for x in some), 10**6)):
        whole = Counter(canonical(read[i : i + 5]) for i in range(1, len(read) - 5))
        got, rows = Counter(), 0
        for b in kmers.packed_partials(Frame(), 5):
            rows += b.num_rows
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got["".join("ACGT"[w >> 2 * j & 3] for j in reversed(range(5)))] += n
        assert got == whole and rows <= most


def shuffled(df, metric):
    """A metric of all exchanges of df's plan, once it has run."""
    df._jdf.collectToPython()

    def of(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(plan.plan())
        own = plan.metrics().apply(metric).value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(of(plan.children().apply(i)) for i in range(plan.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_shuffle_of_packed_keys(spark, sf_dir):
    """Rows of packed keys are half as large; on disk, where text of four letters is compressed well, they are still smaller."""
    reads = spark.read.parquet(f"{sf_dir}/documents.parquet").select(bases.read_of(F.col("text")).alias("s"))
    for k in (31, 51):
        packed, plain = kmers.packed_counts(reads, k), kmers.counts(reads, k)
        assert shuffled(packed, "dataSize") < 0.55 * shuffled(plain, "dataSize")
        assert shuffled(packed, "shuffleBytesWritten") < shuffled(plain, "shuffleBytesWritten")


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_positions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, row int").repartition(7)
    got = sorted(order.positioned(df, "a", "b", "row", partitions=partitions).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(500))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:3])
    assert [tuple(r[:3]) for r in got] == sorted(rows, key=key)
    ties = order.positioned(df, "a", partitions=partitions).collect()
    assert sorted(r.position for r in ties) == list(range(500)) and [r.a for r in sorted(ties, key=lambda r: r.position)] == sorted((r[0] for r in rows), key=lambda a: (a is not None, a or 0))
    sums = sorted(order.running(df, "b", "row", partitions=partitions).collect(), key=lambda r: r.row)
    assert [r.start for r in sums] == [sum(r[1] for r in rows[:i]) for i in range(500)]
    assert order.positioned(df.filter("false"), "a").count() == 0


def test_a_hot_key_is_spread(spark):
    """Rows of one key stand in several ranges."""
    rows = order.ranged(spark.range(4000).select(F.lit(7).alias("k"), "id"), "k", partitions=8)
    assert rows.select("order_range").distinct().count() >= 4


def sparse(rng, m, n, nnz):
    """Entries of a matrix with empty rows at both ends, a long row and repeated places."""
    rows = [(rng.choice([3, 3, 3, *range(2, m - 2)]), rng.randrange(n), float(rng.randrange(1, 99))) for _ in range(nnz)]
    return sorted(rows)


@pytest.mark.parametrize(("m", "part"), [(7, 4), (40, 8), (41, 1000), (300, 64)])
def test_csr_parts(spark, tmp_path, m, part):
    rng = random.Random(m)
    rows = sparse(rng, m, 9, 500)
    df = spark.createDataFrame(rows, "row long, col long, val double").repartition(5)
    path = tmp_path / "a.binary"
    sinks.binary_csr(df, str(path), m, 9, part=part)
    parts = sorted(path.glob("part-*"))
    one = tmp_path / "one.binary"
    one.write_bytes(b"".join(p.read_bytes() for p in parts))
    starts = np.concatenate([[0], np.cumsum(np.bincount([r[0] for r in rows], minlength=m))])
    assert one.read_bytes() == np.array([m, 9, 500], "<u8").tobytes() + np.array([r[2] for r in rows], "<f8").tobytes() + np.array([r[1] for r in rows], "<u8").tobytes() + starts.astype("<u8").tobytes()
    for source in (path, one):
        got = files.binary_csr(spark, f"file://{source}", entries=70)
        assert got.rdd.getNumPartitions() == 8
        assert sorted(map(tuple, got.collect())) == rows
    assert sorted(map(tuple, files.matrix(spark, str(path)).collect())) == rows


@pytest.mark.parametrize("side", "<>")
def test_petsc_ranges(spark, tmp_path, side, monkeypatch):
    rng = random.Random(ord(side))
    rows = sparse(rng, 60, 9, 400)
    lengths = np.bincount([r[0] for r in rows], minlength=60)
    path = tmp_path / "a.pm"
    path.write_bytes(np.array([binary.PETSC, 60, 9, 400, *lengths, *(r[1] for r in rows)], side + "i4").tobytes() + np.array([r[2] for r in rows], side + "f8").tobytes())
    got = files.petsc(spark, str(path), entries=90)
    assert got.rdd.getNumPartitions() == 5 and sorted(map(tuple, got.collect())) == rows
    # chunks of few rows, in this process
    monkeypatch.setattr(binary, "CHUNK", 7)
    options = {"path": str(path)}
    sums = sorted(x for p in binary.LengthsReader(options).partitions() for x in binary.LengthsReader(options).read(p))
    starts = [0, *np.cumsum([s[2] for s in sums]).tolist()]
    import json

    reader = binary.PetscReader(options | {"starts": json.dumps({str(path): starts}), "entries": "50"})
    cells = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert cells == [(r[0], r[1], r[2]) for r in rows]


def test_empty_matrix(spark, tmp_path):
    none = spark.createDataFrame([], "row long, col long, val double")
    sinks.binary_csr(none, str(tmp_path / "e.binary"), 3, 3)
    assert files.matrix(spark, str(tmp_path / "e.binary")).collect() == []
    assert matrices.row_pointers(none).collect() == []
