"""Readers: FASTQ, k-mer tables, Matrix Market, binary matrices, logs, and generators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.operators.logs import carried
from tesserine.sources import binary, ranges


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): the lines of text files with their number in the file, from 0.

    Lines are counted by split of a file, and each split starts where those before it end.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    base = F.broadcast(blocks.select("file", "block", "n", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))  # a row for each split
    # a split's lines are read one after the other by one task, so their ids are as well; both passes deal the splits alike, or this is an error
    own = F.col("order") - F.col("first")
    own = F.when((own >= 0) & (own < F.col("n")), own).otherwise(F.raise_error(F.lit("splits were dealt in another way")).cast("long"))
    return raw.join(base, ["file", "block"]).select("file", (F.col("base") + own).alias("at"), "line")


def fastq(spark: SparkSession, path: str, split: int | None = None, pairs: bool = False) -> DataFrame:
    """(id, seq, qual): four lines a record, read by byte ranges; lines are trimmed on the right, blanks in ids become _.

    A header without @, or a quality of another length than its sequence, is an
    error; a line may have any length. With pairs, both mates of a pair are in
    one task, the second one behind the first.
    """
    return ranges.read(spark, ranges.Fastq, path, split, pairs=pairs)


def read_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """df with read_number and pair of ids r<number>/1 or /2."""
    return df.withColumns({"read_number": F.regexp_extract(column, r"^r(\d+)/([12])$", 1).try_cast("long"), "pair": F.regexp_extract(column, r"^r(\d+)/([12])$", 2).try_cast("int")})


def kmer_width(spark: SparkSession, path: str) -> int:
    """Length of the first token of a k-mer table."""
    return len(spark.read.text(path).first()[0].split(" ")[0])


def kmer_table(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(kmer, b_ext, f_ext) of fixed-width lines."""
    c = F.col("value")
    return spark.read.text(path).select(F.substring(c, 1, k).alias("kmer"), F.substring(c, k + 2, 1).alias("b_ext"), F.substring(c, k + 3, 1).alias("f_ext"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: the lines that a newline ends."""
    return ranges.read(spark, ranges.Lines, path).agg(F.count_if("ended").alias("lines"))


def _market_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines that are no comments, of those the lines of sizes): only a file that begins with a comment has one, other parts of a folder go on with entries."""
    every = numbered(spark, path)
    lines = every.filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    headed = every.filter((F.col("at") == 0) & F.col("line").startswith("%%")).select("file")
    first = lines.join(headed, "file", "left_semi").groupBy("file").agg(F.min_by(F.struct("at", "line"), "at").alias("x"))
    return lines, first.select("file", "x.at", "x.line")


def matrix_market(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """(row, col, val), counted from 0; an entry without a value has 1. A file whose entries are not in the order of rows and columns is an error."""
    lines, sizes = _market_lines(spark, path)
    parts = F.split(F.trim("line"), r"\s+")
    place = F.struct((F.get(parts, F.lit(0)).cast("long") - base).alias("row"), (F.get(parts, F.lit(1)).cast("long") - base).alias("col"))
    cells = lines.join(sizes.select("file", "at"), ["file", "at"], "left_anti").withColumn("place", place)
    # the entry before each one, by segments of a file
    back = F.col("before").isNotNull() & (F.col("place") < F.col("before"))
    checked = carried(cells, F.col("place")).withColumn("val", F.when(back, F.raise_error(F.concat(F.lit("entries are not sorted: "), "line")).cast("double")).otherwise(F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0))))
    return checked.select("place.row", "place.col", "val")


def matrix_sizes(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(m, n, nnz) of a Matrix Market file."""
    return tuple(int(x) for x in _market_lines(spark, path)[1].first()["line"].split()[:3])


def binary_csr(spark: SparkSession, path: str, entries: int = binary.ENTRIES) -> DataFrame:
    """(row, col, val) of binary CSR, a file or a folder of parts: u64 m, n, nnz; f64 values; u64 column indices; u64 row pointers. A task reads `entries` at most."""
    return binary.read(spark, binary.Csr, path, entries=entries)


def petsc(spark: SparkSession, path: str, entries: int = binary.ENTRIES) -> DataFrame:
    """(row, col, val) of PETSc files of either byte order: i32 code, rows, cols, nnz; i32 row lengths; i32 columns; f64 values.

    The format has lengths of rows only, so a first pass adds them up by chunks of rows; a chunk's start is an option of the second one.
    """
    sums = binary.read(spark, binary.PetscLengths, path).collect()  # a row for each CHUNK rows
    starts: dict[str, list[int]] = {}
    for r in sorted(sums, key=lambda r: (r.path, r.chunk)):
        own = starts.setdefault(r.path, [0])
        own.append(own[-1] + r.total)
    return binary.read(spark, binary.Petsc, path, entries=entries, starts=json.dumps(starts))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix file by its last suffix."""
    readers = {"mtx": matrix_market, "binary": binary_csr, "pm": petsc}
    suffix = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]
    if suffix not in readers:
        raise ValueError(f"unknown matrix format: {suffix}")
    return readers[suffix](spark, path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line) of all log files that a pattern matches, by number of the line."""
    return numbered(spark, path)


def line_offsets(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """(file, at, line) of text files by offset of the line, in one pass and without an exchange."""
    return ranges.read(spark, ranges.Lines, path, split).select("file", "at", "line")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def json_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def exponential_ints(spark: SparkSession, n: int, rate: float, top: int = 1_000_000, seed: int = 0) -> DataFrame:
    """(v): exponential variates, scaled and folded to [0, top)."""
    return spark.range(n).select(F.pmod((-F.log(1 - F.rand(seed)) / rate * top).cast("long"), F.lit(top)).alias("v"))


def uniform_ints(spark: SparkSession, n: int, top: int = 1 << 28, seed: int = 0) -> DataFrame:
    return spark.range(n).select((F.floor(F.rand(seed) * top).cast("long") + 1).alias("v")).select((F.col("v") % top).alias("v"))


def random_chains(spark: SparkSession, chains: int, bases: int, k: int, seed: int = 0) -> DataFrame:
    """(chain, contig): random contigs, from which a k-mer table follows by windows."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(bases)), lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1)))
    return spark.range(chains).select(F.col("id").alias("chain"), F.array_join(letters, "").alias("contig"))


def chain_table(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, b_ext, f_ext) of contigs; F stands at both ends."""
    at = F.posexplode(F.sequence(F.lit(1), F.length("contig") - k + 1)).alias("p", "i")
    rows = contigs.filter(F.length("contig") >= k).select("contig", at)
    return rows.select(F.substring("contig", F.col("i"), F.lit(k)).alias("kmer"), F.when(F.col("i") == 1, "F").otherwise(F.substring("contig", F.col("i") - 1, F.lit(1))).alias("b_ext"), F.when(F.col("i") + k > F.length("contig"), "F").otherwise(F.substring("contig", F.col("i") + k, F.lit(1))).alias("f_ext"))
