"""Writers: k-mer dumps, contigs, products, matrices and parsed logs. Each writes a folder of parts unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.sources import binary


def kmer_dump(counts: DataFrame, path: str) -> None:
    """Lines `KMER COUNT`, gzip, a part for each task."""
    counts.select(F.concat_ws(" ", "kmer", F.col("cnt").cast("string"))).write.option("compression", "gzip").text(path)


def kmer_rows(table: DataFrame, path: str) -> None:
    """Fixed-width lines `<kmer> <b><f>`."""
    table.select(F.concat("kmer", F.lit(" "), "b_ext", "f_ext")).write.text(path)


def fastq(reads: DataFrame, path: str) -> None:
    """Records (id, seq, qual), four lines each."""
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual")).write.text(path)


def contigs(found: DataFrame, path: str) -> None:
    found.select("contig").write.text(path)


def product(y: DataFrame, path: str, rows: int | None = None) -> None:
    """Lines `index<tab>value`, without rows past the matrix."""
    (y if rows is None else y.filter(F.col("row") < rows)).select("row", "y").write.csv(path, sep="\t")


def matrix_market(matrix: DataFrame, path: str, m: int, n: int) -> None:
    """Entries in order, counted from 1, after a first part that has the header."""
    spark = matrix.sparkSession
    head = f"%%MatrixMarket matrix coordinate real general\n{m} {n} {matrix.count()}"
    spark.createDataFrame([(head,)], "line string").coalesce(1).write.text(path)
    body = matrix.orderBy("row", "col", "val").select(F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("val").cast("string")))
    body.write.mode("append").text(path)


def binary_csr(matrix: DataFrame, path: str, m: int, n: int, part: int = binary.PART) -> None:
    """Parts of one binary CSR file, each named by the offset of its first byte, of up to `part` entries or rows."""
    binary.write_csr(matrix, path, m, n, part)


def log_csv(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.csv(path, header=True)


def json_state(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
