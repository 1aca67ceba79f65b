"""Binary matrices by ranges of entries, and their writer.

A task seeks to its own entries and finds their rows by binary search in the row
pointers (PETSc: in the sums of row lengths), so neither a file nor a row has to
fit into a task.  A folder of parts, each named by the offset of its first byte,
is read as the one file that they are in order.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserine.operators import order
from tesserine.sources.ranges import listed, located

#: Entries of a task, entries of a batch, rows whose lengths are added up at once, and entries or rows of a written part.
ENTRIES, BATCH, CHUNK, PART = 4_000_000, 1 << 16, 1 << 20, 1 << 20
#: First number of a PETSc matrix file (fixed value).
PETSC = 1211216


class Bytes:
    """A file, or the parts of one, by offset."""

    def __init__(self, path: str) -> None:
        system, at = located(path)
        if system.get_file_info(at).type == fs.FileType.Directory:
            self.parts = [(int(name.rsplit("-", 1)[-1]), name) for name, _ in listed(path)]
        else:
            self.parts = [(0, path)]
        self.open: tuple[int, object] = (-1, None)

    def read(self, at: int, size: int) -> bytes:
        out = []
        while size:
            k = bisect_right(self.parts, at, key=lambda p: p[0]) - 1
            if self.open[0] != k:
                system, name = located(self.parts[k][1])
                self.open = k, system.open_input_file(name)
            self.open[1].seek(at - self.parts[k][0])
            data = self.open[1].read(size)
            if not data:
                raise EOFError(f"{self.parts[k][1]} ends before byte {at}")
            out.append(data)
            at, size = at + len(data), size - len(data)
        return b"".join(out)

    def numbers(self, kind: str, at: int, first: int, n: int) -> np.ndarray:
        """Numbers first to first + n - 1 of an array that begins at byte `at`."""
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.read(at + size * first, size * n), kind)


def matrices(path: str, suffix: str) -> list[str]:
    """A file, a folder of parts, or the files and folders of a pattern or a folder that end in the suffix."""
    found = listed(path)
    if all(name.rsplit("/", 1)[-1].startswith("part-") for name, _ in found):
        return sorted({name.rsplit("/", 1)[0] for name, _ in found})
    return [name for name, _ in found]


@dataclass
class Entries(InputPartition):
    """Entries first to end - 1 of a matrix; row and start: those of a chunk of rows that has the first of them."""

    path: str
    first: int
    end: int
    row: int = 0
    start: int = 0


class CsrReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.entries = options["path"], int(options.get("entries", ENTRIES))
        self.starts = json.loads(options.get("starts", "{}"))

    def sizes(self, data: Bytes) -> tuple[str, int, int]:
        m, _, nnz = (int(x) for x in data.numbers("<u8", 0, 0, 3))
        return "<", m, nnz

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in matrices(self.path, "binary"):
            nnz = self.sizes(Bytes(path))[2]
            out += [Entries(path, a, min(a + self.entries, nnz)) for a in range(0, nnz, self.entries)]
        return out or [Entries("", 0, 0)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if partition.path:
            data = Bytes(partition.path)
            _, m, nnz = self.sizes(data)
            ends = 24 + 16 * nnz + 8  # the end of each row is the start of the next one
            low, high = 0, m - 1
            while low < high:  # the row of the first entry: the first that ends behind it
                row = (low + high) // 2
                if int(data.numbers("<u8", ends, row, 1)[0]) > partition.first:
                    high = row
                else:
                    low = row + 1
            pointers = lambda row: data.numbers("<u8", ends, row, min(BATCH, m - row)).astype(np.int64)
            yield from placed(partition, low, pointers, lambda a, n: (data.numbers("<u8", 24 + 8 * nnz, a, n), data.numbers("<f8", 24, a, n)))


def placed(part: Entries, row: int, ends_from, cells) -> Iterator[pa.RecordBatch]:
    """Batches of a part's entries, from the row of the first one; ends_from(row): where that row and some after it end; cells(a, n): columns and values."""
    ends = ends_from(row)
    for a in range(part.first, part.end, BATCH):
        n = min(BATCH, part.end - a)
        rows, at = np.empty(n, np.int64), a
        while at < a + n:
            while ends[-1] <= at:
                row += len(ends)
                ends = ends_from(row)
            stop = min(a + n, int(ends[-1]))
            rows[at - a : stop - a] = row + np.searchsorted(ends, np.arange(at, stop), "right")
            at = stop
        cols, vals = cells(a, n)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols.astype(np.int64)), pa.array(vals.astype(np.float64))], ["row", "col", "val"])


class PetscReader(CsrReader):
    def sizes(self, data: Bytes) -> tuple[str, int, int]:
        order_ = "<" if data.numbers("<i4", 0, 0, 1)[0] == PETSC else ">"
        code, m, _, nnz = (int(x) for x in data.numbers(order_ + "i4", 0, 0, 4))
        if code != PETSC:
            raise ValueError("not a PETSc matrix")
        return order_, m, nnz

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in matrices(self.path, "pm"):
            starts = self.starts[path]
            for chunk, (start, end) in enumerate(zip(starts, starts[1:], strict=False)):
                out += [Entries(path, a, min(a + self.entries, end), chunk * CHUNK, start) for a in range(start, end, self.entries)]
        return out or [Entries("", 0, 0)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if partition.path:
            data = Bytes(partition.path)
            order_, m, nnz = self.sizes(data)
            n = min(CHUNK, m - partition.row)
            ends = partition.start + np.cumsum(data.numbers(order_ + "i4", 16, partition.row, n).astype(np.int64))
            skip = int(np.searchsorted(ends, partition.first, "right"))
            cells = lambda a, k: (data.numbers(order_ + "i4", 16 + 4 * m, a, k), data.numbers(order_ + "f8", 16 + 4 * m + 4 * nnz, a, k))
            yield from placed(partition, partition.row + skip, lambda row: ends[row - partition.row :], cells)


class LengthsReader(PetscReader):
    def partitions(self) -> list[InputPartition]:
        out = []
        for path in matrices(self.path, "pm"):
            m = self.sizes(Bytes(path))[1]
            out += [Entries(path, a // CHUNK, min(a + CHUNK, m), a) for a in range(0, m, CHUNK)]
        return out or [Entries("", 0, 0)]

    def read(self, partition: Entries) -> Iterator[tuple]:
        if partition.path:
            data = Bytes(partition.path)
            order_ = self.sizes(data)[0]
            yield partition.path, partition.first, int(data.numbers(order_ + "i4", 16, partition.row, partition.end - partition.row).sum(dtype=np.int64))


class Csr(DataSource):
    """Entries (row, col, val) of binary CSR."""

    reads = CsrReader

    @classmethod
    def name(cls) -> str:
        return f"matrix_{cls.__name__.lower()}"

    def schema(self) -> str:
        return "row bigint, col bigint, val double"

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options)


class Petsc(Csr):
    """Entries (row, col, val) of PETSc files."""

    reads = PetscReader


class PetscLengths(Csr):
    """(path, chunk, total): entries in chunks of rows of PETSc files."""

    reads = LengthsReader

    def schema(self) -> str:
        return "path string, chunk bigint, total bigint"


def read(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_csr(matrix: DataFrame, path: str, m: int, n: int, part: int = PART) -> None:
    """matrix (row, col, val) as a folder of parts of binary CSR, named by their offsets; `cat` in order of names makes the one file.

    Entries get their places in the order of rows and columns by ranges; every
    part of values, columns and row pointers is written by a task of its own. A
    part that is written again, by a second try of its task, is the same.
    """
    spark = matrix.sparkSession
    cells = order.positioned(matrix.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")), "row", "col", "val", name="at")
    nnz = matrix.count()
    values, columns, pointers = 24, 24 + 8 * nnz, 24 + 16 * nnz
    system, at = located(path)
    system.create_dir(at)

    def put(offset: int, data: bytes) -> None:
        system, at = located(path)
        own = f"{at}/.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as f:
            f.write(data)
        name = f"{at}/part-{offset:020d}"
        if system.get_file_info(name).type == fs.FileType.NotFound:
            system.move(own, name)
        else:
            system.delete_file(own)

    def put_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> None:
            if held:
                col, val = (np.concatenate(x) for x in zip(*held, strict=True))
                put(values + 8 * now * part, val.astype("<f8").tobytes())
                put(columns + 8 * now * part, col.astype("<u8").tobytes())

        for b in batches:
            number, col, val = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k in np.unique(number):
                if k != now:
                    done()
                    now, held = int(k), []
                held.append((col[number == k], val[number == k]))
        done()
        yield from ()

    def put_pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (part, row, start) to parts; a row without entries starts where the next one does, the last row of a part comes with the start behind it."""
        now, held = None, []

        def done() -> None:
            if held:
                row, start = (np.concatenate(x) for x in zip(*held, strict=True))
                first, last = now * part, min((now + 1) * part, m + 1)
                put(pointers + 8 * first, start[np.searchsorted(row, np.arange(first, last))].astype("<u8").tobytes())

        for b in batches:
            number, row, start = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k in np.unique(number):
                if k != now:
                    done()
                    now, held = int(k), []
                held.append((row[number == k], start[number == k]))
        done()
        yield from ()

    put(0, np.array([m, n, nnz], "<u8").tobytes())
    number = F.expr(f"at div {part}").alias("number")
    cells.select(number, "at", "col", "val").repartition("number").sortWithinPartitions("number", "at").select("number", "col", "val").mapInArrow(put_cells, "x int").write.format("noop").mode("overwrite").save()
    # where a row begins is the place of its first entry; behind the last row stands the number of entries
    starts = cells.groupBy("row").agg(F.min("at").alias("start")).unionByName(spark.range(1).select(F.lit(m).cast("long").alias("row"), F.lit(nnz).cast("long").alias("start")))
    starts = starts.withColumn("number", F.expr(f"row div {part}"))
    # the first start at or behind each part's end closes it
    firsts = starts.groupBy("number").agg(F.min_by("row", "row").alias("row"), F.min("start").alias("start"))
    every = spark.range(m // part + 1).select(F.col("id").alias("number"))
    known = every.join(firsts, "number", "left").select("number", "start")
    # m / part rows: a window over all of them is small
    after = F.first("start", True).over(Window.orderBy("number").rowsBetween(1, Window.unboundedFollowing))
    closed = known.withColumn("next", after).select("number", F.least((F.col("number") + 1) * part, F.lit(m + 1)).alias("row"), F.coalesce("next", F.lit(nnz)).alias("start"))
    both = starts.select("number", "row", "start").unionByName(closed)
    both.repartition("number").sortWithinPartitions("number", "row").select("number", "row", "start").mapInArrow(put_pointers, "x int").write.format("noop").mode("overwrite").save()
