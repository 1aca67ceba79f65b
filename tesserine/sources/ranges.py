"""Data sources that read text files by byte ranges, each moved to what begins next.

A file is cut at multiples of `split` bytes. A range has the lines, or the FASTQ
records, that begin in it, and reads past its end to finish the last one; so one
file of any size is read once, by as many tasks as it has ranges, in no given
order and without an exchange. Compressed files cannot be cut and are one range.
"""

from __future__ import annotations

import fnmatch
import os
import re
import urllib.parse
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Suffixes of compressed files and the codec of each.
PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
#: Bytes that a task reads at once, and about as many that it puts out.
CHUNK = 1 << 20
#: Bytes behind a small range that are read with it.
TAIL = 1 << 12


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or a URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(path).path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder that are no notes of a writer, or of those that a pattern (*, ?) matches, in order of names."""
    system, at = located(path)
    if re.search(r"[*?]", at):
        top = re.split(r"[*?]", at)[0].rsplit("/", 1)[0]
        scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
        return [x for x in listed(scheme + top) if fnmatch.fnmatchcase(located(x[0])[1], at)]
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.Directory:
        every = sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda x: x.path)
        files = [x for x in every if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    else:
        files = [found]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return [(scheme + x.path if scheme else x.path, x.size) for x in files]


@dataclass
class Range:
    """Bytes start to end - 1 of a file."""

    path: str
    start: int
    end: int
    packed: str | None = None


@dataclass
class Ranges(InputPartition):
    """The ranges of a task, one after the other."""

    ranges: list[Range]


def dealt(ranges: list[Range], each: int) -> list[Ranges]:
    """Neighbouring ranges by tasks of up to `each` bytes, one range at least: small ranges do not make as many tasks."""
    out: list[Ranges] = []
    size = 0
    for r in ranges:
        size += r.end - r.start
        if not out or size > each:
            out.append(Ranges([]))
            size = r.end - r.start
        out[-1].ranges.append(r)
    return out


def cut(path: str, split: int) -> list[Range]:
    out = []
    for name, size in listed(path):
        codec = PACKED.get(name.rsplit(".", 1)[-1])
        if codec:
            out.append(Range(name, 0, 1 << 62, codec))
        else:
            out += [Range(name, a, min(a + split, size)) for a in range(0, size, split)]
    return out


def lines_from(range_: Range) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line without its end, whether it has one) of the lines that begin at the range's start or later, to the end of the file."""
    system, at = located(range_.path)
    with system.open_input_file(at) as raw:
        # the byte before the range tells whether a line begins at its start
        here = max(0, range_.start - 1)
        raw.seek(here)
        file = pa.CompressedInputStream(raw, range_.packed) if range_.packed else raw
        held: list[bytes] = []
        skip = range_.start > 0
        # a small range and a little more at first, then more and more of what its last record takes
        size, more = min(CHUNK, range_.end - here + TAIL), TAIL
        while data := file.read(size):
            size, more = (CHUNK, CHUNK) if size == CHUNK else (more, min(CHUNK, 2 * more))
            first, *others = data.split(b"\n")
            held.append(first)
            for line in others:
                whole = b"".join(held)
                if not skip:
                    yield here, whole, True
                skip = False
                here += len(whole) + 1
                held = [line]
        whole = b"".join(held)
        if whole and not skip:
            yield here, whole, False


def is_record(four: list[tuple[int, bytes, bool]]) -> bool:
    """Whether four lines are a record: a quality line may begin like a header, but the second line after it is a sequence then, which has no +."""
    return len(four) == 4 and four[0][1].startswith(b"@") and four[2][1].startswith(b"+") and len(four[1][1].rstrip()) == len(four[3][1].rstrip())


def refused(four: list[tuple[int, bytes, bool]]) -> ValueError:
    header = four[0][1].decode(errors="replace")
    return ValueError(f"not a FASTQ header: {header}" if not header.startswith("@") else f"quality and sequence differ in length: {header}")


def records_from(range_: Range, pairs: bool = False) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(id, sequence, quality) of the records that begin in the range; with pairs, a second mate (/2) goes with the record before it.

    What is no record is an error: also when it stands behind the range, so that
    none is lost between this range and the next one, which begins where a
    record does.
    """
    lines = lines_from(range_)
    four = deque((x for _, x in zip(range(4), lines, strict=False)), maxlen=4)
    if range_.start:
        while four and four[0][0] < range_.end and not is_record(list(four)):
            four.popleft()
            four.extend(x for _, x in zip(range(1), lines, strict=False))
    begun = False
    while four and any(line.strip() for _, line, _ in four):
        now = list(four)
        if now[0][0] >= range_.end and not (begun or range_.start == 0):
            return
        if not is_record(now):
            raise refused(now)
        header = now[0][1][1:].rstrip()
        if now[0][0] >= range_.end and not (pairs and begun and header.endswith(b"/2")):
            return
        if begun or not (pairs and range_.start and header.endswith(b"/2")):
            yield header.replace(b" ", b"_"), now[1][1].rstrip(), now[3][1].rstrip()
        begun = True
        four = deque((x for _, x in zip(range(4), lines, strict=False)), maxlen=4)


def batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """rows, the last column of which is bytes, as batches of about CHUNK bytes."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, pa.binary() if k == pa.string() and isinstance(c[0], bytes) else k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        size += 2 * len(row[-1]) + 32
        if size >= CHUNK:
            yield made()
            held, size = [], 0
    if held:
        yield made()


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.pairs = str(options.get("pairs", "false")).lower() == "true"
        self.most, self.cores = int(options.get("most", self.split)), int(options.get("cores", 1))

    def partitions(self) -> list[Ranges]:
        """As many bytes a task as Spark's own file scans give one: all bytes over the cores, up to `most`, but a whole range."""
        every = cut(self.path, self.split)
        size = sum(size for _, size in listed(self.path))
        return dealt(every, min(self.most, -(-size // self.cores))) or [Ranges([])]


class FastqReader(Reader):
    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows = (x for r in partition.ranges for x in records_from(r, self.pairs))
        yield from batches(rows, [pa.string()] * 3, ["id", "seq", "qual"])


class LineReader(Reader):
    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, bool, bytes]]:
            for r in partition.ranges:
                for at, line, ended in lines_from(r):
                    if at >= r.end:
                        break
                    yield r.path, at, ended, line.removesuffix(b"\r")

        yield from batches(rows(), [pa.string(), pa.int64(), pa.bool_(), pa.string()], ["file", "at", "ended", "line"])


class Fastq(DataSource):
    """FASTQ records (id, seq, qual)."""

    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return "id string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


class Lines(DataSource):
    """Lines (file, at, ended, line) with the offset of their first byte; the last line of a file may not be ended by a newline."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "file string, at bigint, ended boolean, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def read(spark: SparkSession, source: type[DataSource], path: str, split: int | None = None, **options) -> DataFrame:
    """A source's rows; a range has as many bytes as Spark gives a task unless `split` says so. Smaller ranges go to a task together."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    options |= {"split": split or most, "most": most, "cores": spark.sparkContext.defaultParallelism}
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load(path)
