"""Shared pieces: shared storage, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition [^\x20\x09-\x0D]+ (fixed values).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tesserine-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage and survives lost executors. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table that written() made and that no plan reads any more."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(spark: SparkSession) -> None:
    """Has the driver find the plans that are done, whose shuffle files Spark then removes; else they stay until it happens to collect garbage."""
    spark.sparkContext._jvm.System.gc()


class Sent:
    """A broadcast value whose class need not be importable on the executors."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held: list = []

    def __getstate__(self):
        return {"bytes": self.bytes, "held": []}

    @property
    def value(self):
        if not self.held:
            self.held.append(pickle.loads(self.bytes.value))
        return self.held[0]


def trimmed() -> None:
    """Gives memory that a worker has freed back to the system, so that what one stage needed does not add to the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def quoted(name: str) -> str:
    """A column's name as it must stand in an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, run, *at: str) -> DataFrame:
    """df.mapInArrow(run) with df's own columns, whose names may be any; run gets the places of the columns `at` and the batches."""
    places, numbers = [df.columns.index(c) for c in at], [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*numbers)
    return plain.mapInArrow(lambda batches: run(*places, batches), plain.schema).toDF(*df.columns)


def no_nulls_id(column: str = "doc_id"):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions in force, which the deployment sizes with its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 of n + 1, bytes) of an Arrow string column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if offs is None or n == 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0] : o[-1]]


def slices(offsets: np.ndarray, most_bytes: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most most_bytes each; a longer row stands alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 (xor-shift multiply); bijective."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Hashes all words of a batch of texts at once.

    A word is a maximal run of bytes outside SPACE_BYTES, A-Z lower-cased.  Its
    hash is a polynomial in an odd base modulo 2**64 over random 64-bit byte
    values, taken from one running sum over the whole buffer.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, fold: bool = True) -> None:
        rng = np.random.default_rng(20240601)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.values[65:91] = self.values[97:123]
        self.space = np.zeros(256, bool)
        self.space[list(SPACE_BYTES)] = True
        self.size = 0
        self.reserve(1 << 20)

    def reserve(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = n
        inverse = pow(self.BASE, -1, 1 << 64)
        self.power = np.full(n, self.BASE, np.uint64)
        self.back = np.full(n, inverse, np.uint64)
        self.power[0] = self.back[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.back, out=self.back)

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, hash of each word), in text order. offsets start at 0."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.reserve(n + 1)
        word = ~self.space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | cut[1:n]
        end[:-1] &= ~word[1:] | cut[1:n]
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        run = self.values[data]
        run *= self.power[:n]
        np.cumsum(run, out=run)
        h = run[e] - np.where(s > 0, run[np.maximum(s, 1) - 1], np.uint64(0))
        h *= self.back[s]
        h ^= (e - s + 1).astype(np.uint64) << np.uint64(48)
        return np.searchsorted(offsets, s, "right") - 1, mix(h)


def shingle_sets(rows: np.ndarray, words: np.ndarray, n_rows: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n_rows + 1, hashes): the sorted distinct shingles of each row; a row of fewer words has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    seeds = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8A865), np.uint64(0xCA5A826395121157)]
    hashes, of = [], []
    n = len(words)
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mix(h * seeds[k % 3] + words[k : n - width + 1 + k])
        same = rows[: n - width + 1] == rows[width - 1 :]
        hashes.append(h[same])
        of.append(rows[: n - width + 1][same])
    first = np.cumsum(counts) - counts
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[r])
        with np.errstate(over="ignore"):
            for w in words[first[r] : first[r] + counts[r]]:
                h = mix(np.array([h * seeds[1] + w]))[0]
        hashes.append(np.array([h], np.uint64))
        of.append(np.array([r]))
    if not hashes:
        return np.zeros(n_rows + 1, np.int64), np.zeros(0, np.uint64)
    h, r = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return np.concatenate(([0], np.cumsum(np.bincount(r, minlength=n_rows)))), h
