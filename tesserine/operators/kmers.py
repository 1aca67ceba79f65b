"""Counting of k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.bases import SWAPS, K, key_words, kmer_of, revcomp, windows
from tesserine.operators import sketches
from tesserine.session import stored


def exploded(reads: DataFrame, k: int = K, trim: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a window of column s, in column km. The length filter stands before the explosion."""
    return reads.filter(F.length("s") >= k + 2 * trim).select(*keep, F.explode(windows(F.col("s"), k, trim)).alias("km"))


def counts(reads: DataFrame, k: int = K) -> DataFrame:
    """(kmer, cnt) of canonical windows without each read's first and last. Partial sums in the scan's stage take the place of a Bloom pre-filter."""
    return _as_text(_canonical(reads, k).groupBy("kmer").agg(F.count("*").alias("cnt")))


def _canonical(reads: DataFrame, k: int, trim: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical windows as bytes.

    A window's reverse complement is the window at the mirrored place of the
    read's, which is made once; places are exploded and windows cut from bytes,
    all in generated code.
    """
    n = F.length("s")
    rows = reads.filter(n >= k + 2 * trim).select(*keep, n.alias("n"), F.col("s").cast("binary").alias("b"), revcomp(F.col("s")).cast("binary").alias("r"))
    # a select of its own, so that what a read has once is made before the explosion
    rows = rows.select(*keep, "n", "b", "r", F.explode(F.sequence(F.lit(1 + trim), F.col("n") - k + 1 - trim)).alias("i"))
    return rows.select(*keep, F.least(F.substring("b", F.col("i"), F.lit(k)), F.substring("r", F.col("n") - F.col("i") - k + 2, F.lit(k))).alias("kmer"))


#: Windows that a task packs and counts at once.
WINDOWS = 1 << 20
#: Share of distinct windows above which counts are passed on at once.
OFTEN = 0.75


def _rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """Two bits a base of all windows of k codes, 32 at most, by doubling."""
    out, width, block, size = None, 0, codes, 1
    while True:
        if k & size:
            # what is there stands before the next block
            out = block if out is None else (out[: len(out) - size] << np.uint64(2 * size)) | block[width:]
            width += size
        size *= 2
        if size > k:
            return out
        half = size // 2
        block = (block[:-half] << np.uint64(2 * half)) | block[half:]


def _mirrored(words: np.ndarray) -> np.ndarray:
    for n, mask in SWAPS:
        words = ((words >> np.uint64(n)) & np.uint64(mask)) | ((words & np.uint64(mask)) << np.uint64(n))
    return ~((words >> np.uint64(32)) | (words << np.uint64(32)))


#: The code of each byte that is a base.
CODE = np.zeros(256, np.uint64)
CODE[[ord(c) for c in "ACGT"]] = range(4)


def own_windows(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The keys of all windows of k codes, k at least, as they are."""
    return [_rolled(codes, k)] if k <= 32 else [_rolled(codes, k - 32)[: len(codes) - k + 1], _rolled(codes, 32)[k - 32 :]]


def packed_windows(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The keys of all windows of k codes in their canonical form, a word or two."""
    if len(codes) < k:
        return [np.zeros(0, np.uint64)] * key_words(k)
    if k <= 32:
        own = _rolled(codes, k)
        return [np.minimum(own, _mirrored(own) >> np.uint64(64 - 2 * k))]
    n = len(codes) - k + 1
    first, last = _rolled(codes, k - 32)[:n], _rolled(codes, 32)[k - 32 :]
    high, low, gap = _mirrored(last), _mirrored(first), np.uint64(128 - 2 * k)
    if gap:
        high, low = high >> gap, (high << (np.uint64(64) - gap)) | (low >> gap)
    own = (first < high) | ((first == high) & (last < low))
    return [np.where(own, first, high), np.where(own, last, low)]


def packed_partials(reads: DataFrame, k: int = K, trim: int = 1) -> DataFrame:
    """(w0, n) or (w0, w1, n): canonical windows with keys of one or two longs (see kmer_of), packed and counted in the scan's tasks, some at a time; a key may come several times.

    Counts of windows that often recur are kept and added up, so a task gives few
    rows however long its reads are; where most windows are new, nothing is kept.
    """
    names = [f"w{i}" for i in range(key_words(k))]

    def counted(words: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        order = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0])
        words = [w[order] for w in words]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        at = np.flatnonzero(new)
        return [w[at] for w in words], np.diff(at, append=len(order)) if n is None else np.add.reduceat(n[order], at)

    def given(found: tuple[list[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, n = found
        for a in range(0, len(n), WINDOWS):
            yield pa.RecordBatch.from_arrays([*(pa.array(w[a : a + WINDOWS].view(np.int64)) for w in words), pa.array(n[a : a + WINDOWS])], [*names, "n"])

    def added_up(parts: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for windows in parts:
            found = counted(windows)
            if len(found[1]) > OFTEN * len(windows[0]):
                yield from given(found)
                continue
            kept.append(found)
            rows += len(found[1])
            if rows > 2 * WINDOWS:
                kept = [counted([np.concatenate(w) for w in zip(*(f[0] for f in kept), strict=True)], np.concatenate([f[1] for f in kept]))]
                rows = len(kept[0][1])
                if rows > WINDOWS:
                    yield from given(kept[0])
                    kept, rows = [], 0
        if kept:
            yield from given(counted([np.concatenate(w) for w in zip(*(f[0] for f in kept), strict=True)], np.concatenate([f[1] for f in kept])))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, many = [], 0
        for b in batches:
            for s in b.column(0):
                bases = np.frombuffer(s.as_buffer(), np.uint8)
                # a long read goes by parts that overlap by k - 1 bases
                for a in range(trim, len(bases) - k - trim + 1, WINDOWS):
                    part = bases[a : min(a + WINDOWS + k - 1, len(bases) - trim)]
                    held.append(packed_windows(CODE[part], k))
                    many += len(held[-1][0])
                    if many >= WINDOWS:
                        yield [np.concatenate(w) for w in zip(*held, strict=True)]
                        held, many = [], 0
        if many:
            yield [np.concatenate(w) for w in zip(*held, strict=True)]

    rows = reads.filter(F.length("s") >= k + 2 * trim).select("s")
    return rows.mapInArrow(lambda batches: added_up(parts(batches)), ", ".join([*(f"{n} bigint" for n in names), "n bigint"]))


def sides(reads: DataFrame, k: int = K) -> DataFrame:
    """(kmer, n_next, n_last): how often each k-mer follows a window one base on, and how often it stands one base before one, over windows without each read's first and last.

    That is every window but a read's first two, and every one but its last two;
    they are packed and counted in the scan's tasks, some at a time.
    """
    names = [f"w{i}" for i in range(key_words(k))]

    def counted(words: list[np.ndarray], follows: np.ndarray, leads: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0])
        words = [w[order] for w in words]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        at = np.flatnonzero(new)
        sums = [np.add.reduceat(x[order].astype(np.int64), at) for x in (follows, leads)]
        return pa.RecordBatch.from_arrays([*(pa.array(w[at].view(np.int64)) for w in words), *map(pa.array, sums)], [*names, "n_next", "n_last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        made = lambda: counted([np.concatenate(w) for w in zip(*(h[0] for h in held), strict=True)], *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
        for b in batches:
            for s in b.column(0):
                bases = np.frombuffer(s.as_buffer(), np.uint8)
                last = len(bases) - k
                for a in range(0, last + 1, WINDOWS):
                    words = own_windows(CODE[bases[a : a + WINDOWS + k - 1]], k)
                    at = np.arange(a, a + len(words[0]))
                    held.append((words, at >= 2, at <= last - 2))
                    many += len(at)
                    if many >= WINDOWS:
                        yield made()
                        held, many = [], 0
        if many:
            yield made()

    rows = reads.filter(F.length("s") >= k + 2).select("s")
    partials = rows.mapInArrow(run, ", ".join([*(f"{n} bigint" for n in names), "n_next bigint", "n_last bigint"]))
    found = partials.filter("n_next + n_last > 0").groupBy(*names).agg(F.sum("n_next").alias("n_next"), F.sum("n_last").alias("n_last"))
    return found.select(kmer_of([F.col(n) for n in names], k).alias("kmer"), "n_next", "n_last")


def extremes(reads: DataFrame, *keep: str, k: int = K) -> DataFrame:
    """(keep, n, first_kmer, last_kmer): how many windows each read of k bases or more has, the first and the last of them in order; k is 32 at most."""
    if key_words(k) > 1:
        raise ValueError("one word holds 32 bases")
    rows = reads.filter(F.length("s") >= k).select(*keep, "s")
    kinds = [f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.uint64)
            for i, s in enumerate(b.column(len(keep))):
                bases = np.frombuffer(s.as_buffer(), np.uint8)
                n = len(bases) - k + 1
                ends = []
                for a in range(0, n, WINDOWS):
                    words = own_windows(CODE[bases[a : a + WINDOWS + k - 1]], k)[0]
                    ends += [words.min(), words.max()]
                out[:, i] = n, min(ends), max(ends)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, out.view(np.int64))], [*(f"c{i}" for i in range(len(keep))), "n", "low", "high"])

    found = rows.mapInArrow(run, ", ".join([*kinds, "n bigint", "low bigint", "high bigint"])).toDF(*keep, "n", "low", "high")
    return found.select(*keep, "n", kmer_of([F.col("low")], k).alias("first_kmer"), kmer_of([F.col("high")], k).alias("last_kmer"))


def packed_counts(reads: DataFrame, k: int = K, trim: int = 1) -> DataFrame:
    """(w0, cnt) or (w0, w1, cnt): counts of canonical windows; keys of a word or two and counts are all that is shuffled."""
    return summed(packed_partials(reads, k, trim))


def summed(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*partials.columns[:-1]).agg(F.sum("n").alias("cnt"))


def repeats_only(reads: DataFrame, k: int = K, error: float = 0.05) -> DataFrame:
    """Packed counts without most k-mers that occur once: two filters instead of a table of all k-mers.

    A first pass adds every k-mer to a filter and what that filter has seen
    before to a second one; a second pass counts what the second filter may
    hold. Every k-mer that occurs twice is counted in full; of the others about
    `error` are let through by chance.
    """
    return repeats_of(stored(packed_partials(reads, k), "kmers"), error)


def repeats_of(partials: DataFrame, error: float = 0.05) -> DataFrame:
    """repeats_only of partial counts that are stored, as they are read twice and more."""
    size = sketches.Size.of(max(1, partials.count()), error)
    key = F.xxhash64(*partials.columns[:-1])
    again = sketches.added(partials, key, size).filter("seen or n > 1")
    repeats = stored(sketches.built(again, key, size), "repeats")
    return summed(sketches.possible(partials, key, repeats, size))


def unpacked_counts(counts: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) of packed counts."""
    return counts.select(kmer_of([F.col(f"w{i}") for i in range(key_words(k))], k).alias("kmer"), "cnt")


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kmer", F.col("kmer").cast("string"))


def canonical(reads: DataFrame, k: int = K, trim: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a window of column s, in its canonical form, in column kmer."""
    return _as_text(_canonical(reads, k, trim, keep))


def counts_of(reads: DataFrame, keys: DataFrame, k: int = K) -> DataFrame:
    """counts of those k-mers that keys (kmer) has: others leave before the aggregate and its shuffle."""
    asked = keys.select(F.col("kmer").cast("binary").alias("kmer")).distinct()
    return _as_text(_canonical(reads, k).join(asked, "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("cnt")))


def estimated(reads: DataFrame, file: str, order: str, size: Column, limit: int = 100_000, k: int = K) -> DataFrame:
    """One row: records, lines and k-mers of FASTQ-like files, estimated from each file's first records.

    Of every file the first limit + 1 records by `order` are read; its records in
    all are its size over their mean size (whole numbers), and what was counted
    is divided by the share of records read, over all files.
    """
    own = Window.partitionBy(file).orderBy(order)
    rows = reads.select(file, F.length("s").alias("n"), size.alias("size"), F.row_number().over(own).alias("at"))
    whole = reads.groupBy(file).agg(F.sum(size).alias("whole"))
    some = rows.filter(F.col("at") <= limit + 1).groupBy(file).agg(F.count("*").alias("read"), F.sum("size").alias("bytes"), F.sum(F.when((F.col("at") <= limit) & (F.col("n") >= k), F.col("n") - k + 1).otherwise(0)).alias("kmers"))
    found = some.join(whole, file).select("read", "kmers", F.floor(F.col("whole") / F.floor(F.col("bytes") / F.col("read"))).alias("of"))
    total = found.agg(F.sum("read").alias("read"), F.sum("kmers").alias("kmers"), F.sum("of").alias("of"))
    share = F.col("read") / F.col("of")
    return total.select(F.floor(F.col("read") / share).cast("long").alias("records"), F.floor(4 * F.col("read") / share).cast("long").alias("lines"), F.floor(F.col("kmers") / share).cast("long").alias("kmers"))


def repeated(reads: DataFrame, k: int = K, threshold: int = 2) -> DataFrame:
    """Counts of at least the threshold, which is 2 or more: single k-mers never pass. Keys of up to 64 bases are packed until they have passed."""
    enough = F.col("cnt") >= max(2, threshold)
    return unpacked_counts(packed_counts(reads, k).filter(enough), k) if k <= 64 else counts(reads, k).filter(enough)


def looked_up(keys: DataFrame, table: DataFrame) -> DataFrame:
    """keys with their count, 0 where they are missing."""
    return keys.join(table, "kmer", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))
