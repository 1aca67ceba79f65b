"""Bloom filters of 64-bit words: all bits of a key lie in one word."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.hashing import FIRST, LAST, STEPS


@dataclass(frozen=True)
class Size:
    """Sizing for n keys and error p. With chain, a key, which is a long then, has its word and bits from one mix of 64 bits after the other; else they are hashes of seeds."""

    words: int
    hashes: int
    chain: bool = False

    @staticmethod
    def of(n: int, p: float, chain: bool = False) -> Size:
        bits = -math.log(p) / math.log(2) ** 2
        return Size(max(1, math.ceil(n * bits / 64)), math.ceil(math.log(2) * bits), chain)


def mixed(k: np.ndarray) -> np.ndarray:
    """hashing.mix64 of numbers of 64 bits, whose sums wrap around."""
    u = np.uint64
    k = ~k + (k << u(FIRST))
    for n, shifts in STEPS:
        k = k ^ (k >> u(n))
        k = sum((k << u(m) for m in shifts), k)
    k = k ^ (k >> u(LAST[0]))
    return k + (k << u(LAST[1]))


def chained(size: Size):
    """(word, mask) of keys by batches: the mix gives the word, the mix of it the first bit, and so on."""

    @F.pandas_udf("word bigint, mask bigint")
    def place(keys: pd.Series) -> pd.DataFrame:
        none = keys.isna().to_numpy()
        h = mixed(keys.fillna(0).to_numpy(np.int64).view(np.uint64))
        word, mask = h % np.uint64(size.words), np.zeros(len(h), np.uint64)
        for _ in range(size.hashes):
            h = mixed(h)
            mask |= np.uint64(1) << (h & np.uint64(63))
        found = pd.DataFrame({"word": word.view(np.int64), "mask": mask.view(np.int64)})
        if none.any():
            found = found.astype("Int64")
            found.loc[none, :] = pd.NA
        return found

    return place


def located(key: Column, size: Size) -> tuple[Column, Column]:
    """(word, mask) of a key."""
    if size.chain:
        place = chained(size)(key)
        return place["word"], place["mask"]
    mask = F.lit(0).cast("long")
    for k in range(size.hashes):
        bit = F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(k + 1)), 7), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.xxhash64(key), F.lit(size.words)), mask


def built(keys: DataFrame, key: Column, size: Size) -> DataFrame:
    """(word, bits): the filter, as many rows as words at most."""
    word, mask = located(key, size)
    return keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


#: Words of a filter that goes to the tasks as one value (8 MB); a larger one is joined.
VALUE = 1 << 20


def as_value(filter_: DataFrame, size: Size) -> Column:
    """The filter's words, in order, as one array: a subquery that runs once, whose result goes with the tasks."""
    every = filter_.sparkSession.range(size.words).join(filter_, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    # sort_array compares in generated code, array_sort by a function for each pair; a column of the structs is the array of its values
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "bits")))["bits"]).scalar()


def possible(rows: DataFrame, key: Column, filter_: DataFrame, size: Size, most: int = VALUE) -> DataFrame:
    """Rows whose key the filter may hold; none that it holds is lost. A filter of up to `most` words is tested in the scan of the rows."""
    word, mask = located(key, size)
    if size.words <= most:
        held = rows.withColumns({"_mask": mask, "_bits": F.get(as_value(filter_, size), word.cast("int"))})
        return held.filter(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_mask")).drop("_mask", "_bits")
    met = rows.withColumns({"_word": word, "_mask": mask}).join(filter_, F.col("_word") == F.col("word"))
    return met.filter(F.col("_mask").bitwiseAND(F.col("bits")) == F.col("_mask")).drop("_word", "_mask", "word", "bits")


def added(rows: DataFrame, key: Column, size: Size, *order: str) -> DataFrame:
    """rows with `seen`: whether a filter to which their keys are added one after the other, by `order`, may have held the key already.

    The words are dealt out to as many tasks as there are shuffle partitions;
    each holds its own words and no others.
    """
    deal = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = -(-size.words // deal)
    word, mask = located(key, size)
    n = len(rows.columns)
    plain = rows.toDF(*(f"c{i}" for i in range(n)))

    def spans(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)) if len(part) else []
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            yield int(part[i]), int(i), int(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            word, mask = (b.column(n + i).to_numpy(zero_copy_only=False) for i in range(2))
            mask = mask.view(np.uint64)
            # by word, then in order; before: the bits that a word has before each of its keys
            order = np.argsort(word, kind="stable")
            word, mask = word[order], mask[order]
            first = np.ones(len(word), bool)
            first[1:] = word[1:] != word[:-1]
            at = np.flatnonzero(first)
            turn = np.arange(len(word)) - np.repeat(at, np.diff(at, append=len(word)))
            before = np.where(first, np.uint64(0), np.roll(mask, 1))
            last = np.append(at[1:], len(word)) - 1
            for part, i, j in spans(word[at] // each):
                own = word[at[i:j]] % each
                filter_ = parts.setdefault(part, np.zeros(each, np.uint64))
                before[at[i:j]] = filter_[own]
            step = 1
            while step <= turn.max(initial=0):  # doubled: those of `step` keys, then of twice as many
                later = np.flatnonzero(turn >= step)
                before[later] |= before[later - step]
                step *= 2
            for part, i, j in spans(word[at] // each):
                parts[part][word[at[i:j]] % each] = before[last[i:j]] | mask[last[i:j]]
            seen = np.empty(len(word), bool)
            seen[order] = before & mask == mask
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(seen)], [*(f"c{i}" for i in range(n)), "seen"])

    dealt = rows.select(*rows.columns, word.alias("_word"), mask.alias("_mask")).repartition(deal, F.expr(f"_word div {each}"))
    ordered = dealt.sortWithinPartitions(*order) if order else dealt
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(plain.dtypes)), "seen boolean"])
    return ordered.toDF(*plain.columns, "word", "mask").mapInArrow(run, schema).toDF(*rows.columns, "seen")


def cardinality(filter_: DataFrame, size: Size) -> DataFrame:
    """Estimate of the keys from the bits set."""
    m = 64.0 * size.words
    used = F.sum(F.bit_count("bits")) / F.lit(m)
    return filter_.agg(F.floor(-(m / size.hashes) * F.log(1 - used) + 0.5).cast("long").alias("estimate"))


def memory(size: Size) -> int:
    """Bytes of the bits of a filter."""
    return 8 * size.words


def cleared(filter_: DataFrame) -> DataFrame:
    """The filter without any key."""
    return filter_.filter("false")


def places(key: Column, size: Size) -> Column:
    """The bits of a key in a classic filter: a + i b modulo the bits, of two halves of hashes."""
    half = lambda seed: F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 24)
    return F.array_distinct(F.array(*(F.pmod(half(1) + i * half(2), F.lit(64 * size.words)) for i in range(size.hashes))))


def classic(keys: DataFrame, key: Column, size: Size) -> DataFrame:
    """(word, bits): a filter whose keys have bits anywhere."""
    bit = keys.select(F.explode(places(key, size)).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    return bit.select(F.expr("bit div 64").alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def classic_possible(rows: DataFrame, key: str, filter_: DataFrame, size: Size, most: int = VALUE) -> DataFrame:
    """(key): the distinct keys that a classic filter may hold. A filter of up to `most` words is tested in the scan of the rows."""
    asked = rows.select(F.col(key).alias("key")).distinct()
    if size.words <= most:
        words = as_value(filter_, size)
        bits = asked.select("key", places(F.col("key"), size).alias("bits"), words.alias("words"))
        bit = lambda i: F.coalesce(F.get("bits", F.lit(i)), F.get("bits", F.lit(0)))  # noqa: E731  equal places stand once
        held = lambda i: F.getbit(F.get("words", F.call_function("div", bit(i), F.lit(64)).cast("int")), (bit(i) % 64).cast("int")) == 1
        test = held(0)
        for i in range(1, size.hashes):
            test = test & held(i)
        return bits.filter(test).select(F.col("key").alias(key))
    asked = asked.select("key", F.explode(places(F.col("key"), size)).alias("bit"))
    met = asked.join(filter_, F.expr("bit div 64") == F.col("word"), "left")
    held = F.coalesce(F.getbit("bits", (F.col("bit") % 64).cast("int")) == 1, F.lit(False))
    return met.groupBy("key").agg(F.bool_and(held).alias("held")).filter("held").select(F.col("key").alias(key))


def distinct_sketches(df: DataFrame, key: Column, *by: str, bits: int = 12) -> DataFrame:
    """(by, sketch): HyperLogLog sketches of the keys of each part, which can be stored and united later; their error is about 1.04 / 2 ** (bits / 2)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, bits).alias("sketch"))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, estimate): distinct keys of the union of sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("estimate"))
