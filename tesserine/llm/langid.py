"""Language identification by bit-sliced Bloom filters of letter n-grams.

Training counts, over every labelled row given, the n-grams of each language
and keeps those with at least `share` of their language's n-grams; a language
thus has at most 1 / share of them, whatever the size of the corpus.  All
languages share arrays of words, one for every 64 languages, in which bit l % 64
of a slot of array l // 64 belongs to language l; the AND of an n-gram's slots is the set of languages that contain it.  For a
text, each language's hits are counted over its n-grams, the filter's expected
false positives are taken out, and the greatest corrected share decides.

Letters are lower-cased; any run of other characters is one boundary.

Defined results: a null text, or one without a letter, is `und` with score 0;
so is every text where nothing was learned.  Ties go to the language that sorts
first.  Whole texts of any length are read; repeated rows are judged each for
itself and count each in training; an empty table gives an empty one;
other columns may have any names and stay as they are where rows are passed on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_worker
from .common import Sent, map_rows, mix, slices, utf8

NONE = "und"


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(offsets: np.ndarray, data: np.ndarray, n: int, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each n-gram, its hash, letters of each row)."""
    rows = len(offsets) - 1
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = fold[codes]
    row = np.repeat(np.arange(rows), np.diff(lead[offsets]))
    letters = np.bincount(row[c != 0], minlength=rows)
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    c, row = c[keep].astype(np.uint64), row[keep]
    # every text stands between two boundaries
    first = np.searchsorted(row, np.arange(rows))
    c, row = np.insert(c, first, 0), np.insert(row, first, np.arange(rows))
    last = np.searchsorted(row, np.arange(rows), "right")
    c, row = np.insert(c, last, 0), np.insert(row, last, np.arange(rows))
    again = np.ones(len(c), bool)
    again[1:] = (c[1:] != 0) | (c[:-1] != 0) | (row[1:] != row[:-1])
    c, row = c[again], row[again]
    if len(c) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), letters
    m = len(c) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) ^ c[k : m + k]
    same = row[:m] == row[n - 1 :]
    return row[:m][same], mix(h[same]), letters


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray
    probes: int
    false: np.ndarray

    def masks(self, h: np.ndarray, word: int) -> np.ndarray:
        """Languages 64 * word and on that contain each n-gram."""
        slots = self.slots[word]
        size = np.uint64(len(slots) - 1)
        out = slots[(h & size).astype(np.int64)]
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(1, self.probes):
            out &= slots[((h + np.uint64(k) * step) & size).astype(np.int64)]
        return out

    def shares(self, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        """Corrected share of each row's n-grams in each language."""
        total = np.maximum(np.bincount(row, minlength=rows), 1)
        out = np.zeros((rows, len(self.languages)))
        for k in range(len(self.languages)):
            if k % 64 == 0:
                masks = self.masks(h, k // 64)
            hit = ((masks >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
            out[:, k] = (np.bincount(row[hit], minlength=rows) / total - self.false[k]) / (1 - self.false[k])
        return np.clip(out, 0, 1)


def build(languages: list[str], learned: list[tuple[int, int]], probes: int = 4, room: int = 24) -> Filters:
    """learned: (language, n-gram hash)."""
    most = max(np.bincount([k for k, _ in learned]), default=0) if learned else 0
    size = 1 << int(np.ceil(np.log2(max(64, room * most))))
    slots = np.zeros((-(-len(languages) // 64), size), np.uint64)
    for k in range(len(languages)):
        h = np.array([g for x, g in learned if x == k], np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for p in range(probes):
            np.bitwise_or.at(slots[k // 64], ((h + np.uint64(p) * step) & np.uint64(size - 1)).astype(np.int64), np.uint64(1 << k % 64))
    density = np.array([((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filters(languages, slots, probes, density**probes)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", n: int = 3, share: float = 2e-5) -> Filters:
    """Filters learned from all rows whose language and text are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = in_worker("fold", fold_table)
        got: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            offsets, data = utf8(b.column(1))
            names = np.array(b.column(0).to_pylist(), object)
            for i, j in slices(offsets):
                row, h, _ = grams(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], n, fold)
                of = names[i:j][row]
                for name in set(names[i:j]):
                    g, c = np.unique(h[of == name], return_counts=True)
                    if name in got:
                        g, back = np.unique(np.concatenate([got[name][0], g]), return_inverse=True)
                        c = np.bincount(back, np.concatenate([got[name][1], c])).astype(np.int64)
                    got[name] = g, c
        for name, (g, c) in got.items():
            for k in range(0, len(g), 50_000):
                part = g[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part.view(np.int64)), pa.array(c[k : k + 50_000])], ["lang", "gram", "n"])

    seen = labelled.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).filter("l is not null and t is not null").mapInArrow(count, "lang string, gram bigint, n bigint")
    counts = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a share of all of the language's n-grams: at most 1 / share rows a language reach the driver
    total = counts.groupBy("lang").agg(F.sum("n").alias("of"))
    kept = counts.join(F.broadcast(total), "lang").filter(F.col("n") >= share * F.col("of")).select("lang", "gram").toPandas()
    languages = sorted(kept["lang"].unique())
    place = {x: i for i, x in enumerate(languages)}
    return build(languages, [(place[x], int(g) % (1 << 64)) for x, g in zip(kept["lang"], kept["gram"], strict=True)])


def predict(df: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """The key with lang_pred and score; n as in training."""
    kind = dict(df.dtypes)[key]
    sent = Sent(df.sparkSession, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = judge(b.column(1), sent.value, n)
            yield pa.RecordBatch.from_arrays([b.column(0), names, scores], ["k", "lang_pred", "score"])

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def judge(texts: pa.Array, filters: Filters, n: int) -> tuple[pa.Array, pa.Array]:
    fold = in_worker("fold", fold_table)
    offsets, data = utf8(texts)
    rows = len(offsets) - 1
    best, score = np.full(rows, len(filters.languages)), np.zeros(rows)
    for i, j in slices(offsets):
        row, h, letters = grams(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], n, fold)
        if filters.languages:
            shares = filters.shares(row, h, j - i)
            top = shares.argmax(1)
            some = letters > 0
            best[i:j] = np.where(some, top, len(filters.languages))
            score[i:j] = np.where(some, shares[np.arange(j - i), top], 0.0)
    names = np.array([*filters.languages, NONE], object)[best]
    return pa.array(names, pa.string()), pa.array(score, pa.float64())


def keep_known(df: DataFrame, filters: Filters, text: str = "text", n: int = 3, least: float = 0.35) -> DataFrame:
    """The rows of df whose text has a known language: not `und`, and a score of at least `least`."""
    sent = Sent(df.sparkSession, filters)

    def run(at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = judge(b.column(at), sent.value, n)
            ok = (np.array(names.to_pylist(), object) != NONE) & (scores.to_numpy() >= least)
            yield b.filter(pa.array(ok))

    return map_rows(df, run, text)
