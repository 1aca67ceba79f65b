"""Language-model scoring by a hierarchical Pitman-Yor model.

Words are served in restaurants, one for each context.  The `own` previous words
that occur most often have one each; rarer ones, which have few tokens to learn
from, are hashed to classes that share one.  All contexts share one parent restaurant,
whose base measure is even over the known words and one unknown.  Customers are
a context's tokens; the tables of a word in the contexts are the customers of
the parent.  Seating is sampled by Gibbs: in a sweep every customer leaves the
table and sits down anew, at a table in proportion to its customers less the
discount, or at a new one in proportion to the parent's probability.  For a pair
of up to SMALL customers the number of tables is drawn at once from what such
moves tend to (its weight is a generalised Stirling number); larger ones begin
at one table and move SETTLE times in the first sweep.  A pair seen once sits alone
whatever the rest, so only other pairs are kept as state.  Texts are scored by
the predictive probability averaged over the last samples.  Random numbers come
from the hash of a pair's word and context and the sweep, so a score does not
depend on how many tasks there are.

Words go to buckets by hash.  A task passes on arrays, already summed, one row a
bucket; what all buckets must know (customers and tables of each context) are
CONTEXTS numbers, whatever the corpus.  In scoring, a word so frequent that
its tokens would outgrow a bucket is spread over several, each with a copy of
that word's counts.

Defined results: a null text counts as empty and has one token, its end; texts
of any length are read whole; repeated rows count and are scored each for
itself; a null id is one like any other; an empty table gives an empty one, and
with nothing to learn from every token has the probability of the unknown word.
Only the id, the text and the flag are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import in_worker
from .common import Sent, WordHasher, drop_written, mix, partitions, slices, trimmed, utf8, written

END = np.uint64(0x7F4A7C159E3779B9)
#: Tokens that a task gathers before it passes them on.
GATHER = 250_000
#: Parts of a bucket that are worked on one after the other.
PARTS = 8
#: Contexts: the start of a text, own words and classes; a code of 16 bits.
CONTEXTS = 1 << 16
#: Customers up to which the number of tables is drawn at once; above, they move one by one.
SMALL = 1024
#: Times that the customers of a larger one sit down anew in its first sweep.
SETTLE = 4


@dataclass
class Totals:
    """What all buckets must know."""

    tokens: int
    words: int
    customers: np.ndarray
    tables: np.ndarray
    parent_customers: int = 0
    parent_tables: int = 0
    discount: float = 0.8
    parent_discount: float = 0.8
    strength: float = 1.0

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words in the parent restaurant."""
        rest = (self.strength + self.parent_discount * self.parent_tables) / (self.words + 1)
        return (customers - self.parent_discount * tables + rest) / (self.strength + self.parent_customers)

    def child(self, context: np.ndarray, count: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability of words in a context's restaurant."""
        return (count - self.discount * tables + (self.strength + self.discount * self.tables[context]) * parent) / (self.strength + self.customers[context])


def context_of(word: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Codes of previous words: own, sorted, have 1 and on, the rest those behind by hash; 0 is the start of a text."""
    rest = 1 + len(own) + ((word >> np.uint64(33)) % np.uint64(CONTEXTS - 1 - len(own))).astype(np.int64)
    if not len(own):
        return rest
    at = np.minimum(np.searchsorted(own, word), len(own) - 1)
    return np.where(own[at] == word, 1 + at, rest)


def most_frequent(counts: DataFrame, own: int) -> DataFrame:
    """Of counts (w, n) the own words of greatest n, of equal ones those of least w. Only numbers of words by n come to the driver, not a list of each task."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    upto = np.cumsum(sizes["words"].to_numpy(np.int64))
    k = int(np.searchsorted(upto, own))
    if k == len(upto):
        return counts.select("w")
    last = int(sizes["n"].iloc[k])
    if upto[k] == own:
        return counts.filter(F.col("n") >= last).select("w")
    rest = own - (int(upto[k - 1]) if k else 0)
    return counts.filter(F.col("n") > last).select("w").unionByName(counts.filter(F.col("n") == last).orderBy("w").limit(rest).select("w"))


def frequent_words(learned: DataFrame, own: int) -> np.ndarray:
    """The own words that occur most often in all documents, of those found twice or more."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count = WordHasher(), [], 0
        for b in batches:
            offsets, data = utf8(b.column(0))
            for i, j in slices(offsets):
                held.append(hasher(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])[1])
                count += len(held[-1])
                if count >= GATHER:
                    yield counted(held)
                    held, count = [], 0
        if held:
            yield counted(held)

    counts = written(learned.select("t").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1"), "counts")
    found = most_frequent(counts, own).toPandas()
    drop_written(counts)
    return np.sort(found["w"].to_numpy(np.int64).view(np.uint64))


def uniform(word: np.ndarray, context: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to below 1 for pairs, by hash."""
    with np.errstate(over="ignore"):
        h = mix(word ^ mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
    return (h >> np.uint64(11)) * 2.0**-53


def tokens(offsets: np.ndarray, data: np.ndarray, hasher: WordHasher, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, context) of every token, an end behind each row's words."""
    n = len(offsets) - 1
    row, word = hasher(offsets, data)
    last = np.searchsorted(row, np.arange(n), "right")
    row, word = np.insert(row, last, np.arange(n)), np.insert(word, last, END)
    context = np.zeros(len(word), np.int64)
    context[1:] = np.where(row[1:] == row[:-1], context_of(word[:-1], own), 0)
    return row, word, context


def by_word(word: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, pairs of each, code of each pair, tokens of each pair), by word, then code."""
    words, at = np.unique(word, return_inverse=True)
    top = int(code.max(initial=0)) + 1
    pair, count = np.unique(at * top + code, return_counts=True)
    return words, np.bincount(pair // top, minlength=len(words)), pair % top, count


def gathered(batches: Iterator[pa.RecordBatch], own: np.ndarray):
    """Per GATHER tokens: (keys, flags, tokens' document, word and context); documents number from 0."""
    hasher, held, count = WordHasher(), [], 0
    for b in batches:
        offsets, data = utf8(b.column(1))
        flag = b.column(2).to_numpy(zero_copy_only=False)
        for i, j in slices(offsets):
            got = tokens(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], hasher, own)
            held.append((b.column(0).slice(i, j - i), flag[i:j], *got))
            count += len(got[1])
            if count >= GATHER:
                yield together(held)
                held, count = [], 0
                trimmed()
    if held:
        yield together(held)


def together(held):
    first = np.cumsum([0, *(len(h[0]) for h in held)])
    docs = np.concatenate([h[2] + f for h, f in zip(held, first, strict=False)])
    return pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]).astype(bool), docs, np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])


def dealt(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(1, buckets + 1))
    return ((k, order[a:z]) for k, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if z > a)


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def count(learned: DataFrame, own: Sent, buckets: int) -> DataFrame:
    """(bucket, data): counts of pairs, one row a bucket and task's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, word, context in gathered(batches, own.value):
            words, n, code, c = by_word(word, context)
            first = np.cumsum(n) - n
            rows = []
            for k, mine in dealt((words % np.uint64(buckets)).astype(np.int64), buckets):
                at = spans(first[mine], n[mine])
                rows.append((k, pickle.dumps((words[mine], least_wide(n[mine]), code[at].astype(np.uint16), least_wide(c[at])), 5)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

    return learned.mapInArrow(run, "bucket int, data binary")


def least_wide(n: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes."""
    return n.astype(np.min_scalar_type(n.max(initial=0)))


def packed(value) -> bytes:
    """A value in few bytes."""
    raw = pickle.dumps(value, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "lz4", asbytes=True)


def unpacked(data: bytes | pa.Buffer):
    data = memoryview(data)
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "lz4"))


def sparse(n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of what is not 0; a bucket knows few of all contexts."""
    n = np.atleast_1d(n)
    at = np.flatnonzero(n)
    kind = np.result_type(*map(np.min_scalar_type, (n.min(initial=0), n.max(initial=0))))
    return least_wide(at), n[at].astype(kind if kind.itemsize < 8 else np.int64)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)


@dataclass
class Seats:
    """Words of one bucket with the pairs that are kept: those of two tokens or more, of frequent words all.

    sizes: customers of each table of a pair, and of a word in the parent, that has more than SMALL, by its place.
    """

    words: np.ndarray
    count: np.ndarray
    alone: np.ndarray
    pairs: np.ndarray
    context: np.ndarray
    tokens: np.ndarray
    tables: np.ndarray
    sizes: dict[int, list[int]]
    parent_tables: np.ndarray
    parent_sizes: dict[int, list[int]]
    samples: list

    def customers(self) -> np.ndarray:
        """Of each word in the parent: its tables in all contexts."""
        of = np.repeat(np.arange(len(self.words)), self.pairs)
        return self.alone + np.bincount(of, self.tables, len(self.words)).astype(np.int64)


def frozen(s: Seats) -> bytes:
    """Seats in few bytes, so that the rows that pass through Java are small: most numbers are 0 or 1."""
    state = {k: least_wide(v) if isinstance(v, np.ndarray) else v for k, v in vars(s).items()}
    return packed(state | {"samples": [tuple(map(least_wide, x)) for x in s.samples]})


def thawed(data: bytes | pa.Buffer) -> Seats:
    s = Seats(**unpacked(data))
    s.words, s.context, s.tokens = s.words.astype(np.uint64), s.context.astype(np.uint16), narrow(s.tokens)
    s.count, s.alone, s.pairs, s.tables, s.parent_tables = (x.astype(np.int64) for x in (s.count, s.alone, s.pairs, s.tables, s.parent_tables))
    return s


def seated(group: list[bytes], frequent: int, contexts: int = CONTEXTS) -> tuple[list[Seats], dict]:
    """Counts of one bucket to its first seating, one table a pair: (main, then a part for each frequent word), and what the totals need."""
    parts = [pickle.loads(x) for x in group]
    word = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    context = np.concatenate([p[2] for p in parts]).astype(np.int64)
    c = np.concatenate([p[3] for p in parts]).astype(np.int64)
    words, at = np.unique(word, return_inverse=True)
    pair, back = np.unique(at * contexts + context, return_inverse=True)
    c = np.bincount(back, c).astype(np.int64)
    of, context = pair // contexts, pair % contexts
    total = np.bincount(of, c, len(words)).astype(np.int64)
    spread = np.bincount(of, minlength=len(words))
    sums = {"customers": np.bincount(context, c, contexts).astype(np.int64), "tables": np.bincount(context, minlength=contexts), "words": len(words), "tokens": int(c.sum()), "ones": int((c == 1).sum()), "twos": int((c == 2).sum()), "parent": int(len(c)), "parent_ones": int((spread == 1).sum()), "parent_twos": int((spread == 2).sum())}
    often = total > frequent

    def take(pick: np.ndarray, least: int) -> Seats:
        own = np.flatnonzero(pick)
        keep = pick[of] & (c >= least)
        alone = np.bincount(of[pick[of] & (c < least)], minlength=len(words))[own]
        n = np.bincount(of[keep], minlength=len(words))[own]
        one = np.ones(int(keep.sum()), np.int64)
        return Seats(words[own], total[own], alone, n, context[keep].astype(np.uint16), narrow(c[keep]), one, {}, np.ones(len(own), np.int64), {}, [])

    single = [take(np.arange(len(words)) == k, 1) for k in np.flatnonzero(often)]
    return [take((total >= 2) & ~often, 2), *single], sums


def log_stirling(discount: float) -> np.ndarray:
    """[c, t]: log weight of all seatings of c customers at t tables, c up to SMALL, new tables weighing 1."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, SMALL + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, SMALL + 1):
            stay = np.where(t < c, out[c - 1, 1:] + np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf)
            out[c, 1:] = np.logaddexp(out[c - 1, :-1], stay)
    return out


def drawn(count: np.ndarray, fresh: np.ndarray, step: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of restaurants' dishes of 1 to SMALL customers, drawn exactly given the weight of a new table, fresh and step for each of the dish's tables: what endless reseating tends to."""
    out = np.ones(len(count), np.int64)
    order = np.argsort(count, kind="stable")
    ends = np.searchsorted(count[order], np.arange(1, SMALL + 2))
    if len(count) > ends[0]:
        weight = in_worker(f"stirling {discount}", lambda: log_stirling(discount))
    for c in range(2, SMALL + 1):
        for k in range(ends[c - 1], ends[c], max(1, 250_000 // c)):
            own = order[k : min(ends[c], k + max(1, 250_000 // c))]
            p = weight[c, 1 : c + 1] + np.cumsum(np.log(fresh[own][:, None] + step[own][:, None] * np.arange(c)), 1)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            out[own] = 1 + np.minimum((p < (u[own] * p[:, -1])[:, None]).sum(1), c - 1)
    return out


def anew(sizes: list[int], total: int, fresh: float, step: float, discount: float, moves: int, rng) -> list[int]:
    """Tables of one restaurant's dish after customers, random ones, left or came until there are total, and `moves` different ones then left and sat down anew."""
    sizes, random = list(sizes), Random(int(rng.integers(1 << 62))).random
    seat = np.repeat(np.arange(len(sizes)), sizes)
    rng.shuffle(seat)
    for k in seat[total:].tolist():
        sizes[k] -= 1
    seat = seat[:total].tolist()
    there = len(seat)
    seat += [-1] * (total - there)
    free = [k for k, n in enumerate(sizes) if not n]
    used = len(sizes) - len(free)
    for j in [*range(there, total), *rng.permutation(total)[:moves].tolist()]:
        k = seat[j]
        if k < 0:  # one who comes; those up to j are there
            n = others = j
        else:
            n, others = total, total - 1
            sizes[k] -= 1
            if not sizes[k]:
                used -= 1
                free.append(k)
        new = fresh + step * used
        if not used or random() * (others - discount * used + new) < new:
            if not free:
                free.append(len(sizes))
                sizes.append(0)
            k = free.pop()
            used += 1
        else:
            while True:  # the table of a random other customer, less the discount
                i = int(random() * n)
                if i != j and random() * sizes[seat[i]] >= discount:
                    break
            k = seat[i]
        sizes[k] += 1
        seat[j] = k
    return [n for n in sizes if n]


def reseat(tables: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, discount: float, moves: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """In every restaurant and dish, `moves` customers, all at most, leave and sit down anew. fresh: weight of a new table."""
    ends = np.cumsum(tables)
    got = [anew(s := sizes[z - n : z].tolist(), sum(s), f, 0.0, discount, moves, rng) for z, n, f in zip(ends.tolist(), tables.tolist(), fresh.tolist(), strict=True)]
    return np.array([len(x) for x in got], np.int64), np.array([n for x in got for n in x], np.int64)


def seat(count: np.ndarray, sizes: dict[int, list[int]], fresh: np.ndarray, step: np.ndarray, discount: float, u: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
    """(tables of each, sizes of tables of those of more than SMALL customers) after every customer was seated anew. u: a random number for each."""
    large = count > SMALL
    tables = np.ones(len(count), np.int64)
    tables[~large] = drawn(count[~large], fresh[~large], step[~large], discount, u[~large])
    got = {}
    for k in np.flatnonzero(large).tolist():
        n = int(count[k])
        x, rng = sizes.get(k, [n]), np.random.default_rng(int(u[k] * 2**53))
        for _ in range(1 if k in sizes else SETTLE):
            x = anew(x, n, float(fresh[k]), float(step[k]), discount, n, rng)
        got[k], tables[k] = x, len(x)
    return tables, got


def sweep(s: Seats, totals: Totals, sample: bool, seed: int) -> Seats:
    """One sweep over a bucket's seats, every customer of the contexts, then of the parent, given the totals of the sweep before."""
    p = totals.parent(s.customers(), s.parent_tables)
    of = np.repeat(np.arange(len(s.words)), s.pairs)
    fresh = (totals.strength + totals.discount * (totals.tables[s.context] - s.tables)) * p[of]
    s.tables, s.sizes = seat(s.tokens, s.sizes, fresh, totals.discount * p[of], totals.discount, uniform(s.words[of], s.context, 2 * seed))
    after = s.customers()
    rest = (totals.strength + totals.parent_discount * (totals.parent_tables - s.parent_tables)) / (totals.words + 1)
    step = np.full(len(s.words), totals.parent_discount / (totals.words + 1))
    s.parent_tables, s.parent_sizes = seat(after, s.parent_sizes, rest, step, totals.parent_discount, uniform(s.words, np.zeros(len(s.words), np.int64), 2 * seed + 1))
    if sample:
        s.samples.append((narrow(s.tables), narrow(after), narrow(s.parent_tables)))
    return s


def state_of(learned: DataFrame, own: Sent, buckets: int, share: float, least: int, contexts: int = CONTEXTS) -> tuple[DataFrame, Totals]:
    """The first seating and its totals. share: bucket's mean tokens from which a word is frequent."""

    def merge(group: pa.Table, frequent: int = 0) -> pa.Table:
        seats, sums = seated(group.column("data").to_pylist(), frequent)
        b = group.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([b] * len(seats), pa.int32()), "part": pa.array(range(len(seats)), pa.int32()), "data": pa.array([frozen(s) for s in seats], pa.binary()), "sums": pa.array([packed({k: sparse(v) for k, v in sums.items()})] + [None] * (len(seats) - 1), pa.binary())})

    # tokens of the whole text set the size of a bucket; the count is a bound, words and ends are at most its characters and rows
    chars = learned.select(F.sum(F.coalesce(F.length("t"), F.lit(0)) + 1)).first()[0] or 0
    total = chars // 4
    frequent = max(least, int(share * total / buckets))
    counts = count(learned, own, buckets)
    seats = written(counts.groupBy("bucket").applyInArrow(lambda g: merge(g, frequent), "bucket int, part int, data binary, sums binary"), "seats", compression="none")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # a task passes on one sum of each
        for b in batches:
            for x in b.column(0):
                for k, (at, n) in unpacked(x.as_buffer()).items():
                    sums.setdefault(k, np.zeros(contexts, np.int64))[at] += n
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(v[at])], ["name", "at", "n"])

    found = seats.filter("sums is not null").select("sums").mapInArrow(add, "name string, at bigint, n bigint").groupBy("name", "at").agg(F.sum("n").alias("n")).toPandas()
    def vector(name: str, size: int) -> np.ndarray:
        rows = found[found["name"] == name]
        return np.bincount(rows["at"], rows["n"], size).astype(np.int64)

    one = lambda k: int(vector(k, 1)[0])
    part = lambda a, b: min(0.95, max(0.05, a / max(1, a + 2 * b)))
    totals = Totals(one("tokens"), one("words"), vector("customers", contexts), vector("tables", contexts), one("parent"), one("words"), part(one("ones"), one("twos")), part(one("parent_ones"), one("parent_twos")))
    return seats.drop("sums"), totals


def swept(seats: DataFrame, totals: Totals, sample: bool, seed: int) -> tuple[DataFrame, Totals]:
    """A sweep over all buckets, and the totals after it."""
    contexts = len(totals.customers)
    sent = Sent(seats.sparkSession, totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = thawed(data.as_buffer())
                tables, parents, c = s.tables.copy(), int(s.parent_tables.sum()), int(s.customers().sum())
                s = sweep(s, sent.value, sample, seed)
                trimmed()
                change = np.bincount(s.context, s.tables - tables, contexts).astype(np.int64)
                more = packed((*sparse(change), int(s.customers().sum()) - c, int(s.parent_tables.sum()) - parents))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([frozen(s)], pa.binary()), pa.array([more], pa.binary())], ["bucket", "part", "data", "more"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(contexts + 2, np.int64)  # tables of each context, then customers and tables of the parent
        for b in batches:
            for x in b.column(0):
                at, change, c, p = unpacked(x.as_buffer())
                sums[at] += change
                sums[contexts:] += (c, p)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    now = written(seats.mapInArrow(run, "bucket int, part int, data binary, more binary"), "seats", compression="none")
    found = now.select("more").mapInArrow(add, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    change = np.bincount(found["at"], found["n"], contexts + 2).astype(np.int64)
    after = Totals(totals.tokens, totals.words, totals.customers, totals.tables + change[:contexts], totals.parent_customers + int(change[contexts]), totals.parent_tables + int(change[contexts + 1]), totals.discount, totals.parent_discount, totals.strength)
    drop_written(seats)
    return now.drop("more"), after


def by_part(words: np.ndarray, n: np.ndarray, code: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, tuple]]:
    """A bucket's distinct words with their tokens, grouped by word, as the parts of the bucket: (part, the same four of it)."""
    of = (words % np.uint64(buckets * PARTS) // np.uint64(buckets)).astype(np.uint8)
    token = np.repeat(of, n)
    own, at = np.argsort(of, kind="stable"), np.argsort(token, kind="stable")
    ends, last = np.cumsum(np.bincount(of, minlength=PARTS)), np.cumsum(np.bincount(token, minlength=PARTS))
    for part, (a, z, i, j) in enumerate(zip([0, *ends[:-1]], ends, [0, *last[:-1]], last, strict=True)):
        if z > a:
            yield part, (words[own[a:z]], n[own[a:z]], code[at[i:j]], docs[at[i:j]])


def pairs_of(shares: list[tuple], spot: list[np.ndarray], contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of word's place and context, tokens of each) of the documents learned from."""
    key, used = np.empty(sum(len(s[3]) for s in shares), np.int64), 0
    for (_, _, n, code, docs, train), own in zip(shares, spot, strict=True):
        learned = np.unpackbits(train)[docs].astype(bool)
        more = np.repeat(own, n)[learned] * contexts + code[learned]
        key[used : used + len(more)] = more
        used += len(more)
    key = key[:used]
    key.sort()
    first = np.flatnonzero(np.concatenate(([True] * (used > 0), key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, used))


def bucket_scores(shares: list[tuple], seats: list[Seats], totals: list[Totals], contexts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each share of a task: (its number, [known tokens, base score, score] of its documents up to the last one met).

    shares: (number, distinct words, tokens of each, their contexts, their documents, bits of the documents learned from).
    Only pairs and one share's tokens at a time are held in wide numbers.
    """
    learned, whole = totals[0], {int(s.words[0]): s for s in seats[1:]}
    main = seats[0] if seats else None
    # counts of the words whose tokens are all here
    words, back = np.unique(np.concatenate([s[1] for s in shares]), return_inverse=True)
    spots = np.split(back, np.cumsum([len(s[1]) for s in shares])[:-1])
    n = len(words)
    pair, c = pairs_of(shares, spots, contexts)
    total = np.bincount(pair // contexts, c, n).astype(np.int64)
    samples = [(np.ones(len(pair)), np.bincount(pair // contexts, minlength=n).astype(float), (total > 0).astype(float)) for _ in totals]
    extra_pair, extra_c, extra_t = [], [], [[] for _ in totals]
    for s, every in [*([(main, False)] if main is not None else []), *((s, True) for s in whole.values())]:
        there = np.searchsorted(words, s.words)
        here = (there < n) & (words[np.minimum(there, n - 1)] == s.words)
        of = np.repeat(np.arange(len(s.words)), s.pairs)
        code_of = np.where(here[of], there[of] * contexts + s.context, -1)
        use = np.flatnonzero(here[of])
        for k, (tables, customers, parents) in enumerate(s.samples):
            samples[k][1][there[here]] = customers[here]
            samples[k][2][there[here]] = parents[here]
            if every:
                extra_t[k].append(tables[use].astype(float))
            else:
                samples[k][0][np.searchsorted(pair, code_of[use])] = tables[use]
        if every:
            total[there[here]] = s.count[here]
            extra_pair.append(code_of[use])
            extra_c.append(s.tokens[use])
    if extra_pair:
        hot = np.isin(pair // contexts, np.searchsorted(words, np.array(list(whole), np.uint64)))
        pair, c = np.concatenate([pair[~hot], *extra_pair]), np.concatenate([c[~hot], *extra_c])
        order = np.argsort(pair)
        pair, c = pair[order], c[order]
        samples = [(np.concatenate([t[~hot], *x])[order], u, v) for (t, u, v), x in zip(samples, extra_t, strict=True)]
    parent = [t.parent(u, v) for t, (_, u, v) in zip(totals, samples, strict=True)]
    base = np.log10((total + 1) / (learned.tokens + learned.words + 1))
    for (number, _, size, code, docs, _), spot in zip(shares, spots, strict=True):
        word = np.repeat(spot, size)
        want = word * contexts + code
        at = np.minimum(np.searchsorted(pair, want), max(len(pair) - 1, 0))
        met = pair[at] == want if len(pair) else np.zeros(len(want), bool)
        p = np.zeros(len(word))
        for t, (tables, _, _), up in zip(totals, samples, parent, strict=True):
            p += t.child(code, np.where(met, c[at], 0) if len(pair) else 0, np.where(met, tables[at], 0) if len(pair) else 0, up[word])
        yield number, np.stack([np.bincount(docs, x) for x in (total[word] > 0, base[word], np.log10(p / len(totals)))])


def spread_evenly(spark: SparkSession, n: int) -> np.ndarray:
    """Keys for n buckets of which a shuffle brings no two to one partition, where there are n partitions; by their numbers several meet and others stay empty."""
    found = spark.range(40 * n).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at"))
    found = {r["at"]: r["key"] for r in found.groupBy("at").agg(F.min("key").alias("key")).collect()}
    return np.array([found.get(k, 40 * n + k) for k in range(n)], np.int32)


def score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", own: int = 32_000, burn_in: int = 3, samples: int = 2, seed: int = 11, share: float = 2.0, least_frequent: int = 50_000) -> DataFrame:
    """The key with held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from rows that held_out, an expression, leaves."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    buckets = partitions(spark, 8)
    docs = df.select(df[key].alias("k"), F.coalesce(df[text], F.lit("")).alias("t"), held_out.alias("h"))
    learned = docs.filter("not h")
    alone = Sent(spark, frequent_words(learned, own))
    seats, totals = state_of(learned, alone, buckets * PARTS, share, least_frequent)
    kept: list[Totals] = []
    for k in range(burn_in + samples):
        seats, after = swept(seats, totals, k >= burn_in, seed + k)
        totals = after
        if k >= burn_in:
            kept.append(totals)
    mean = max(1, totals.tokens // buckets)

    def word_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = thawed(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([int(s.words[0].view(np.int64))]), pa.array([int(s.count[0])])], ["w", "n"])

    # frequent words hold more than a share of a bucket each, so there are at most a few for each bucket
    often = {int(np.int64(r["w"]).view(np.uint64)): min(buckets, 1 + r["n"] // mean) for r in seats.filter("part > 0").select("data").mapInArrow(word_of, "w bigint, n bigint").collect()}
    keys_of = spread_evenly(spark, buckets)
    sent = Sent(spark, (kept, often))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        hot = np.array(sorted(sent.value[1]), np.uint64)
        ways = np.array([sent.value[1][int(w)] for w in hot.tolist()], np.int64)
        for turn, (keys, held, docs, word, context) in enumerate(gathered(batches, alone.value)):
            number = task * (1 << 24) + turn
            bucket = (word % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
                is_hot = hot[at] == word
                bucket = np.where(is_hot, (bucket + docs % ways[at]) % buckets, bucket)
            out = []
            order = np.lexsort((docs, word))
            for k, own in dealt(bucket[order], buckets):
                own = order[own]
                words, at = np.unique(word[own], return_inverse=True)
                out.append((keys_of[k], 2, number, pickle.dumps((words, least_wide(np.bincount(at)), context[own].astype(np.uint16), least_wide(docs[own]), np.packbits(~held)), 5)))
            size = np.bincount(docs, minlength=len(keys))
            out.append((keys_of[number % buckets], 0, number, pickle.dumps((keys.to_pylist(), held, size), 5)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.binary())], ["bucket", "what", "number", "data"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ways = 1 if part == 0 else sent.value[1][int(thawed(data.as_buffer()).words[0])]
                to = [(bucket % buckets + k) % buckets for k in range(ways)]
                for k in to:
                    yield pa.RecordBatch.from_arrays([pa.array([keys_of[k]], pa.int32()), pa.array([1 if part == 0 else 3], pa.int32()), pa.array([bucket // buckets], pa.int64()), pa.array([data.as_py()], pa.binary())], ["bucket", "what", "number", "data"])

    def judge(group: pa.Table) -> pa.Table:
        kept_totals, out = sent.value[0], []
        rows = list(zip(group.column("what").to_pylist(), group.column("number").to_pylist(), group.column("data"), strict=True))
        sums: dict[int, np.ndarray] = {}
        empty = np.zeros(0, np.int64)
        shares: list[list] = [[] for _ in range(PARTS)]
        for what, number, data in rows:
            if what == 2:
                words, n, context, docs, train = pickle.loads(data.as_buffer())
                for part, own in by_part(words, n, context, docs, buckets):
                    shares[part].append((number, *own, train))
        for part in range(PARTS):
            trimmed()
            main, frequent = Seats(empty.astype(np.uint64), *[empty] * 9, [(empty, empty, empty)] * len(kept_totals)), []
            for what, number, data in rows:
                if what == 1 and number == part:
                    main = thawed(data.as_buffer())
                elif what == 3 and number == part:
                    frequent.append(thawed(data.as_buffer()))
            if shares[part]:
                for number, some in bucket_scores(shares[part], [main, *frequent], kept_totals, CONTEXTS):
                    top, held = some.shape[1], sums.get(number)
                    if held is None or held.shape[1] < top:
                        more = np.zeros((3, top))
                        if held is not None:
                            more[:, : held.shape[1]] = held
                        held = sums[number] = more
                    held[:, :top] += some
            shares[part] = []
        for what, number, data in rows:
            if what == 0:
                out.append((number, data.as_py()))
        for number, held in sums.items():
            docs = np.flatnonzero(held[1])  # every token's base score is below 0
            out.append((number, pickle.dumps((docs.astype(np.uint32), held[0, docs].astype(np.uint32), held[1:, docs]), 5)))
        return pa.table({"number": pa.array([o[0] for o in out], pa.int64()), "data": pa.array([o[1] for o in out], pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        got = [pickle.loads(x) for x in group.column("data").to_pylist()]
        keys, held, size = next(g for g in got if isinstance(g[0], list))
        n = len(keys)
        known, sums = np.zeros(n, np.int64), np.zeros((2, n))
        for g in got:
            if not isinstance(g[0], list):
                known[g[0]] += g[1]
                sums[:, g[0]] += g[2]
        return pa.table({"k": pa.array(keys, of_key), "held_out": held, "n_tokens": size, "n_known": known, "train_tokens": np.full(n, sent.value[0][0].tokens), "base_score": sums[0], "score": sums[1]})

    from pyspark.sql.pandas.types import to_arrow_type

    of_key = to_arrow_type(docs.schema["k"].dataType)
    rows = docs.mapInArrow(emit, "bucket int, what int, number bigint, data binary").unionByName(seats.mapInArrow(spread, "bucket int, what int, number bigint, data binary"))
    judged = rows.groupBy("bucket").applyInArrow(judge, "number bigint, data binary")
    return judged.groupBy("number").applyInArrow(finish, f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumnRenamed("k", key)
