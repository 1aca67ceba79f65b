"""N-gram Jaccard join: T-occurrence search over inverted lists of shingles.

Two sets link when `at_least` per cent of their union lies in their
intersection.  Such sets differ in few shingles, so if the shingles are dealt
by hash to one part more than that number, some part is the same in both.

1. Each task hashes its texts to shingle sets, keeps one of each set, and gives
   every part of a set a key.  Inside the task equal keys join sets to rough
   groups; only one row a key leaves the task, in arrays by range of keys.
2. Equal keys of different tasks join further; connected components (DataFrame
   operations) give the rough groups.  A pair that links is always in one.
3. Each rough group is searched exactly.  Sets go by size; a set's inverted
   lists are sliced to the sizes that may link, the short ones are merged and
   the long ones probed by binary search (DivideSkip) for sets that reach the
   required overlap.  Sets already known to be connected are not searched
   again.  A group over `block` sets or over `members` shingles in them is dealt
   out by pairs of blocks, so no task holds more than two blocks (a set larger
   than a block stands in one with few others).
4. The links' components are the classes.

Defined results: a null or empty text, or one without a word, has the empty set
and links with nothing; fewer words than the shingle's width make one shingle
of the whole sequence; exact copies have equal sets and link; rows with equal
ids are one document for the components; a null id links with nothing and has
a null component; an empty table gives an empty one.  Texts of any length are
read whole; only the id and the text are read, other columns may have any
names and stay as they are where rows are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, drop_written, mix, partitions, quoted, shingle_sets, slices, utf8, written
from .graph import components

#: Keys that a task gathers before it passes them on.
GATHER = 3_000_000


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the least node of each one's component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Levels:
    """Ranges of set sizes such that sets that link lie in one range or in neighbouring ones."""

    def __init__(self, at_least: int) -> None:
        self.p = at_least
        self.low = [1]

    def cover(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.p + 1)

    def parts(self, level: np.ndarray) -> np.ndarray:
        """One more than the shingles in which a set whose smaller partner is of this level may differ."""
        top = np.array(self.low)[level + 1] - 1
        return top * (100 - self.p) // self.p + 1


def part_keys(offsets: np.ndarray, hashes: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of every part of every set that is not empty, for its own level and the one below."""
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    levels.cover(int(size.max()))
    own = np.searchsorted(levels.low, size[some], "right") - 1
    spread = mix(hashes)
    keys, of = [], []
    for below in (0, 1):
        pick = own >= below
        sets, level = some[pick], own[pick] - below
        if not len(sets):
            continue
        parts = levels.parts(level)
        first = np.cumsum(parts) - parts
        counts = size[sets]
        at = np.repeat(offsets[sets] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        slot = np.repeat(first, counts) + ((hashes[at] >> np.uint64(24)) % np.repeat(parts, counts).astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        total = np.zeros(parts.sum(), np.uint64)
        total[slot[begin]] = np.add.reduceat(spread[at[order]], begin)
        index = np.arange(len(total)) - np.repeat(first, parts)
        name = np.repeat(level, parts).astype(np.uint64) * np.uint64(1 << 32) + index.astype(np.uint64)
        keys.append(mix(total ^ mix(name + np.uint64(0x51ED270B9F1C3B57))))
        of.append(np.repeat(sets, parts))
    return np.concatenate(keys), np.concatenate(of)


ROWS = ["kind", "a", "b", "data"]


def rows_of(kind: int, a, b, data=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(data if data is not None else [None] * n, pa.binary())], ROWS)


def equal_keys(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between neighbours of equal key; keys sorted."""
    same = np.flatnonzero(keys[1:] == keys[:-1])
    return nodes[same], nodes[same + 1]


def gather(docs: DataFrame, width: int, at_least: int, buckets: int) -> DataFrame:
    """docs (k, t) as rows: kind 0 a document k and its set's size, 1 copies of one set, 2 a rough join, 3 keys of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = WordHasher(), Levels(at_least)
        first: dict[tuple[int, int, int], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, first
            if count:
                keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                nodes, at = np.unique(ids, return_inverse=True)
                order = np.argsort(keys, kind="stable")
                keys, at = keys[order], at[order]
                root = joined(*equal_keys(keys, at), len(nodes))
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                yield rows_of(2, nodes[moved], nodes[root[moved]])
                once = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
                keys, ids = keys[once], nodes[root[at[once]]]
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((ids, bucket))
                keys, ids, bucket = keys[order], ids[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cuts[1:], len(bucket))
                data = [keys[a:z].tobytes() + np.diff(ids[a:z], prepend=0).tobytes() for a, z in zip(cuts, ends, strict=True)]
                yield rows_of(3, bucket[cuts], ends - cuts, data)
            held, count, first = [], 0, {}

        for b in batches:
            key = b.column(0)
            ids = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = key.is_null().to_numpy(zero_copy_only=False)
            offsets, data = utf8(b.column(1))
            for i, j in slices(offsets):
                row, words = hasher(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                at, hashes = shingle_sets(row, words, j - i, width)
                size = np.diff(at)
                own, bad = ids[i:j], null[i:j]
                yield rows_of(0, pa.array(own, mask=bad), size)
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(mix(hashes), out=sums[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=sums[1, 1:])
                sums = sums[:, at[1:]] - sums[:, at[:-1]]
                copies, fresh = [], np.zeros(j - i, bool)
                for k in np.flatnonzero((size > 0) & ~bad):
                    name = (int(size[k]), int(sums[0, k]), int(sums[1, k]))
                    rep = first.setdefault(name, int(own[k]))
                    if rep == own[k]:
                        fresh[k] = True
                    else:
                        copies.append((int(own[k]), rep))
                if copies:
                    yield rows_of(1, *map(list, zip(*copies, strict=True)))
                keep = np.repeat(fresh, size)
                keys, of = part_keys(np.concatenate(([0], np.cumsum(size * fresh))), hashes[keep], levels)
                held.append((keys, own[of]))
                count += len(keys)
                if count >= GATHER:
                    yield from passed_on()
        yield from passed_on()

    return docs.mapInArrow(run, "kind tinyint, a bigint, b bigint, data binary")


def rough_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 3 of some buckets to edges between documents with equal keys: no more than documents."""
    keys, ids = [], []
    for b in batches:
        for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys.append(np.frombuffer(data, np.uint64, n))
            ids.append(np.cumsum(np.frombuffer(data, np.int64, n, 8 * n)))
    if keys:
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        a, b = equal_keys(keys[order], ids[order])
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = joined(at[: len(a)], at[len(a) :], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])


class Search:
    """T-occurrence search in a group of sets, which are ordered by size."""

    BITS = 1024

    def __init__(self, sets: list[np.ndarray], at_least: int) -> None:
        self.sets, self.p = sets, at_least
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.size)
        self.words, token = np.unique(every, return_inverse=True)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.token = token
        # inverted lists, one after the other, each in order of sets
        self.n = len(sets)
        self.lists = np.sort(token * self.n + of)
        # parity sketches: two sets' sketches differ in no more bits than the sets in members
        bit = (every >> np.uint64(40)) % np.uint64(self.BITS)
        sketch = np.zeros((self.n, self.BITS // 64), np.uint64)
        np.bitwise_xor.at(sketch, (of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        self.sketch = sketch

    def required(self, n, m):
        """Least overlap of linked sets of sizes n and m: 100 i >= p (n + m - i)."""
        return -(-self.p * (n + m) // (100 + self.p))

    def hopeful(self, q: int, lo: int, hi: int) -> np.ndarray:
        """Sets lo..hi-1 that the sketches do not rule out for q."""
        apart = np.bitwise_count(self.sketch[lo:hi] ^ self.sketch[q]).sum(1, dtype=np.int64)
        both = self.size[q] + self.size[lo:hi]
        return lo + np.flatnonzero(apart <= both - 2 * self.required(self.size[q], self.size[lo:hi]))

    def linked(self, q: int, lo: int, hi: int, wanted: np.ndarray) -> np.ndarray:
        """Of the sets lo..hi-1 marked in wanted, those that link with q: DivideSkip."""
        tokens = self.token[self.start[q] : self.start[q + 1]]
        a = np.searchsorted(self.lists, tokens * self.n + lo)
        z = np.searchsorted(self.lists, tokens * self.n + hi)
        length = z - a
        need = int(self.required(self.size[q], self.size[lo]))
        order = np.argsort(length)
        longest = max(2, int(length.max()))
        long = min(need - 1, int(need / (0.5 * np.log2(longest) + 1)))
        short, probe = order[: len(order) - long], order[len(order) - long :]
        n = length[short]
        at = np.repeat(a[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met = np.bincount(self.lists[at] % self.n - lo, minlength=hi - lo)
        found = np.flatnonzero((met >= need - long) & wanted)
        overlap = met[found]
        for k in probe:  # binary search of the candidates in each long list
            if not len(found):
                break
            spot = np.searchsorted(self.lists[a[k] : z[k]], tokens[k] * self.n + lo + found) + a[k]
            overlap += self.lists[np.minimum(spot, len(self.lists) - 1)] == tokens[k] * self.n + lo + found
        return lo + found[overlap >= self.required(self.size[q], self.size[lo + found])]


def group_links(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between sets connect; with two sides, links between the sides only."""
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, sets, sides = ids[order], [sets[k] for k in order], sides[order]
    search = Search(sets, at_least)
    n, parent = len(sets), np.arange(len(sets))
    crossed = len(np.unique(sides)) > 1
    low = np.searchsorted(search.size, -(-at_least * search.size // 100))
    edges = []
    for q in range(1, n):
        lo = int(low[q])
        if lo >= q:
            continue
        near = search.hopeful(q, lo, q)
        near = near[parent[near] != parent[q]]
        if crossed:
            near = near[sides[near] != sides[q]]
        if not len(near):
            continue
        wanted = np.zeros(q - lo, bool)
        wanted[near - lo] = True
        for m in search.linked(q, lo, q, wanted):
            if parent[m] != parent[q]:
                parent[parent == parent[q]] = parent[m]
                edges.append((q, m))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.array(edges).T
    return ids[a], ids[b]


def search_groups(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, x, y, side, k, data) in order of group, x, y to edges."""
    now, rows = None, []

    def done():
        if len(rows) > 1:
            u, v = group_links(np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[0] for r in rows]), at_least)
            if len(u):
                return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        return None

    for b in batches:
        group, x, y, side, k, data = b.columns
        for row in zip(group.to_pylist(), x.to_pylist(), y.to_pylist(), side.to_pylist(), k.to_pylist(), data, strict=True):
            if row[:3] != now:
                if (out := done()) is not None:
                    yield out
                now, rows = row[:3], []
            rows.append((row[3], row[4], row[5].as_buffer()))
    if (out := done()) is not None:
        yield out


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, at_least: int = 90, block: int = 2048, members: int = 1 << 21) -> DataFrame:
    """The key with n_shingles and component_id, one row a row of df; the key is an integer."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    deal = partitions(spark)
    rows = written(gather(docs, width, at_least, 4 * deal), "shingles")
    keys = rows.filter("kind = 3").select("a", F.col("b").cast("int").alias("n"), "data").repartition(deal, "a").select("n", "data")
    rough = rows.filter("kind = 2").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(keys.mapInArrow(rough_edges, "u bigint, v bigint"))
    groups = components(rough, "rough")
    own = rows.filter("kind = 0").select("a", "b")
    sizes = groups.join(own.hint("merge"), groups["node"] == own["a"]).groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("b") / members)).cast("int").alias("blocks"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            offsets, data = utf8(b.column(3))
            for i, j in slices(offsets):
                row, words = hasher(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                at, hashes = shingle_sets(row, words, j - i, width)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([hashes[at[r] : at[r + 1]].tobytes() for r in range(j - i)], pa.binary())], ["group", "blocks", "k", "data"])

    # merged at every size: groups grow with the documents and are not to be sent to every task
    texts = docs.join(groups.hint("merge"), docs["k"] == groups["node"]).join(sizes, "root").select("root", "blocks", "k", "t")
    sets = texts.mapInArrow(to_sets, "group bigint, blocks int, k bigint, data binary")
    mine = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("group", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "k", "data")
    dealt = pairs.repartition(deal, "group", "x", "y").sortWithinPartitions("group", "x", "y")
    links = dealt.mapInArrow(lambda batches: search_groups(batches, at_least), "u bigint, v bigint")
    copies = rows.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(links.unionByName(copies), "classes")
    found = own.join(roots, own["a"] == roots["node"], "left")
    return found.select(F.col("a").alias(key), F.col("b").alias("n_shingles"), F.coalesce("root", "a").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, at_least: int = 90) -> DataFrame:
    """df without the documents of a class besides the one with the least key."""
    others = classes(df, key, text, width, at_least).filter(F.col(key) != F.col("component_id")).select(key)
    return df.join(others, key, "left_anti").select(*(F.col(quoted(c)) for c in df.columns))
