"""Near-duplicate documents by HyperMinHash sketches, confirmed on full sets.

A document's set are its distinct shingles of `width` words; two documents link
when `at_least` per cent of their union lies in their intersection, and the
components of the links are the groups.

1. A task hashes its texts to sets and keeps one of each; a set's sketch has
   REGISTERS registers.  The hash deals a shingle to a register, which stands
   for the least rest of its hashes: the rest's leading zeros and MANTISSA bits
   behind its first one, 16 bits in all.
2. Equal sets of different tasks become one, by an aggregate over digests.
3. Bands of ROWS registers, 64 bits, are keys; a set's empty registers borrow
   from others by a fixed random order (so that the chance of equal registers is
   the similarity for small sets as well).  Sets of 0.8 agree in one register
   with 0.8, in no band at all with (1 - 0.8 ** 4) ** 32 = 5e-8.
4. Sets that meet in a band are compared by their sketches: the share of equal
   registers, less the collisions expected of registers of so few bits, must lie
   within DEVIATIONS standard deviations of `at_least`.  What passes is joined
   to rough groups by union-find in the band and by connected components over
   all bands; no pairs are emitted, only edges that connect.
5. Rough groups are searched on full sets.  A group over `block` sets is dealt
   out in blocks that all meet the group's hub (the set that most others were
   joined to); sets that link with the hub are connected and need no comparison
   among themselves, every other set travels to all blocks of its group, in
   turns of up to `block` of them.
6. The components of the confirmed links and of the equal sets are the result.

Bands of over `block` sets are dealt out by pairs of blocks as well; nothing is
capped or left out.

Defined results: a null or empty text, or one without a word, has the empty set
and links with nothing; fewer words than `width` make one shingle of the whole
sequence; exact copies have equal sets and link; rows with equal ids are one
document for the components; a null id links with nothing and has a null
component; an empty table gives an empty one.  Texts of any length are read
whole; only the id and the text are read, other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, drop_written, mix, partitions, shingle_sets, slices, utf8, written
from .graph import components
from .jaccard import group_links

#: Registers of a sketch, and of a band; bits behind the first one that a register keeps.
REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: A register without a shingle.
EMPTY = np.uint16(0xFFFF)
#: Standard deviations by which an estimate may miss.
DEVIATIONS = 6.0
#: Collisions of unequal registers, of sets of equal sizes, are this times registers / 2 ** MANTISSA (HyperMinHash, Yu and Weber, 2017; fixed value).
COLLISION = 0.169919487159739


def registers(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sketches, a row a set; the hashes of a set are sorted, so the first of a register is its least."""
    n = len(offsets) - 1
    out = np.full((n, REGISTERS), EMPTY, np.uint16)
    if not len(hashes):
        return out
    bits = np.uint64(REGISTERS.bit_length() - 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    slot = (hashes >> (np.uint64(64) - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(row * REGISTERS + slot, prepend=-1))
    rest = hashes[first] << bits
    top = rest.copy()
    for k in (1, 2, 4, 8, 16, 32):  # all bits behind the first one
        top |= top >> np.uint64(k)
    zeros = np.uint64(64) - np.bitwise_count(top).astype(np.uint64)
    behind = np.where(zeros < 63, rest << np.minimum(zeros + np.uint64(1), np.uint64(63)), np.uint64(0))
    out[row[first], slot[first]] = ((np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA)) | (behind >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    return out


def lenders() -> np.ndarray:
    """For each register, the registers that it borrows from while it is empty, in order; every register is among them."""
    rng = np.random.default_rng(20240612)
    some = rng.integers(0, REGISTERS, (2 * REGISTERS, REGISTERS))
    return np.concatenate([some, (np.arange(REGISTERS)[None, :] + np.arange(1, REGISTERS)[:, None]) % REGISTERS])


def filled(sketches: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers have borrowed; sets without a shingle stay empty."""
    out = sketches.copy()
    some = (sketches != EMPTY).any(1)
    row, slot = np.nonzero((out == EMPTY) & some[:, None])
    for step in order:
        if not len(row):
            break
        lent = sketches[row, step[slot]]
        out[row, slot] = lent
        left = lent == EMPTY
        row, slot = row[left], slot[left]
    return out


def hopeful(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, at_least: int) -> np.ndarray:
    """Whether one sketch's collision-corrected similarity to others, given the sizes of the sets, may be that of linked sets."""
    used = ((others != EMPTY) | (one != EMPTY)).sum(1)
    equal = ((others == one) & (others != EMPTY)).sum(1)
    ratio = sizes / size
    chance = COLLISION * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    p = at_least / 100
    similar = (equal - chance) / np.maximum(used, 1)
    within = similar >= p - DEVIATIONS * np.sqrt(p * (1 - p) / np.maximum(used, 1))
    return within & (100 * np.minimum(sizes, size) >= at_least * np.maximum(sizes, size))


def gather(docs: DataFrame, width: int) -> DataFrame:
    """docs (k, t) as rows: kind 0 a document a and its set's size b, 1 copies a, b of one set, 2 a set of size b of document a with its digest, bands and sketch."""
    schema = "kind tinyint, a bigint, b bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def rows_of(kind: int, *columns) -> pa.RecordBatch:
        n = len(columns[0])
        every = [np.full(n, kind, np.int8), *columns, *([None] * n for _ in range(6 - len(columns)))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(every, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = WordHasher(), lenders()
        first: dict[tuple[int, int, int], int] = {}
        for b in batches:
            key = b.column(0)
            ids = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = key.is_null().to_numpy(zero_copy_only=False)
            offsets, data = utf8(b.column(1))
            for i, j in slices(offsets):
                row, words = hasher(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                at, hashes = shingle_sets(row, words, j - i, width)
                size, own = np.diff(at), ids[i:j]
                yield rows_of(0, pa.array(own, mask=null[i:j]), size)
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(mix(hashes), out=sums[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=sums[1, 1:])
                sums = sums[:, at[1:]] - sums[:, at[:-1]]
                if len(first) > 1_000_000:  # others are found by digest
                    first = {}
                copies, fresh = [], []
                for k in np.flatnonzero((size > 0) & ~null[i:j]):
                    seen = first.setdefault((int(size[k]), int(sums[0, k]), int(sums[1, k])), int(own[k]))
                    if seen == own[k]:
                        fresh.append(k)
                    else:
                        copies.append((int(own[k]), seen))
                if copies:
                    yield rows_of(1, *map(list, zip(*copies, strict=True)))
                if fresh:
                    sketch = registers(at, hashes)[fresh]
                    keys = filled(sketch, order).reshape(len(fresh) * BANDS, ROWS).view(np.int64).ravel()
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
                    yield rows_of(2, own[fresh], size[fresh], sums[0, fresh].view(np.int64), sums[1, fresh].view(np.int64), bands, [s.tobytes() for s in sketch])

    return docs.mapInArrow(run, schema)


def in_groups(batches: Iterator[pa.RecordBatch], keys: int, solve: Callable) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by their first `keys` columns to the edges (u, v) that solve finds in each group's rows."""
    now, rows, out = None, [], []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != now:
                if len(rows) > 1:
                    out += solve(rows)
                now, rows = row[:keys], []
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])
                    out = []
            rows.append(row[keys:])
    if len(rows) > 1:
        out += solve(rows)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])


def joined(rows: list[tuple], at_least: int) -> list[tuple[int, int]]:
    """Rows (side, k, size, sketch) of a band, or of two of its blocks, to edges that connect what may link."""
    rows.sort(key=lambda r: (r[2], r[1]))
    side, ids, sizes, sketches = zip(*rows, strict=True)
    side, sizes = np.array(side), np.array(sizes)
    every = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(rows), REGISTERS)
    two, root, out = len(set(side.tolist())) > 1, np.arange(len(rows)), []
    # sets of the sizes that may link with one: those before it in order of size, from low
    low = np.searchsorted(sizes, -(-at_least * sizes // 100))
    for q in range(1, len(rows)):
        near = low[q] + np.flatnonzero(root[low[q] : q] != root[q])
        if two:
            near = near[side[near] != side[q]]
        if not len(near):
            continue
        for m in near[hopeful(every[q], sizes[q], every[near], sizes[near], at_least)]:
            if root[m] != root[q]:
                root[root == root[q]] = root[m]
                out.append((ids[q], ids[m]))
    return out


def dealt(rows: DataFrame, deal: int, *key: str) -> DataFrame:
    """rows (*key, block, blocks, ...) for every pair (x, y) of blocks of their key."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    every = rows.select("*", other).select("*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return every.repartition(deal, *key, "x", "y").sortWithinPartitions(*key, "x", "y")


def rough(sets: DataFrame, at_least: int, block: int, deal: int) -> DataFrame:
    """(u, v): edges that connect all sets (k, size, bands, sketch) that may link."""
    keys = sets.select("k", F.posexplode("bands").alias("band", "key"))
    often = keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = keys.join(often, ["band", "key"]).join(sets.select("k", "size", "sketch"), "k")
    own = met.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    rows = dealt(own, deal, "band", "key").select("band", "key", "x", "y", F.col("block").alias("side"), "k", "size", "sketch")
    return rows.mapInArrow(lambda batches: in_groups(batches, 4, lambda group: joined(group, at_least)), "u bigint, v bigint").distinct()


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """rows (root, block, blocks, k, t) with the sorted shingles of t as data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            offsets, data = utf8(b.column(4))
            for i, j in slices(offsets):
                row, words = hasher(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                at, hashes = shingle_sets(row, words, j - i, width)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:4], pa.array([hashes[at[r] : at[r + 1]].tobytes() for r in range(j - i)], pa.binary())], ["root", "block", "blocks", "k", "data"])

    return rows.mapInArrow(run, "root bigint, block int, blocks int, k bigint, data binary")


def links(rows: list[tuple], at_least: int) -> list[tuple[int, int]]:
    """Rows (side, k, data) of a group to edges that connect what links; with two sides, links between them only."""
    side, ids, data = zip(*rows, strict=True)
    u, v = group_links(np.array(ids), [np.frombuffer(d, np.uint64) for d in data], np.array(side), at_least)
    return list(zip(u.tolist(), v.tolist(), strict=True))


def confirmed(docs: DataFrame, groups: DataFrame, edges: DataFrame, width: int, at_least: int, block: int, deal: int) -> DataFrame:
    """(u, v): edges that connect what links on full sets in the rough groups (node, root); edges: those that made the groups."""
    large = written(groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    small = large.isEmpty()
    if small:
        placed = groups.select("node", "root", F.lit(0).alias("block"), F.lit(1).alias("blocks"))
    else:
        # a large group has over `block` rows, so this table is a small part of the groups; Spark broadcasts it if its size allows
        placed = groups.join(large, "root", "left").select("node", "root", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.join(placed.hint("merge"), docs["k"] == placed["node"]).select("root", "block", "blocks", "k", "t")
    sets = sets_of(texts, width)
    inside = lambda rows: rows.mapInArrow(lambda batches: in_groups(batches, 2, lambda group: links(group, at_least)), "u bigint, v bigint")
    order = lambda rows: rows.repartition(deal, "root", "block").sortWithinPartitions("root", "block").select("root", "block", F.lit(0).alias("side"), "k", "data")
    if small:
        return inside(order(sets))
    sets = written(sets, "sets")
    found = inside(order(sets.filter("blocks = 1")))
    # the hub: the set that most edges of its group have
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    hubs = ends.join(groups, "node").join(large, "root").groupBy("root", "blocks").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("k"))
    many = sets.filter("blocks > 1")
    hub = many.join(hubs.select("root", "k"), ["root", "k"]).dropDuplicates(["root", "k"]).select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.lit(True).alias("hub"), "k", "data")
    led = hub.unionByName(many.withColumn("hub", F.lit(False))).repartition(deal, "root", "block").sortWithinPartitions("root", "block", F.desc("hub"))
    judged = written(led.select("root", "block", "blocks", "hub", "k", "data").mapInArrow(lambda batches: beside(batches, at_least), "root bigint, block int, blocks int, u bigint, v bigint, data binary"), "judged")
    found = found.unionByName(judged.filter("v is not null").select("u", "v"))
    # sets that do not link with their hub meet all of their group, in turns of up to a block of them
    others = judged.filter("v is null").select("root", "blocks", F.col("u").alias("k"), "data")
    if others.isEmpty():
        return found
    turns = others.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
    visits = others.join(turns, "root").withColumn("turn", F.pmod(F.xxhash64("k"), F.col("turns")).cast("int"))
    visits = visits.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "turn", F.lit(1).alias("side"), "k", "data")
    homes = many.join(turns, "root").select("root", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("side"), "k", "data")
    met = visits.unionByName(homes).repartition(deal, "root", "block", "turn").sortWithinPartitions("root", "block", "turn")
    return found.unionByName(met.mapInArrow(lambda batches: in_groups(batches, 3, lambda group: links(group, at_least)), "u bigint, v bigint"))


def beside(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, block, blocks, hub, k, data), the hub first, to (root, block, blocks, k, hub's k or null, data): null and the data where a set does not link with the hub."""
    hub, name = np.zeros(0, np.uint64), None
    for b in batches:
        out = []
        for root, block, blocks, first, k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = np.frombuffer(data, np.uint64)
            if first:
                hub, name = own, k
                continue
            both = len(np.intersect1d(hub, own, assume_unique=True))
            near = 100 * both >= at_least * (len(hub) + len(own) - both)
            out.append((root, block, blocks, k, name if near else None, None if near else data))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["root", "block", "blocks", "u", "v", "data"])


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, at_least: int = 80, block: int = 2048) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row a row of df; the key is an integer."""
    deal = partitions(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    rows = written(gather(docs, width), "sketches")
    every = rows.filter("kind = 2")
    one = every.groupBy("b", "d1", "d2").agg(F.min("a").alias("least"))
    sets = every.join(one, ["b", "d1", "d2"]).select("a", "b", "least", "bands", "sketch")
    sets = written(sets, "sets")
    only = sets.filter("a = least").select(F.col("a").alias("k"), F.col("b").alias("size"), "bands", "sketch")
    edges = written(rough(only, at_least, block, deal), "rough")
    groups = components(edges, "rough")
    found = confirmed(docs, groups, edges, width, at_least, block, deal)
    copies = rows.filter("kind = 1").select("a", "b").unionByName(sets.filter("a <> least").select("a", F.col("least").alias("b")))
    roots = components(found.unionByName(copies.select(F.col("a").alias("u"), F.col("b").alias("v"))), "classes")
    own = rows.filter("kind = 0").select("a", F.col("b").alias("n"))
    drop_written(edges)
    component = F.coalesce("root", "a")
    return own.join(roots, own["a"] == roots["node"], "left").select(F.col("a").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("a") == component, F.lit(True)).alias("kept"))
