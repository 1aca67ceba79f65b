"""Merkle manifest: every row a leaf, a tree for each group, one tree over the groups' roots, and a proof for every row.

A tree joins every FAN consecutive nodes (the last run may be shorter, even one)
to the digest of their hex texts, level by level, until one is left.  Leaves
stand in order of their key within their group; groups in order of their name.

1. Rows go by ranges of (group, key, leaf) and are sorted there; a row's place
   in its group is its place in its range and the sums of the ranges before, so
   a group of any size is spread over tasks.
2. Aligned blocks of FAN ** HEIGHT leaves are folded to their roots, blocks of
   those roots to theirs, and so on until a group has one node: tiers of tables,
   each as large as the one below over FAN ** HEIGHT.
3. The groups' roots go through the same tiers and give the root of all.
4. Tiers are walked from above: a block meets the proof of its own root (one
   row, in front of its nodes), walks its nodes by fractal traversal and appends
   that upper proof to each node's path.  In every stratum of a block's levels
   the traversal keeps one existing subtree and grows the desired next one by a
   leaf a step, so the inner nodes it holds do not grow with the block.

Defined results: nulls in any column are part of the leaf (`-`); a null key
comes first, a null group is a group of its own and the first one; rows of equal
keys go by their leaves; equal rows are leaves of their own with equal digests;
empty texts have a length of 0 and texts of any length are read whole; an empty
table gives an empty one; columns that are not named are not read and any names
of the others may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, partitions, written

#: Nodes of a run, and levels of an aligned block.
FAN, HEIGHT = 3, 6
#: Rows that a task gathers before it passes them on.
GATHER = 1000
PATH = "array<struct<before:string,after:string>>"


def leaf_of(*columns: Column) -> Column:
    """Digest of values: each is `-` if null, else the count of its UTF-8 bytes, a colon and itself."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in text)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path (before, after) lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels over the nodes of a block, of a group with n nodes."""
    h = 0
    while h < HEIGHT and FAN**h < n:
        h += 1
    return h


class Subtree:
    """A subtree that grows leaf by leaf; of its nodes it keeps those of the levels low to high - 1, and the root."""

    def __init__(self, low: int, high: int, start: int, leaves: list[str]) -> None:
        self.low, self.high, self.start, self.leaves = low, high, start, leaves
        self.end, self.next = min(start + FAN**high, len(leaves)), start
        self.kept: list[list[str]] = [[] for _ in range(low, high)]
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.root = ""

    def add(self, level: int, node: str) -> None:
        if level == self.high:
            self.root = node
            return
        if level >= self.low:
            self.kept[level - self.low].append(node)
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        if run:
            self.add(level + 1, digest(run))

    def grow(self, leaves: int) -> Subtree:
        for k in range(self.next, min(self.next + leaves, self.end)):
            self.add(0, self.leaves[k])
            self.next = k + 1
            if self.next == self.end:
                for level in range(self.high):
                    self.close(level)
        return self


class Traversal:
    """The paths of a block's leaves one after the other, from strata of `width` levels."""

    def __init__(self, leaves: list[str], height: int, width: int = 2) -> None:
        self.leaves = leaves
        self.strata = [(low, min(low + width, height)) for low in range(0, height, width)]
        self.existing = [Subtree(low, high, 0, leaves).grow(len(leaves)) for low, high in self.strata]
        self.desired = [Subtree(low, high, FAN**high, leaves) for low, high in self.strata]

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        for j in range(len(self.leaves)):
            path = []
            for tree in self.existing:
                for level, nodes in enumerate(tree.kept, tree.low):
                    i = (j - tree.start) // FAN**level
                    run = i - i % FAN
                    path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])))
            yield path
            for k, (low, high) in enumerate(self.strata):
                self.desired[k].grow(1)
                if (j + 1) % FAN**high == 0:
                    self.existing[k] = self.desired[k]
                    self.desired[k] = Subtree(low, high, j + 1 + FAN**high, self.leaves)


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows (g, ...) as a written table with at, their place in their group by `order`, and n, the rows of the group."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), "g", *order).sortWithinPartitions("g", *order)
    ranged = written(ordered.withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33)), "leaves")
    runs = ranged.groupBy("g", "range").agg(F.min("row").alias("first"), F.count("*").alias("many"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("many").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(runs.select("g", "range", (before - F.col("first")).alias("shift"), F.sum("many").over(group).alias("n")), ["g", "range"])
    out = written(placed.withColumn("at", F.col("row") + F.col("shift")).drop("row", "range", "shift"), "nodes")
    drop_written(ranged)
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """((g, block), its rows in order) of rows sorted by g and block."""
    now, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            own = (row["g"], row["block"])
            if own != now:
                if rows:
                    yield now, rows
                now, rows = own, []
            rows.append(row)
    if rows:
        yield now, rows


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, n, h) in order to the roots of their blocks."""
    out = []
    for (g, block), rows in blocks(batches):
        n = rows[0]["n"]
        height = height_of(n)
        leaves = [r["h"] for r in rows]
        out.append((g, block, -(-n // FAN**HEIGHT), Subtree(height, height, 0, leaves).grow(len(leaves)).root))
        if len(out) >= GATHER:
            yield pa.RecordBatch.from_pydict(dict(zip(("g", "at", "n", "h"), map(list, zip(*out, strict=True)), strict=True)))
            out = []
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("g", "at", "n", "h"), map(list, zip(*out, strict=True)), strict=True)))


def in_blocks(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes dealt out by aligned block and in order there."""
    return nodes.repartition(partitions(nodes.sparkSession), "g", "block").sortWithinPartitions("g", "block", *order)


def tiers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """([nodes, roots of their blocks, roots of those blocks, ...], (g, h): the groups' roots)."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        own = out[-1].select("g", F.expr(f"at div {FAN**HEIGHT}").alias("block"), "at", "n", "h")
        up = written(in_blocks(own, "at").drop("at").mapInArrow(folded, "g string, at bigint, n bigint, h string"), "roots")
        if most <= FAN**HEIGHT:
            return out, up.select("g", "h")
        out.append(up)
        most = -(-most // FAN**HEIGHT)


def walked(nodes: DataFrame, upper: DataFrame, keep: list[str]) -> DataFrame:
    """nodes with path, and with what upper (g, block, path, subroot, root) says of their block's root."""
    kinds = dict(nodes.dtypes)
    own = nodes.select("g", F.expr(f"at div {FAN**HEIGHT}").alias("block"), F.lit(1).alias("kind"), "at", "n", "h", *keep, F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    heads = upper.select("g", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit("").alias("h"), *(F.lit(None).cast(kinds[c]).alias(c) for c in keep), "path", "subroot", "root")
    names = ["g", "at", "h", *keep, "path", "subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types.update((f.name, f.type) for f in b.schema)
                yield b

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)

        out = []
        for _, (head, *rows) in blocks(noted()):
            above = head["path"]
            leaves = [r["h"] for r in rows]
            for r, path in zip(rows, Traversal(leaves, height_of(rows[0]["n"])).paths(), strict=True):
                steps = [{"before": a, "after": z} for a, z in path] + above
                out.append((r["g"], r["at"], r["h"], *(r[c] for c in keep), steps, head["subroot"], head["root"]))
                if len(out) >= GATHER:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    schema = ", ".join(["g string, at bigint, h string", *(f"{c} {kinds[c]}" for c in keep), f"path {PATH}, subroot string, root string"])
    return in_blocks(own.unionByName(heads), "kind", "at").mapInArrow(run, schema)


def descended(levels: list[DataFrame], upper: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes of the lowest tier with their paths; upper: (g, block, path, subroot, root) of the highest tier's blocks."""
    for nodes in reversed(levels[1:]):
        upper = walked(nodes, upper, []).select("g", F.col("at").alias("block"), "path", "subroot", "root")
    return walked(levels[0], upper, keep)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, leaf, path, subroot, root, *keep), one row a row.

    path goes from the leaf to the root of all; each of its steps has the digests
    that stand before and after the node in its run (see fold and siblings).
    """
    extra = [f"x{i}" for i in range(len(keep))]
    # a group's name: the empty text where it is null, else behind a letter, which keeps their order
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit(""))
    placed = rows.select(name.alias("g"), F.col(f"`{key}`").alias("k"), F.col(f"`{leaf}`").alias("h"), *(F.col(f"`{c}`").alias(x) for c, x in zip(keep, extra, strict=True)))
    nodes = positions(placed, "k", "h")
    levels, subroots = tiers(nodes)
    groups = positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "name")
    over, top = tiers(groups)
    empty = F.array().cast(PATH)
    above = descended(over, top.select("g", F.lit(0).cast("long").alias("block"), empty.alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root")), ["name"])
    upper = written(above.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("h").alias("subroot"), "root"), "upper")
    found = descended(levels, upper, ["k", *extra])
    return found.select(F.col("k").alias(key), F.col("h").alias(leaf), "path", "subroot", "root", *(F.col(x).alias(c) for c, x in zip(keep, extra, strict=True)))
