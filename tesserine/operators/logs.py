"""Parsing of benchmark logs and groupings of the parsed rows.

`parsed` reads records of one header and one value by built-in expressions.
`graph` and `linear` take any list of patterns: a small machine reads lines in
order, with the record in hand as its only state.

A file of up to `segment` lines is read by one run of the machine. A longer one, of
any length, is read by many tasks: it is cut into segments of `segment`
places. A segment is run once for each state in which the machine may enter it,
where what the record in hand holds already is not known and stands as numbered
gaps; runs that come to the same state without gaps go on as one, which after a
record or two leaves a single run. A prefix step over the segments of a file
(a row for each state of a segment, not for each line) then tells the state and
the values with which each was entered; they choose its rows and fill their gaps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.session import stored

#: Lines of the job logs (fixed values).
HEADER = r"^srun -N=(\d+) --ntasks-per-node=(\d+) (\w+)$"
VALUE = r"^total time (\S+) s$"


#: Places of a file that a task reads together: lines, or bytes where lines are placed by offset.
SEGMENT = 100_000
#: The entry of a file that is read as one: the machine's first state.
FIRST = (0,)


def carried(lines: DataFrame, value: Column, segment: int = SEGMENT) -> DataFrame:
    """lines with `before`: the last value of the lines before it in its file that is not null.

    Windows end at segments; only the last value of each segment is looked at by file.
    """
    rows = lines.withColumns({"segment": F.expr(f"at div {segment}"), "value": value})
    inside = Window.partitionBy("file", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("file", "segment").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"))
    over = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    entry = ends.select(F.col("file").alias("f"), F.col("segment").alias("s"), F.last("value", True).over(over).alias("entry"))
    met = rows.withColumn("before", F.last("value", True).over(inside)).join(entry, F.col("file").eqNullSafe(F.col("f")) & (F.col("segment") == F.col("s")))
    return met.withColumn("before", F.coalesce("before", "entry")).drop("segment", "value", "f", "s", "entry")


def parsed(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """lines (file, at, line) to (file, at, node_num, tasks, task, value): each value line takes the values of the last header before it in its file.

    A header ends the record before it; a value line without a header, or a
    second one of a record, gives no row.
    """
    head = F.when(F.col("line").rlike(HEADER), F.struct(F.col("at").alias("head"), F.regexp_extract("line", HEADER, 1).cast("long").alias("node_num"), F.regexp_extract("line", HEADER, 2).cast("long").alias("tasks"), F.regexp_extract("line", HEADER, 3).alias("task")))
    rows = carried(lines, head, segment).withColumnRenamed("before", "h").filter(F.col("line").rlike(VALUE) & F.col("h").isNotNull())
    first = rows.groupBy("file", "h").agg(F.min_by(F.struct("at", "line"), "at").alias("v"))
    return first.select("file", F.col("v.at").alias("at"), "h.node_num", "h.tasks", "h.task", F.regexp_extract("v.line", VALUE, 1).alias("value"))


def faults(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Headers that came before the record in hand had its value: a header directly after a header of its file."""
    header = F.coalesce(F.col("line").rlike(HEADER), F.lit(False))
    return carried(lines, header, segment).filter(header & F.col("before")).agg(F.count("*").alias("faults"))


def grouped(rows: DataFrame, value: str, *by: str, **aggregates: Column) -> DataFrame:
    """Aggregates of a value by keys; missing, NaN and zero values are left out."""
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) != 0)
    return rows.filter(good).groupBy(*by).agg(*(c.alias(n) for n, c in aggregates.items()))


def overhead(*columns: str) -> Column:
    """Sum of the listed columns."""
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c)
    return out


@dataclass
class Node:
    """A kind of record: patterns that lines must match one after the other, and a label for each of their groups."""

    patterns: list[str]
    labels: list[str]
    children: list[Node] = field(default_factory=list)

    def every_label(self) -> list[str]:
        return list(dict.fromkeys([*self.labels, *(x for c in self.children for x in c.every_label())]))


class Graph:
    """Reads lines along a tree of nodes; a leaf gives a row with the values of its whole path.

    Behind a leaf, the next line that begins a node of the path goes on from
    there: a sibling's parent keeps its values.  A line that begins the root
    ends what is unfinished.  If it comes while a node waits for its next line,
    it is used up by that, and what follows up to the next such line gives no
    row; between nodes it begins the next record itself.
    """

    def __init__(self, root: Node) -> None:
        self.root = root
        self.ways: dict[int, list[Node]] = {}  # nodes from the root to each one
        self.states: list[tuple[int, int, bool]] = [(id(root), 0, False)]  # node, lines that matched, whether it waits for a node to follow
        self.known(root, [])
        self.reset()

    def known(self, node: Node, way: list[Node]) -> None:
        self.ways[id(node)] = way = [*way, node]
        self.states += [(id(node), k, False) for k in range(1, len(node.patterns))] + [(id(node), len(node.patterns), True)]
        for child in node.children:
            self.known(child, way)

    def kept(self, state: int) -> tuple[list[list[str]], int]:
        """(labels of the values at each node of the path, groups of the record in hand) that a state holds."""
        node, at, waits = self.states[state]
        way = self.ways[node] if waits else self.ways[node][:-1]
        labels = [list(dict.fromkeys(x for n in way[: k + 1] for x in n.labels)) for k in range(len(way))]
        return labels, 0 if waits else sum(re.compile(p).groups for p in self.ways[node][-1].patterns[:at])

    def width(self, state: int) -> int:
        """How many values a state holds."""
        labels, groups = self.kept(state)
        return sum(map(len, labels)) + groups

    def enter(self, state: int, data: list) -> None:
        """Goes to a state with its values."""
        node, at, waits = self.states[state]
        way, given = self.ways[node], iter(data)
        self.path = [(n, dict(zip(labels, given, strict=False))) for n, labels in zip(way, self.kept(state)[0], strict=False)]
        self.begin(way[-1], dict(self.path[-1][1]) if self.path else {})
        self.at, self.groups = at, list(given)
        if waits:
            self.wait()

    def left(self) -> tuple[int, list]:
        """The state and its values."""
        data = [v for _, values in self.path for v in values.values()]
        if self.waits is not None:
            return self.states.index((id(self.node), len(self.node.patterns), True)), data
        return self.states.index((id(self.node), self.at, False)), data + self.groups

    def wait(self) -> None:
        self.leaf = not self.node.children
        self.waits = [n for n, _ in self.path] if self.leaf else self.node.children

    def reset(self) -> None:
        self.path: list[tuple[Node, dict]] = []
        self.begin(self.root, {})

    def begin(self, node: Node, values: dict) -> None:
        self.node, self.at, self.groups, self.values, self.waits = node, 0, [], values, None

    def feed(self, line: str) -> Iterator[dict]:
        line = line.strip()
        if self.waits is not None:
            first = next((n for n in self.waits if re.match(n.patterns[0], line)), None)
            if not self.leaf and re.match(self.root.patterns[0], line):
                self.reset()
            elif first is None:
                return
            elif self.leaf:
                while self.path.pop()[0] is not first:
                    pass
                self.begin(first, dict(self.path[-1][1]) if self.path else {})
            else:
                self.begin(first, dict(self.values))
        met = re.match(self.node.patterns[self.at], line)
        if met:
            self.groups += met.groups()
            self.at += 1
            if self.at == len(self.node.patterns):
                self.values = self.values | dict(zip(self.node.labels, self.groups, strict=True))
                self.path.append((self.node, self.values))
                self.wait()
                if self.leaf:
                    yield self.values
        elif re.match(self.root.patterns[0], line):
            self.reset()


class Line:
    """Reads records of a list of patterns, one line each, in order; a first line before a record's last one begins anew and counts as a fault."""

    def __init__(self, patterns: list[str], labels: list[str]) -> None:
        self.patterns, self.labels, self.at, self.values = patterns, labels, 0, []
        self.states = list(range(len(patterns)))  # lines that matched

    def width(self, state: int) -> int:
        return sum(re.compile(p).groups for p in self.patterns[:state])

    def enter(self, state: int, data: list) -> None:
        self.at, self.values = state, list(data)

    def left(self) -> tuple[int, list]:
        return self.at, self.values

    def feed(self, line: str) -> Iterator[dict]:
        line = line.rstrip()
        met = re.match(self.patterns[self.at], line)
        if not met:
            met = re.match(self.patterns[0], line)
            if not met:
                return
            self.at, self.values = 0, []
            yield {"fault": "1"}
        self.values = self.values + list(met.groups())
        self.at += 1
        if self.at == len(self.patterns):
            yield dict(zip(self.labels, self.values, strict=True))
            self.at, self.values = 0, []


class Segment:
    """Runs of a machine over a segment's lines, one for each state in which it may be entered; an int in place of a text is a gap, the entry's value of that number."""

    def __init__(self, make: Callable) -> None:
        first = make()
        self.every = tuple(range(len(first.states)))
        self.runs = []
        for state in self.every:
            machine = make()
            machine.enter(state, list(range(machine.width(state))))
            self.runs.append(((state,), machine))

    def feed(self, line: str) -> Iterator[tuple[tuple[int, ...], dict]]:
        """(entries, row): what the line ends, and in which runs."""
        for entries, machine in self.runs:
            for got in machine.feed(line):
                yield entries, got
        if len(self.runs) > 1:
            met: dict[tuple, int] = {}
            runs: list = []
            for entries, machine in self.runs:
                state, data = machine.left()
                own = None if any(isinstance(v, int) for v in data) else (state, *data)
                if own in met and own is not None:
                    runs[met[own]] = (runs[met[own]][0] + entries, machine)
                else:
                    met[own] = len(runs)
                    runs.append((entries, machine))
            self.runs = runs

    def exits(self) -> Iterator[tuple[int, int, list]]:
        """(entry, state, values) at the end."""
        for entries, machine in self.runs:
            state, data = machine.left()
            for entry in entries:
                yield entry, state, data


def machined(lines: DataFrame, make: Callable, labels: list[str], segment: int = SEGMENT) -> DataFrame:
    """(file, at, labels as text) of what a machine of each file gives, at being the line that ends the row. lines: (file, at, line)."""
    kind = dict(lines.dtypes)["file"]
    names = ["file", "segment", "at", "entries", "state", "texts", "gaps"]

    def split(values: list) -> tuple[list, list]:
        return [None if isinstance(v, int) else v for v in values], [v if isinstance(v, int) else -1 for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, rows, file_type = None, None, [], pa.null()
        whole = make()

        def made() -> pa.RecordBatch:
            types = [file_type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def ended() -> None:
            if machine and now[1] is not None:
                rows.extend((*now, entry, None, state, *split(data)) for entry, state, data in machine.exits())

        for b in batches:
            file_type = b.column(0).type
            for file, seg, at, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, seg) != now:
                    ended()
                    now = file, seg
                    if seg is None:
                        whole.enter(0, [])
                        machine = whole
                    else:
                        machine = Segment(make)
                for entries, got in ((FIRST, x) for x in whole.feed(line or "")) if seg is None else machine.feed(line or ""):
                    rows.append((*now, at, entries, None, *split([got.get(x) for x in labels])))
            if len(rows) > 5000:
                yield made()
                rows = []
        ended()
        if rows:
            yield made()

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exits in order of file, segment and entry to the state and values with which each segment was entered."""
        now, state, data, after = None, 0, [], (0, [])
        for b in batches:
            rows = []
            for file, seg, entry, out, texts, gaps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != file:
                    after = 0, []
                if (file, seg) != now:
                    now, (state, data) = (file, seg), after
                    rows.append((file, seg, state, data))
                if entry == state:
                    after = out, [text if gap < 0 else data[gap] for text, gap in zip(texts, gaps, strict=True)]
            if rows:
                types = [b.column(0).type, pa.int64(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["f", "s", "entry", "data"])

    # at most a row for each `segment` lines, whatever the number of files
    long = F.broadcast(lines.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > segment).select(F.col("file").alias("long"), F.lit(True).alias("cut")))
    marked = lines.join(long, F.col("file").eqNullSafe(F.col("long")), "left")
    ordered = marked.select("file", F.when(F.col("cut"), F.expr(f"at div {segment}")).alias("segment"), F.col("at").cast("long").alias("at"), "line").repartition("file", "segment").sortWithinPartitions("file", "segment", "at")
    found = stored(ordered.mapInArrow(run, f"file {kind}, segment bigint, at bigint, entries array<int>, state int, texts array<string>, gaps array<int>"), "segments")
    exits = found.filter("state is not null").select("file", "segment", "at", "state", "texts", "gaps").repartition("file").sortWithinPartitions("file", "segment", "at")
    entry = exits.mapInArrow(prefix, f"f {kind}, s bigint, entry int, data array<string>")
    given = found.filter("state is null")
    rows = given.filter("segment is not null").join(entry, F.col("file").eqNullSafe(F.col("f")) & (F.col("segment") == F.col("s")))
    rows = rows.filter(F.array_contains("entries", F.col("entry")))
    value = lambda k: F.when(F.get("gaps", F.lit(k)) < 0, F.get("texts", F.lit(k))).otherwise(F.get("data", F.get("gaps", F.lit(k))))
    short = given.filter("segment is null").select("file", "at", *(F.get("texts", F.lit(k)).alias(x) for k, x in enumerate(labels)))
    return short.unionByName(rows.select("file", "at", *(value(k).alias(x) for k, x in enumerate(labels))))


def graph(lines: DataFrame, root: Node, segment: int = SEGMENT) -> DataFrame:
    """(file, at, a column for each label of the tree): the rows of a parser graph; labels off a leaf's path are null."""
    return machined(lines, lambda: Graph(root), root.every_label(), segment)


def linear(lines: DataFrame, patterns: list[str], labels: list[str], segment: int = SEGMENT) -> DataFrame:
    """(file, at, labels, fault): records of a list of patterns, and a row with fault 1 for each that broke off."""
    return machined(lines, lambda: Line(patterns, labels), [*labels, "fault"], segment)
