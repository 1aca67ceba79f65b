"""Secret scans: all rules in one deterministic automaton, one step a byte.

Rule patterns are compiled to a nondeterministic automaton, made deterministic
by subset construction, minimised by partition refinement and laid out as one
array of transitions.  A text is read once, byte by byte; where a state says
that a rule's match first ends, a backward automaton of that rule finds the leftmost
start and a forward one the longest end.  Matches of one rule do not overlap;
a match that is too short is dropped, but what it covered stays covered.

Defined results: a null text counts as empty and has no spans; texts of any
length are read whole; repeated rows are scanned each for itself; an empty
table gives an empty one.  Only the id and the text are read (redact keeps all
other columns, whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, map_rows


@dataclass(frozen=True)
class Rule:
    """A pattern over bytes: literals, classes, groups, alternatives and repeats. Matches under `least` bytes (of what `part` gives, else of all) are dropped."""

    kind: str
    pattern: str
    least: int = 1
    any_case: bool = False
    part: Callable[[bytes], bytes] | None = None
    base: bool = False


def assigned(match: bytes) -> bytes:
    """What stands behind the first : or = of an assignment, without blanks and one quote."""
    value = re.split(rb"[:=]", match, maxsplit=1)[1].lstrip(b" ")
    return value[1:] if value[:1] in (b'"', b"'") else value


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, True, assigned, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]{8,}", 32, base=True),  # a run of under 32 is dropped as too short; 8 keep the automaton small
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]+", 27, True),
)


class Nfa:
    """Thompson's construction; sets of bytes are integers of 256 bits."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append([])
        return len(self.free) - 1

    def add(self, tree, any_case: bool) -> tuple[int, int]:
        first = last = self.state()
        for op, arg in tree:
            a, b = self.one(str(op), arg, any_case)
            self.free[last].append(a)
            last = b
        return first, last

    def one(self, op: str, arg, any_case: bool) -> tuple[int, int]:
        if op in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            a, b = self.state(), self.state()
            self.step[a].append((byte_set(op, arg, any_case), b))
            return a, b
        if op == "SUBPATTERN":
            return self.add(arg[3], any_case)
        if op == "BRANCH":
            a, b = self.state(), self.state()
            for tree in arg[1]:
                x, y = self.add(tree, any_case)
                self.free[a].append(x)
                self.free[y].append(b)
            return a, b
        if op == "MAX_REPEAT":
            least, most, tree = arg
            first = last = self.state()
            for _ in range(least):
                x, y = self.add(tree, any_case)
                self.free[last].append(x)
                last = y
            if most == re._parser.MAXREPEAT:
                x, y = self.add(tree, any_case)
                end = self.state()
                self.free[last] += [x, end]
                self.free[y] += [x, end]
                return first, end
            end = self.state()
            for _ in range(most - least):
                x, y = self.add(tree, any_case)
                self.free[last] += [x, end]
                last = y
            self.free[last].append(end)
            return first, end
        raise ValueError(f"not supported in a rule: {op}")


def byte_set(op: str, arg, any_case: bool) -> int:
    if op == "ANY":
        return ((1 << 256) - 1) & ~(1 << 10)
    if op == "IN":
        bits, negate = 0, False
        for o, x in arg:
            if str(o) == "NEGATE":
                negate = True
            elif str(o) == "LITERAL":
                bits |= 1 << x
            elif str(o) == "RANGE":
                bits |= sum(1 << c for c in range(x[0], x[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {o}")
    else:
        bits, negate = 1 << arg, op == "NOT_LITERAL"
    if any_case:
        for c in range(97, 123):
            if bits >> c & 1 or bits >> (c - 32) & 1:
                bits |= 1 << c | 1 << (c - 32)
    return ((1 << 256) - 1) & ~bits if negate else bits


@dataclass
class Dfa:
    """step[state * 256 + byte] is the next state times 256; states from `first_ending` on end a match of the rules in ends[state]."""

    step: list[int]
    first_ending: int
    ends: dict[int, tuple[int, ...]]
    dead: int


def determinise(free, step, starts: frozenset[int], ends: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction over classes of bytes, then refinement until no two states differ. anywhere: a match may begin at every byte."""
    sets = sorted({m for s in step for m, _ in s})
    classes: dict[tuple[bool, ...], int] = {}
    of_byte = np.array([classes.setdefault(tuple(bool(m >> b & 1) for m in sets), len(classes)) for b in range(256)])
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(len(classes))]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    begin = closed(starts)
    number, order, table = {begin: 0}, [begin], []
    for now in order:
        row = []
        for b in sample:
            to = {t for s in now for m, t in step[s] if m >> b & 1}
            nxt = closed(to | set(starts)) if anywhere else closed(to)
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        table.append(row)
    table = np.array(table)
    kinds = [tuple(sorted({ends[s] for s in states if s in ends})) for states in order]
    labels = {k: i for i, k in enumerate(sorted(set(kinds)))}
    block = np.array([labels[k] for k in kinds])
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = block.max() + 1
    one_of = np.zeros(n, int)
    one_of[block] = np.arange(len(block))
    ranked = sorted(range(n), key=lambda s: (bool(kinds[one_of[s]]), block[0] != s))
    place = np.zeros(n, int)
    place[ranked] = np.arange(n)
    small = np.zeros((n, len(classes)), int)
    small[place] = place[block[table[one_of]]]
    final = {int(place[s]): kinds[one_of[s]] for s in range(n) if kinds[one_of[s]]}
    dead = number.get(frozenset())
    if not place[block[0]] == 0:  # the start ends a match: no rule may match nothing
        raise ValueError("a rule matches the empty text")
    one = [256 * s for s in range(n)]  # one object a state, so that the array's targets stay in the cache
    return Dfa([one[s] for s in small[:, of_byte].ravel().tolist()], n - len(final), final, -1 if dead is None else int(place[block[dead]]))


def turned(free, step) -> tuple[list, list]:
    back_free, back_step = [[] for _ in free], [[] for _ in step]
    for s, to in enumerate(free):
        for t in to:
            back_free[t].append(s)
    for s, to in enumerate(step):
        for m, t in to:
            back_step[t].append((m, s))
    return back_free, back_step


def first_end(tree) -> list:
    """The pattern without more rounds of its last repeat than it needs: the common automaton reports where a match first ends, and how far it goes is found apart."""
    *head, (op, arg) = list(tree)
    return [*head, (op, (arg[0], arg[0], arg[2]))] if str(op) == "MAX_REPEAT" and arg[0] else [*head, (op, arg)]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        nfa, starts, ends = Nfa(), [], {}
        self.single: list[tuple[Dfa, Dfa]] = []
        for i, rule in enumerate(rules):
            tree = re._parser.parse(rule.pattern.encode())
            a, b = nfa.add(first_end(tree), rule.any_case)
            starts.append(a)
            ends[b] = i
            own = Nfa()
            x, y = own.add(tree, rule.any_case)
            self.single.append((determinise(own.free, own.step, frozenset([x]), {y: 0}, False), determinise(*turned(own.free, own.step), frozenset([y]), {x: 0}, False)))
        self.all = determinise(nfa.free, nfa.step, frozenset(starts), ends, True)

    @staticmethod
    def reach(dfa: Dfa, data, at: int, to: int, by: int) -> int:
        """The last place on the way from at to to behind which a match ends; at if there is none."""
        s, found, step, ending, dead = 0, at, dfa.step, dfa.first_ending * 256, dfa.dead * 256
        for i in range(at, to, by):
            s = step[s + data[i]]
            if s >= ending:
                found = i + by
            elif s == dead:
                break
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule; kept matches only."""
        out: list[tuple[int, int, int]] = []
        step, ending, ends, s = self.all.step, self.all.first_ending * 256, self.all.ends, 0
        over = [0] * len(self.rules)
        for i, b in enumerate(data):
            s = step[s + b]
            if s >= ending:
                for r in ends[s >> 8]:
                    if i < over[r]:
                        continue
                    forward, backward = self.single[r]
                    start = self.reach(backward, data, i, over[r] - 1, -1) + 1
                    if start > i:
                        continue
                    end = self.reach(forward, data, start, len(data), 1)
                    over[r] = end
                    rule, match = self.rules[r], data[start:end]
                    if len(rule.part(match) if rule.part else match) >= rule.least:
                        out.append((start, end, r))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """As scan, in code points."""
        found = self.scan(data)
        if not found or data.isascii():
            return found
        at = {0: 0}
        last = 0
        for p in sorted({p for a, b, _ in found for p in (a, b)}):
            at[p] = at[last] + len(data[last:p].decode("utf-8", "replace"))
            last = p
        return [(at[a], at[b], r) for a, b, r in found]


SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The key with spans: kind, start, end (code points, end exclusive), by start, then kind in the order of the rules."""
    kind = dict(df.dtypes)[key]
    sent = Sent(df.sparkSession, Scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        names = [r.kind for r in rules]
        of_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [scanner.spans((x or "").encode()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"kind": names[r], "start": s, "end": e} for s, e, r in f] for f in found], of_span)], ["k", "spans"])

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, spans {SPAN}").withColumnRenamed("k", key)


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """df with every span of its text replaced by the mark, overlapping spans by one; null stays null."""
    sent = Sent(df.sparkSession, Scanner(rules))

    def clean(x: str | None) -> str | None:
        data = (x or "").encode()
        found = sent.value.scan(data)
        if not found:
            return x
        out, last = [], 0
        for start, end, _ in found:
            if start >= last:
                out += [data[last:start], mark.encode()]
            last = max(last, end)
        return b"".join([*out, data[last:]]).decode()

    def run(at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns
            columns[at] = pa.array([clean(x) for x in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_rows(df, run, text)


def digest(found: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of what scan gave."""
    base = [r.kind for r in rules if r.base]
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(key, *(count(k).alias(f"n_{k}") for k in base), F.sha2(line(own).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
