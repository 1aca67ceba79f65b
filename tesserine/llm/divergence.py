"""Source divergence audit: how far the sources of a language differ in their terms.

A term is a run of letters A-Z, a-z and of characters over U+007F; A-Z count as
lower case.  A language keeps the terms that at least `least` of its documents
have.  The share of a kept term in a group (language, source), or in the whole
language, is 1 + floor(1e9 (count + 5) / (N + 5 V)), N the group's count of kept
terms and V the language's number of them.

1. A task counts its documents' terms and passes runs on: (language, term,
   source, first document of the run, documents, occurrences).
2. Runs are dealt out by (language, term) and sorted by (language, term, source,
   document), behind a hash of the first two.  One scan adds up run lengths; what it holds of a term is the
   sources of less than `least` documents, then the term is kept and its sources
   pass through as they come, so a term of any number of sources needs no more.
3. Shares go to tiles of `tile` sources by `tile` and to parts of the terms,
   sorted by term.  One scan sets the shares of a run of one term against each
   other: terms in which a source exceeds its language, and sums of differences
   of each pair of sources, which come out once for a tile's part.

All arithmetic is exact: whole numbers of 64 bits, for up to 2e14 occurrences
in a group.

Defined results: null texts, languages and sources are empty ones; a text
without a term counts as a document without terms, and its group is there; a
language without kept terms has pairs of value 0 and no terms; equal values go
by the name's bytes; repeated rows are documents of their own; texts of any
length are read whole; an empty table gives an empty one; columns that are not
named are not read and may have any names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Bytes of a term in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Entries that a task counts before it passes them on.
GATHER = 400_000


def runs(batches: Iterator[pa.RecordBatch], gather: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Rows (doc, lang, source, text) to (lang, term, source, doc, docs, n)."""
    docs, n, first = defaultdict(Counter), defaultdict(Counter), {}
    names = ["lang", "term", "source", "doc", "docs", "n"]

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            own = docs[lang, source]
            terms = list(counts)
            for k in range(0, len(terms), 20_000):
                part = terms[k : k + 20_000]
                m = len(part)
                numbers = [pa.array(np.fromiter(map(c.__getitem__, part), np.int64, m)) for c in (own, counts)]
                words = [pa.repeat(pa.scalar(lang, pa.string()), m), pa.array(part, pa.binary()).cast(pa.string()), pa.repeat(pa.scalar(source, pa.string()), m)]
                yield pa.RecordBatch.from_arrays([*words, pa.repeat(pa.scalar(first[lang, source], pa.int64()), m), *numbers], names)
        docs.clear(), n.clear(), first.clear()

    for b in batches:
        for doc, lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            own = lang, source
            found = TERM.findall(text.as_buffer().to_pybytes().lower())  # bytes.lower() changes A-Z alone
            n[own].update(found)
            docs[own].update(set(found))
            first.setdefault(own, doc)
        if sum(map(len, n.values())) > gather:
            yield from passed_on()
    yield from passed_on()


class Scan:
    """Run lengths of sorted rows (lang, term, source, docs, n): the sources' sums of the terms kept, and each such term's sum over all sources with a null source.

    What stays between batches is of the last term: its sources' sums while it
    has less than `least` documents, its last source's sum from then on.
    """

    def __init__(self, least: int) -> None:
        self.least = least
        self.held: pa.RecordBatch | None = None
        self.docs = self.total = 0  # of the last term's rows that are no longer held

    def feed(self, b: pa.RecordBatch, last: bool = False) -> pa.RecordBatch:
        if self.held is not None:
            b = pa.concat_batches([self.held, b])
        n = b.num_rows
        words = [b.column(i) for i in range(3)]
        differ = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in words]
        term, source = np.ones(n, bool), np.ones(n, bool)
        term[1:] = differ[0] | differ[1]
        source[1:] = term[1:] | differ[2]
        terms, sources = np.flatnonzero(term), np.flatnonzero(source)
        docs, count = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        of = np.searchsorted(terms, sources, "right") - 1
        source_docs, source_count = np.add.reduceat(docs, sources), np.add.reduceat(count, sources)
        term_docs, term_count = np.add.reduceat(docs, terms), np.add.reduceat(count, terms)
        term_docs[0] += self.docs
        term_count[0] += self.total
        kept = term_docs >= self.least
        whole, passing = kept.copy(), kept[of]
        self.held, self.docs, self.total = None, 0, 0
        if not last:  # the last term may go on
            whole[-1] = False
            stays = np.flatnonzero(of == of[-1])[-1:] if kept[-1] else np.flatnonzero(of == of[-1])
            passing[stays] = False
            at = pa.array(sources[stays])
            self.held = pa.RecordBatch.from_arrays([*(c.take(at) for c in words), pa.array(source_docs[stays]), pa.array(source_count[stays])], b.schema.names)
            self.docs, self.total = int(term_docs[-1] - source_docs[stays].sum()), int(term_count[-1] - source_count[stays].sum())
        own, every = pa.array(sources[passing]), pa.array(terms[whole])
        columns = [pa.concat_arrays([words[i].take(own), words[i].take(every)]) for i in range(2)]
        columns.append(pa.concat_arrays([words[2].take(own), pa.nulls(len(every), words[2].type)]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([source_count[passing], term_count[whole]]))], ["lang", "term", "source", "n"])


def kept_terms(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, term, source, docs, n) to (lang, term, source, n), see Scan."""
    scan = Scan(least)
    for b in batches:
        if b.num_rows:
            yield scan.feed(b)
    if scan.held is not None:
        yield scan.feed(scan.held.slice(0, 0), last=True)


def share(n: Column, whole: Column) -> Column:
    """1 + floor(1e9 n / whole), by two divisions whose terms fit 64 bits."""
    a = n * 31_250
    div = lambda x: F.call_function("div", x, whole)
    return F.lit(1).cast("long") + div(a) * 32_000 + div((a % whole) * 32_000)


def compared(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, x, y, part, term, at, p) to (lang, a, b, term, value).

    at is a source's place in its language; -1 has a term's share in the whole
    language.  Rows without a term come first and have the share of a count of 0
    in every source of the tiles x and y.
    """
    names, kinds = ["lang", "a", "b", "term", "value"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    now, word, q = None, None, 0
    zeros: list[dict[int, int]] = [{}, {}]  # for both sides the share of a count of 0 of each source
    spots: list[dict[int, int]] = [{}, {}]  # and its row
    total, rows = np.zeros((0, 0), np.int64), []  # sums of differences; terms gathered, {source: share}
    out: list[tuple] = []

    def add() -> None:
        """Adds the differences of the terms gathered to the sums."""
        nonlocal rows, total
        if not rows:
            return
        sides = []
        for zero, spot in zip(zeros, spots, strict=True):
            shares = np.repeat(np.fromiter(zero.values(), np.int64, len(zero))[:, None], len(rows), 1)
            for k, own in enumerate(rows):
                for at in own.keys() & spot.keys():
                    shares[spot[at], k] = own[at]
            sides.append(shares)
        if not total.size:
            total = np.zeros((len(zeros[0]), len(zeros[1])), np.int64)
        for i, p in enumerate(sides[0]):
            total[i] += np.abs(sides[1] - p).sum(1)
        rows = []

    def done() -> None:
        add()
        for i, a in enumerate(zeros[0]):
            out.extend((now[0], a, b, None, int(total[i, j]) if total.size else 0) for j, b in enumerate(zeros[1]) if a < b)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        for lang, x, y, part, term, at, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (lang, x, y, part):
                done()
                now, word, rows, zeros, spots, total = (lang, x, y, part), None, [], [{}, {}], [{}, {}], np.zeros((0, 0), np.int64)
            if term is None:
                for side, t in enumerate((x, y)):
                    if at // tile == t:
                        spots[side][at] = len(zeros[side])
                        zeros[side][at] = p
                continue
            if term != word:
                word = term
                if len(rows) >= 256:
                    add()
                rows.append({})
            if at < 0:
                q = p
                continue
            rows[-1][at] = p
            if x == y and p > q:
                out.append((lang, at, None, term, p - q))
        if len(out) >= 20_000:
            yield batch()
            out = []
    done()
    if out:
        yield batch()


def audit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, top: int = 50, tile: int = 512, gather: int = GATHER) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and the `top` terms in which a source exceeds its language."""
    spark = df.sparkSession
    deal = partitions(spark)
    word = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), word(lang).alias("lang"), word(source).alias("source"), word(text).alias("text"))
    counted = docs.mapInArrow(lambda batches: runs(batches, gather), "lang string, term string, source string, doc bigint, docs bigint, n bigint")
    # a hash stands before the other keys, which sort by comparing it alone as long as terms differ
    ordered = counted.repartition(deal, "lang", "term").withColumn("h", F.xxhash64("lang", "term")).sortWithinPartitions("h", "lang", "term", "source", "doc").select("lang", "term", "source", "docs", "n")
    kept = written(ordered.mapInArrow(lambda batches: kept_terms(batches, least), "lang string, term string, source string, n bigint"), "terms")

    langs = kept.filter("source is null").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    langs = docs.select("lang").distinct().join(langs, "lang", "left").na.fill(0, ["v", "n"])
    sums = kept.filter("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("m"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["m"]).join(langs, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    whole = F.col("m") + 5 * F.col("v")
    zero = F.when(F.col("v") > 0, share(F.lit(5).cast("long"), F.greatest(whole, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    groups = written(groups.select("lang", "source", place.alias("at"), whole.alias("whole"), zero.alias("p")), "groups")

    tiles = groups.groupBy("lang").agg((F.expr(f"max(at) div {tile}") + 1).alias("tiles"))
    own = kept.filter("source is not null").join(groups.drop("p"), ["lang", "source"]).select("lang", "term", "at", share(F.col("n") + 5, F.col("whole")).alias("p"))
    every = kept.filter("source is null").join(langs.select("lang", (F.col("n") + 5 * F.col("v")).alias("whole")), "lang").select("lang", "term", F.lit(-1).cast("long").alias("at"), share(F.col("n") + 5, F.col("whole")).alias("p"))
    part = F.pmod(F.xxhash64("term"), F.lit(deal)).cast("int")
    shares = own.unionByName(every).withColumn("part", part)
    heads = groups.select("lang", F.lit(None).cast("string").alias("term"), "at", "p", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("part"))
    both = shares.unionByName(heads).join(tiles, "lang").withColumn("tile", F.expr(f"at div {tile}"))
    first, last = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), F.col("tiles") - 1
    # a source's tile meets every tile; the whole language's share goes to each pair of tiles
    met = F.transform(first, lambda t: F.struct(F.least(t, F.col("tile")).alias("x"), F.greatest(t, F.col("tile")).alias("y")))
    all_pairs = F.flatten(F.transform(first, lambda x: F.transform(F.sequence(x, last), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    dealt = both.withColumn("xy", F.explode(F.when(F.col("at") < 0, all_pairs).otherwise(met))).select("lang", "xy.x", "xy.y", "part", "term", "at", "p")
    scanned = dealt.repartition(deal, "lang", "x", "y", "part").sortWithinPartitions("lang", "x", "y", "part", F.asc_nulls_first("term"), "at")
    found = written(scanned.mapInArrow(lambda batches: compared(batches, tile), "lang string, a bigint, b bigint, term string, value bigint"), "differences")

    names = groups.select("lang", "at", "source")
    left, right = names.select("lang", F.col("at").alias("a"), F.col("source").alias("one")), names.select("lang", F.col("at").alias("b"), F.col("source").alias("other"))
    pairs = found.filter("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).join(left, ["lang", "a"]).join(right, ["lang", "b"])
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("s")
    pairs = pairs.select("lang", "value", sides).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = found.filter("term is not null").join(left, ["lang", "a"]).select("lang", F.col("one").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
