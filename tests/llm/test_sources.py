"""Merkle manifest, HyperMinHash near-dedup and source divergence: brute force, SQL and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.llm import divergence, hyperminhash, merkle, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_hyper_minhash", "op13_source_divergence", "op9_ngram_jaccard"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    table = lambda df: sorted(map(str, df[columns].astype(str).itertuples(index=False)))
    assert table(got) == table(want)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """(root, path of every node as lists of (before, after)) of a tree."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            at[k] = i // 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def manifest_of(rows):
    """{(doc, leaf): [(subroot, root, path)]} of rows (doc, source, leaf)."""
    groups = defaultdict(list)
    for doc, source, leaf in rows:
        groups[source].append((doc is not None, doc or 0, leaf, doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        groups[s].sort(key=lambda r: r[:3])
        made[s] = climbed([r[2] for r in groups[s]])
    root, tops = climbed([made[s][0] for s in names])
    out = defaultdict(list)
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(groups[s], made[s][1], strict=True):
            out[r[3], r[2]].append((made[s][0], root, path + top))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 243, 244, 728, 729])
def test_traversal(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, paths = climbed(leaves)
    height = merkle.height_of(n)
    walk = merkle.Traversal(leaves, height)
    most = 0
    for want, got in zip(paths, walk.paths(), strict=True):
        assert got == want
        most = max(most, sum(len(level) for t in walk.existing + walk.desired for level in t.kept))
    assert most <= 2 * 12 * max(1, len(walk.strata))  # two subtrees a stratum, whatever the block
    assert merkle.Subtree(height, height, 0, leaves).grow(n).root == root


def test_manifest(spark):
    rng = random.Random(5)
    sizes = {None: 3, "": 1, "b": 40, "aé": 9, "big": 2300} | {f"s{i}": 1 for i in range(760)}
    rows = [(i * 7 % 5000, s, sha(str(rng.random()))) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "b", "0" * 64), (4, "b", "1" * 64), (4, "b", "1" * 64)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, leaf string, path string, `a.b` int")
    want = manifest_of(rows)
    got = defaultdict(list)
    for r in merkle.manifest(df, keep=("path", "a.b")).toDF("doc_id", "leaf", "steps", "subroot", "root", "path", "ab").collect():
        assert (r.path, r.ab) == ("x", 1)
        got[r.doc_id, r.leaf].append((r.subroot, r.root, [(s.before, s.after) for s in r.steps]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_edges(spark):
    rows = [(0, None, None, None, None), (1, "a", "en", 3, ""), (2, "a", "en", 3, "x\ny"), (3, "a", "é", -1, "w " * 50_000 + "\n"), (3, "a", "é", -1, "w " * 50_000 + "\n"), (None, "a", "en", 0, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaf = df.select("*", merkle.leaf_of(*map(F.col, df.columns)).alias("leaf"))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(r.leaf for r in leaf.collect()) == sorted(sha(*map(part, r)) for r in rows)
    found = merkle.manifest(leaf).select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), merkle.fold(F.lit("other"), F.col("path")).alias("wrong")).collect()
    assert len(found) == 6 and all(r.root == r.folded != r.wrong for r in found)
    assert merkle.manifest(leaf.limit(0)).collect() == []
    for r in df.select("doc_id", queries.no_nulls_id().alias("c")).collect():
        assert r.c == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())


def shingles(text, width=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components_of(texts, at_least=80):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= at_least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: (len(sets[k]), top(k)) for k in keys}


def near_copies(rng, groups, copies, words, share):
    """Texts in groups: a base and copies of it with a share of words changed, and a passage that all have."""
    passage = [f"common{i}" for i in range(words // 4)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)] + passage
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(int(share * words) + 1)):
                own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [4, 2048])
@pytest.mark.parametrize("words", [5, 12, 200])
def test_dedup_against_brute_force(frame, block, words):
    texts = near_copies(random.Random(words), 6, 25, words, 0.12)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.dedup(frame(texts), block=block).collect()}
    want = components_of(dict(enumerate(texts)))
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_dedup_edges(spark, frame):
    texts = [None, "", " \t\n", "A a b", "a A B", "x " * 40_000 + "y", "x " * 40_000 + "z", "one two three four five", "one two three four five", "é " * 9]
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.dedup(frame(texts)).collect()}
    assert rows == {k: (n, c, k == c) for k, (n, c) in components_of(dict(enumerate(texts))).items()}
    same = hyperminhash.dedup(frame(["a b c d e f", "p q r s", "a b c d e f"], ids=[7, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles, r.kept) for r in same) == [(-1, -1, 3, True), (7, 7, 1, True), (7, 7, 3, True)]
    assert hyperminhash.dedup(frame(texts).limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "a b c d", 2), (2, "a b c d", 3)], "doc_id long, text string, `k.x` int")
    assert sorted((r.doc_id, r.kept) for r in hyperminhash.dedup(odd).collect()) == [(1, True), (2, False)]


def test_registers_and_estimate():
    rng = np.random.default_rng(3)
    a, b = np.sort(rng.integers(0, 1 << 64, 3000, dtype=np.uint64)), np.sort(rng.integers(0, 1 << 64, 5, dtype=np.uint64))
    got = hyperminhash.registers(np.array([0, 3000, 3000, 3005]), np.concatenate([a, b]))
    for row, hashes in ((0, a), (1, []), (2, b)):
        want = [0xFFFF] * 128
        for h in map(int, hashes):
            slot, rest = h >> 57, (h << 7) & ((1 << 64) - 1)
            zeros = 64 - rest.bit_length()
            value = zeros << 10 | ((rest << zeros + 1) & ((1 << 64) - 1)) >> 54
            # the least rest has the most zeros and, of those, the least mantissa
            held = want[slot]
            if held == 0xFFFF or (zeros, -(value & 1023)) > (held >> 10, -(held & 1023)):
                want[slot] = value
        assert got[row].tolist() == want
    full = hyperminhash.filled(got, hyperminhash.lenders())
    assert (full[1] == 0xFFFF).all() and (full[[0, 2]] != 0xFFFF).all() and set(full[2].tolist()) == set(got[2].tolist()) - {0xFFFF}
    # linked sets pass, unlike ones of equal sizes hardly ever
    passed = strange = met = 0
    for _ in range(300):
        both, x, y = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (800, 100, 100))
        s = hyperminhash.registers(np.array([0, 900, 1800, 2700]), np.concatenate([np.sort(np.concatenate([both, x])), np.sort(np.concatenate([both, y])), np.sort(rng.integers(0, 1 << 64, 900, dtype=np.uint64))]))
        passed += bool(hyperminhash.hopeful(s[0], 900, s[1:2], np.array([900]), 80)[0])
        strange += bool(hyperminhash.hopeful(s[0], 900, s[2:], np.array([900]), 80)[0])
        keys = hyperminhash.filled(s, hyperminhash.lenders()).reshape(3, hyperminhash.BANDS, -1)
        met += bool((keys[0] == keys[1]).all(1).any())
    assert passed == met == 300 and strange == 0


def audit_of(docs, least, top=50):
    """Rows of the audit of docs (lang, source, text)."""
    terms, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        terms[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: share(terms[lang, s]) for s in sources}
        whole = share(sum((terms[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(own[s][t] - whole[t], t) for t in kept if terms[lang, s][t] and own[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, None), ("term", over, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(rows[:most])]
    return sorted(out)


@pytest.mark.parametrize(("tile", "gather"), [(3, 50), (512, 400_000)])
def test_audit(spark, tile, gather):
    rng = random.Random(8)
    words = ["Alpha", "beta", "GAMMA", "é", "ÉÉ", "日本", "x1y", "a_b", "z"] + [f"w{chr(97 + i)}" for i in range(26)]
    docs = [(rng.choice(["en", "de", None]), f"s{rng.randrange(8)}", " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(400)]
    docs += [("fr", "only", "rare"), ("fr", None, None), ("it", "alone", ""), (None, None, None), ("en", "s0", "beta " * 30_000)]
    df = spark.createDataFrame([(i % 390, *d, 0, "q") for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, rank int, `p.q` string")
    if gather < 100:  # many small runs of the same terms
        df = df.repartition(7)
    got = sorted(tuple(r) for r in divergence.audit(df, least=5, tile=tile, gather=gather).collect())
    assert got == audit_of(docs, 5)
    assert divergence.audit(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_scan_holds_few_sources(size):
    """A kept term's sources pass through; the scan agrees with sums over any batches."""
    rows = [("en", t, f"s{s:03}", 1, s) for t in ("a", "b") for s in range(100) for _ in range(2)] + [("en", "c", "s000", 4, 9), ("fr", "c", "s000", 29, 9), ("it", "c", "s000", 30, 9)]
    names = ["lang", "term", "source", "docs", "n"]
    scan, got = divergence.Scan(30), []
    for i in range(0, len(rows), size):
        got.append(scan.feed(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names)))
        assert scan.held.num_rows <= 30
    got.append(scan.feed(scan.held.slice(0, 0), last=True))
    want = [("en", t, f"s{s:03}", 2 * s) for t in ("a", "b") for s in range(100)] + [("en", t, None, 9900) for t in ("a", "b")] + [("it", "c", "s000", 9), ("it", "c", None, 9)]
    assert sorted(str(tuple(r.values())) for b in got for r in b.to_pylist()) == sorted(map(str, want))


def test_share_is_exact(spark):
    rng = random.Random(2)
    rows = [(n := rng.randrange(1, 10 ** rng.randrange(2, 15)), n + rng.randrange(10 ** rng.randrange(1, 15))) for _ in range(500)]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", divergence.share(F.col("n"), F.col("d")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.n // r.d for r in got)
