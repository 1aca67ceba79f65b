"""Byte-level BPE in linear time: longest matches by automaton, then backtracking.

A piece is walked left to right.  An Aho-Corasick automaton over the bytes,
written as Latin-1 characters, gives the longest token at each place; a token
is taken if it may follow the one before, that is, if the merges themselves
would leave the two apart.  Where none may follow, the walk steps back and
tries the next shorter token.  A row of tokens whose neighbours are all
compatible is the one that the merges give, so the result is exact.

Defined results: a null text counts as the empty one, which has no tokens;
a text of any length is encoded whole; repeated rows are encoded each for
itself; an empty table gives an empty one.  Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Sent

#: Entries of each memo of a Python worker; a memo starts anew when full.
MEMO = 1_000_000


def segments(text: str, memo: dict[str, bytes], encode) -> list[bytes]:
    """What encode gives for the parts of text, cut before every blank that a non-blank follows, with a memo of the parts.

    Such a blank always starts a match of the GPT-2 pattern, so no match crosses a cut.
    """
    parts = text.split(" ")
    out = [encode(parts[0])] if parts[0] else []
    before = parts[0]  # the part that out's last entry stands for
    held = parts[0]
    get = memo.get
    for p in parts[1:]:
        ids = get(p)
        if ids is None:
            if not p or p[0].isspace():  # blanks run on: take them back into the part before
                if held:
                    out.pop()
                held = before = held + " " + p
                out.append(encode(held))
                continue
            ids = encode(" " + p)
            if len(p) < 64:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[p] = ids
        held = " " + p
        out.append(ids)
    return out


def in_worker(name: str, make):
    """What make() gives, made once in a Python worker: a memo only, with no effect on results."""
    kept = sys.__dict__.setdefault("_tesserine_memo", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def read_ranks(path: str) -> dict[bytes, int]:
    """The file of ranks: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges by their definition: join the leftmost pair of least rank until none is left. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


class Encoder:
    """Encodes texts; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = dict((r, t) for t, r in ranks.items())
        self.length = {r: len(t) for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        auto = ahocorasick.Automaton()
        for t, r in ranks.items():
            auto.add_word(t.decode("latin-1"), r)
        auto.make_automaton()
        self.auto = auto
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    def parts(self, t: int) -> tuple[int, int]:
        """The two tokens of t's last merge; t twice for a single byte."""
        known = self.halves.get(t)
        if known is None:
            s = self.token[t]
            ids = merge(s, {k: r for i in range(len(s)) for j in range(i + 1, len(s) + 1) if (r := self.ranks.get(k := s[i:j])) is not None and k != s})
            known = self.halves[t] = (ids[0], ids[1]) if len(ids) == 2 else (t, t)
        return known

    def apart(self, a: int, b: int) -> bool:
        """Undoes the merges on both sides of the border, the latest first, and sees whether any stage would have joined across it sooner."""
        ranks, token, before = self.ranks, self.token, 1 << 60
        while True:
            joined = ranks.get(token[a] + token[b])
            if joined is not None and joined < before:
                return False
            # of equal ranks the left merge comes first
            for left in (True, False) if a > b else (False, True):
                x = a if left else b
                if len(token[x]) > 1:
                    break
            else:
                return True
            if left:
                before, a = a, self.parts(a)[1]
            else:
                before, b = b + 1, self.parts(b)[0]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of a's bytes and b's bytes together leave exactly a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.apart(a, b)
        return known

    def next_shorter(self, t: int) -> int:
        """The longest token that is a proper prefix of t; -1 if there is none."""
        known = self.shorter.get(t)
        if known is None:
            s, known = self.token[t], -1
            for k in range(len(s) - 1, 0, -1):
                if s[:k] in self.ranks:
                    known = self.ranks[s[:k]]
                    break
            self.shorter[t] = known
        return known

    def longest_at(self, piece: bytes) -> list[int]:
        """For each place, the longest token that starts there."""
        n, longest, length = len(piece), [-1] * len(piece), self.length
        for end, t in self.auto.iter(piece.decode("latin-1")):
            longest[end - length[t] + 1] = t  # of one start, later matches are longer
        return longest

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest, n, length = self.longest_at(piece), len(piece), self.length
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which no end can be reached
        at, t = 0, longest[0]
        pairs = self.pairs
        while at < n:
            if t < 0:  # nothing fits here: step back
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                t = self.next_shorter(last)
                continue
            to = at + length[t]
            if dead[to] or (out and not (pairs[k] if (k := (out[-1], t)) in pairs else self.may_follow(*k))):
                t = self.next_shorter(t)
                continue
            out.append(t)
            at = to
            if at < n:
                t = longest[at]
        return out

    def encode_part(self, part: str) -> bytes:
        return np.array([i for piece in self.find(part) for i in self.encode_piece(piece.encode())], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(segments(text, self.pieces, self.encode_part))

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The key with n_tokens, ids (binary, little-endian uint32) and decoded (binary); with digest, the SHA-256 of both instead.

    path: file of ranks, read by the driver and broadcast (a vocabulary, whose size does not depend on the data).
    """
    kind = dict(df.dtypes)[key]
    sent = Sent(df.sparkSession, read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = in_worker(f"bpe {path} {pattern}", lambda: Encoder(sent.value, pattern))
            ids = [encoder.encode(x or "") for x in b.column(1).to_pylist()]
            back = (encoder.decode(x) for x in ids)
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digest:
                more = [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), n, *more], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary()), pa.array(list(back), pa.binary())], ["k", "n_tokens", "ids", "decoded"])

    more = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint, {more}").withColumnRenamed("k", key)
