"""Scalar functions over sequences of bases; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 11


def encoded(s: Column) -> Column:
    """Upper case, N read as G and U as T: the two-bit code knows four bases."""
    return F.translate(F.upper(s), "NU", "GT")


def read_of(text: Column) -> Column:
    """The letters a, c, g, t, n of a text as an encoded read."""
    return encoded(F.regexp_replace(F.lower(text), "[^acgtn]+", ""))


def revcomp(s: Column) -> Column:
    """Reverse complement; N and 0 stay."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    return F.least(s, revcomp(s))


def strict_revcomp(s: Column) -> Column:
    """Reverse complement that refuses letters other than A, C, G, T, N and 0."""
    return F.when(s.rlike("[^ACGTN0]"), F.raise_error(F.concat(F.lit("not a base in "), s)).cast("string")).otherwise(revcomp(s))


def windows(s: Column, k: int = K, trim: int = 0) -> Column:
    """All windows of k bases, without the first and last `trim`; none where the read is too short."""
    n = F.length(s)
    # a sequence from 2 to 1 would count down, hence the guard
    return F.when(n >= k + 2 * trim, F.transform(F.sequence(F.lit(1 + trim), n - k + 1 - trim), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def forward(kmer: Column, base: Column) -> Column:
    """Shift one base in on the right."""
    return F.concat(F.substr(kmer, F.lit(2)), base)


def backward(kmer: Column, base: Column) -> Column:
    """Shift one base in on the left."""
    return F.concat(base, F.substr(kmer, F.lit(1), F.length(kmer) - 1))


def packed(kmer: Column, k: int = K) -> Column:
    """Two bits a base of k-mers of k bases, 32 at most, padded with A to whole bytes, as a signed number."""
    if not 1 <= k <= 32:
        raise ValueError("a number holds 32 bases; packed_words takes more")
    code = F.translate(kmer, "ACGT", "0123")
    return F.conv(F.rpad(code, 4 * ((k + 3) // 4), "0"), 4, -10).cast("long")


def packed_words(kmer: Column, k: int) -> Column:
    """k-mers of any k as an array of numbers of 32 bases each, the last one padded with A to whole bytes."""
    return F.array(*(packed(F.substring(kmer, a + 1, min(32, k - a)), min(32, k - a)) for a in range(0, k, 32)))


def _bases(word: Column, n: int) -> Column:
    """The last n bases of a word. By its hexadecimal digits, which have no sign: conv takes the decimal ones of the least long for an overflow."""
    return F.translate(F.lpad(F.conv(F.hex(word.cast("long")), 16, 4), n, "0"), "0123", "ACGT")


def unpacked(number: Column, k: int) -> Column:
    """The k bases, 32 at most, of a packed number."""
    return F.substring(_bases(number, 4 * ((k + 3) // 4)), 1, k)


def unpacked_words(numbers: Column, k: int) -> Column:
    return F.concat(*(unpacked(F.get(numbers, F.lit(a // 32)), min(32, k - a)) for a in range(0, k, 32)))


#: Masks that swap neighbours of 2, 4, 8 and 16 bits.
SWAPS = [(2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)]


def _mirrored(word: Column) -> Column:
    """The 32 bases of a word in reverse and complemented."""
    for n, mask in SWAPS:
        keep = F.lit(mask).cast("long")
        word = F.shiftrightunsigned(word, n).bitwiseAND(keep).bitwiseOR(F.shiftleft(word.bitwiseAND(keep), n))
    return F.bitwise_not(F.shiftrightunsigned(word, 32).bitwiseOR(F.shiftleft(word, 32)))


def key_words(k: int) -> int:
    """Words of 64 bits of a key of k bases."""
    if not 1 <= k <= 64:
        raise ValueError("a key holds 1 to 64 bases")
    return 1 if k <= 32 else 2


def revcomp_key(words: list[Column], k: int) -> list[Column]:
    """Reverse complement of a key: bases of two bits, the last one lowest, in one word, or the first k - 32 in a word before."""
    if key_words(k) == 1:
        return [F.shiftrightunsigned(_mirrored(words[0]), 64 - 2 * k)]
    first, last = _mirrored(words[1]), _mirrored(words[0])
    gap = 128 - 2 * k
    if not gap:
        return [first, last]
    return [F.shiftrightunsigned(first, gap), F.shiftleft(first, 64 - gap).bitwiseOR(F.shiftrightunsigned(last, gap))]


def less_key(a: list[Column], b: list[Column]) -> Column:
    """Whether key a stands before key b: unsigned order, which is that of the bases."""
    turned = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    out = turned(a[-1]) < turned(b[-1])
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        out = (turned(x) < turned(y)) | ((x == y) & out)
    return out


def canonical_key(words: list[Column], k: int) -> list[Column]:
    """The lesser of a key and its reverse complement."""
    other = revcomp_key(words, k)
    first = less_key(words, other)
    return [F.when(first, a).otherwise(b) for a, b in zip(words, other, strict=True)]


def key_of(kmer: Column, k: int) -> list[Column]:
    """The key of a k-mer."""
    word = lambda s: F.conv(F.translate(s, "ACGT", "0123"), 4, -10).cast("long")
    return [word(kmer)] if key_words(k) == 1 else [word(F.substring(kmer, 1, k - 32)), word(F.substring(kmer, k - 31, 32))]


def kmer_of(words: list[Column], k: int) -> Column:
    """The bases of a key."""
    return _bases(words[0], k) if key_words(k) == 1 else F.concat(_bases(words[0], k - 32), _bases(words[1], 32))


def djb2(s: Column, modulus: int = 2147483647) -> Column:
    """h = byte + 33 h from 5381, modulo a prime so that it stays exact."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("long")), F.lit(5381).cast("long"), lambda h, b: (b + 33 * h) % modulus)


def djb2_wrapped(s: Column) -> Column:
    """The same hash modulo 2**64, as a decimal number."""
    kind = "decimal(38,0)"
    step = lambda h, b: F.pmod(b + 33 * h, F.lit(str(1 << 64)).cast("decimal(20,0)")).cast(kind)
    codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("decimal(3,0)"))
    return F.aggregate(F.when(F.length(s) > 0, codes).otherwise(F.array().cast("array<decimal(3,0)>")), F.lit(5381).cast(kind), step)
