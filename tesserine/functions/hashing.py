"""A mix of 64 bits, exact, by built-in expressions: numbers are signed longs that stand for unsigned ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of Thomas Wang's published mix of 64 bits (fixed values): ~x + (x << 21), then x ^ (x >> n), and x + (x << a) + (x << b).
FIRST, STEPS, LAST = 21, [(24, (3, 8)), (14, (2, 4))], (28, 31)
HALF = (1 << 32) - 1


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is worked out once however often f has it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def wrapped_sum(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64, by halves, so that nothing overflows."""
    half = F.lit(HALF).cast("long")
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def mix64(x: Column) -> Column:
    """The mix of a long."""

    def fold(n: int) -> Callable[[Column], Column]:
        return lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, n))

    def spread(*shifts: int) -> Callable[[Column], Column]:
        def f(k: Column) -> Column:
            out = k
            for n in shifts:
                out = wrapped_sum(out, F.shiftleft(k, n))
            return out

        return f

    x = once(x, lambda k: wrapped_sum(F.bitwise_not(k), F.shiftleft(k, FIRST)))
    for n, shifts in STEPS:
        x = once(once(x, fold(n)), spread(*shifts))
    return once(once(x, fold(LAST[0])), spread(LAST[1]))


def unsigned_mod(x: Column, n: int) -> Column:
    """The remainder of a long taken as an unsigned number; n is under 2 ** 62."""
    return ((F.shiftrightunsigned(x, 1) % n) * 2 + x.bitwiseAND(F.lit(1).cast("long"))) % n
