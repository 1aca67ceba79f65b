"""String, formatting and parsing helpers; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(s: Column, delimiter: str) -> Column:
    """Split that drops one empty token at the end."""
    parts = F.split(s, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def replace_spaces(s: Column) -> Column:
    return F.translate(s, " ", "_")


def replaced(s: Column, what: str, by: str) -> Column:
    """Every occurrence of a text replaced by another."""
    return F.replace(s, F.lit(what), F.lit(by))


def micros(ns: Column) -> Column:
    return ns / 1e3


def millis(ns: Column) -> Column:
    return ns / 1e6


def seconds(ns: Column) -> Column:
    return ns / 1e9


def basename(s: Column) -> Column:
    """What follows the last slash; empty where there is none."""
    return F.when(F.contains(s, F.lit("/")), F.substring_index(s, "/", -1)).otherwise("")


def without_extension(s: Column) -> Column:
    return F.regexp_replace(s, r"\.[^.]*$", "")


def hundredths(n: Column, of: Column) -> Column:
    """100 n / of as a text with two decimals, half up, in whole numbers."""
    v = F.floor((20000 * n + of) / (2 * of)).cast("long")
    return F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))


def perc_str(n: Column, of: Column) -> Column:
    """n (p.pp%)."""
    return F.concat(n.cast("string"), F.lit(" ("), hundredths(n, of), F.lit("%)"))


def size_str(n: Column) -> Column:
    """Bytes with a unit and two decimals, half up."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for unit, power in (("KB", 10), ("MB", 20), ("GB", 30), ("TB", 40)):
        one = 1 << power
        out = F.when(n >= one, F.concat(hundredths(n, F.lit(100 * one)), F.lit(unit))).otherwise(out)
    return out


def fastq_name(header: Column) -> Column:
    """Name of a read from its header: x/1 stays, x-R1 and Illumina's x 1:Y:.. become x/1."""
    s = F.regexp_replace(header, "^@", "")
    s = F.regexp_replace(s, r"^(\S+)\s+([12]):[YN]:.*$", "$1/$2")
    return F.regexp_replace(s, r"^(\S+)-R([12])$", "$1/$2")


def literal(s: Column) -> tuple[Column, Column, Column]:
    """A logged value as (long, double, text): the first type that reads it; nan of any sign is a double."""
    nan = F.lower(s).isin("nan", "-nan")
    whole = F.when(s.rlike(r"^[+-]?\d{1,18}$"), s.try_cast("long"))
    real = F.when(nan, F.lit(float("nan"))).when(whole.isNull() & s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return whole, real, F.when(whole.isNull() & real.isNull(), s)
