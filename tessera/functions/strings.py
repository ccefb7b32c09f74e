"""Strings as trie keys: 27 symbols, the terminator '-' and the letters, and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATOR = "-"
SYMBOLS = TERMINATOR + "abcdefghijklmnopqrstuvwxyz"


def terminated(s: Column) -> Column:
    return F.concat(F.lower(s), F.lit(TERMINATOR))


def symbol(c: Column) -> Column:
    """A character as a symbol: letters in lower case, all else the terminator."""
    return F.when(F.lower(c).rlike("^[a-z]$"), F.lower(c)).otherwise(TERMINATOR)


def ordinal(c: Column) -> Column:
    """0 for the terminator, 1 to 26 for the letters, -1 for others."""
    return F.when(F.length(c) == 1, F.instr(F.lit(SYMBOLS), c) - 1).otherwise(-1)


def from_ordinal(i: Column) -> Column:
    return F.when(i.between(0, 26), F.substring(F.lit(SYMBOLS), i + 1, F.lit(1)))


def path(s: Column, depth: int) -> Column:
    """The first `depth` symbols of a string's way down the trie."""
    return F.rpad(F.regexp_replace(F.lower(s), "[^a-z]", TERMINATOR), depth, TERMINATOR)


def consistent(s: Column, predicate: Column, level: Column) -> Column:
    """Whether the child `predicate` at `level` (from 1) holds the string."""
    c = F.substring(s, level, F.lit(1))
    return F.coalesce((c == predicate) | ((predicate == TERMINATOR) & (level > F.length(s))), F.lit(False))


def in_range(s: Column, lo: str, hi: str) -> Column:
    """Closed, alphabetical, the ends in either order; null for null, so that it's pushed down."""
    return s.between(min(lo, hi), max(lo, hi))


def interval_may_hold(least: str, most: str, lo: str, hi: str) -> bool:
    """Whether an interval of strings and a range, its ends in either order, have one in common."""
    return least <= max(lo, hi) and min(lo, hi) <= most


def interval_may_start(least: str, most: str, start: str) -> bool:
    """Whether an interval of strings has one that starts with a text, whatever its alphabet."""
    return least[: len(start)] <= start <= most


def char_text(c: Column) -> Column:
    return F.concat(F.lit("Ch: "), c)


def char_code(c: Column) -> Column:
    """A character's place in Unicode: their order, and their hash code."""
    return F.ascii(c)


def _int32(value: Column) -> Column:
    """The low 32 bits of a long as a signed number."""
    return F.shiftright(F.shiftleft(value, 32), 32)


def string_hash(s: Column) -> Column:
    """The characters' codes as digits of base 31, in 32 bits."""
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: _int32(a * 31 + F.ascii(c)))


def long_hash(value: Column) -> Column:
    value = value.cast("long")
    return _int32(value.bitwiseXOR(F.shiftrightunsigned(value, 32)))


def pair_hash(first: Column, second: Column) -> Column:
    """(first + second) * second + first, in 32 bits."""
    return _int32(_int32(_int32(first + second) * second) + first)


def file_number(file: Column) -> Column:
    """12 of part-r-00012."""
    return F.regexp_extract(file, r"-(\d+)$", 1).cast("int")


def last_segment(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)
