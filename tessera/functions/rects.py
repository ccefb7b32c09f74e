"""Rectangles and points as columns: predicates, order, text and JSON-like forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    """A rectangle with x0 <= x1 and y0 <= y1, closed on all edges."""

    x0: float
    y0: float
    x1: float
    y1: float

    def __post_init__(self):
        for name in ("x0", "y0", "x1", "y1"):
            object.__setattr__(self, name, float(getattr(self, name)))

    @classmethod
    def corners(cls, x1: float, y1: float, x2: float, y2: float) -> "Rect":
        """From two opposite corners, in any order."""
        return cls(min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))

    @classmethod
    def extent(cls, x: float, y: float, w: float, h: float) -> "Rect":
        """From a corner and an extent that may be negative."""
        return cls.corners(x, y, x + w, y + h)

    def overlaps(self, o: "Rect") -> bool:
        return self.x0 <= o.x1 and o.x0 <= self.x1 and self.y0 <= o.y1 and o.y0 <= self.y1

    def covers(self, o: "Rect") -> bool:
        return self.x0 <= o.x0 and o.x1 <= self.x1 and self.y0 <= o.y0 and o.y1 <= self.y1


WORLD = Rect(-180.0, -90.0, 180.0, 90.0)


def edge(lo: float, hi: float, n: int, i: int) -> float:
    """Where the i-th of n equal steps from lo to hi begins; the last one ends at hi."""
    return hi if i == n else lo + i * ((hi - lo) / n)


def step_of(value: Column, lo: float, hi: float, n: int) -> Column:
    """The last i below n with edge(i) <= value, 0 if there's none: division gives it but for rounding, the edges
    themselves decide. One expression, however many steps there are."""
    step = (hi - lo) / n
    at = F.least(F.greatest(F.floor((value - lo) / step), F.lit(0)), F.lit(n - 1)).cast("long")
    low = lambda i: F.lit(lo) + i.cast("double") * F.lit(step)
    return F.when((value < low(at)) & (at > 0), at - 1).when((value >= low(at + 1)) & (at < n - 1), at + 1).otherwise(at)


def point_in(x: Column, y: Column, r: Rect) -> Column:
    """Closed on all four edges. A null coordinate gives null, which filters drop: plain comparisons are pushed down."""
    return x.between(r.x0, r.x1) & y.between(r.y0, r.y1)


def in_corners(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """As point_in, with the corners as columns in any order, and false for nulls; bounds are compared as they are."""
    return F.coalesce(x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2)), F.lit(False))


def _ends(r: Column) -> tuple[Column, Column, Column, Column]:
    """x0, x1, y0, y1 of a struct (x, y, w, h) whose extents may be negative."""
    return (F.least(r["x"], r["x"] + r["w"]), F.greatest(r["x"], r["x"] + r["w"]), F.least(r["y"], r["y"] + r["h"]), F.greatest(r["y"], r["y"] + r["h"]))


def normalised(r: Column) -> Column:
    x0, x1, y0, y1 = _ends(r)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def contains_point(r: Column, x: Column, y: Column) -> Column:
    x0, x1, y0, y1 = _ends(r)
    return F.coalesce(x.between(x0, x1) & y.between(y0, y1), F.lit(False))


def contains(a: Column, b: Column) -> Column:
    """Whether all of b lies in a."""
    ax0, ax1, ay0, ay1 = _ends(a)
    bx0, bx1, by0, by1 = _ends(b)
    return (ax0 <= bx0) & (bx1 <= ax1) & (ay0 <= by0) & (by1 <= ay1)


def overlaps(a: Column, b: Column) -> Column:
    """Whether a and b share a point; a cross without corners inside each other counts, as do touching edges."""
    ax0, ax1, ay0, ay1 = _ends(a)
    bx0, bx1, by0, by1 = _ends(b)
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def order_keys(r: Column) -> list[Column]:
    """Rectangles sort by area, then x, then y."""
    return [r["w"] * r["h"], r["x"], r["y"]]


def point_text(x: Column, y: Column, names: tuple[str, str] = ("X", "Y")) -> Column:
    return F.concat(F.lit(f"{names[0]}: "), x.cast("string"), F.lit(f" {names[1]}: "), y.cast("string"))


def pair_text(first: Column, second: Column) -> Column:
    return F.concat(F.lit("("), first.cast("string"), F.lit(", "), second.cast("string"), F.lit(")"))


def rect_text(r: Column) -> Column:
    """X: x Y: y H: h W: w"""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{k.upper()}: "), r[k].cast("string")) for k in "xyhw"))


def rect_json(r: Column) -> Column:
    """[x,y,w,h]"""
    return F.concat(F.lit("["), F.concat_ws(",", *(r[k].cast("string") for k in "xywh")), F.lit("]"))


def rect_from_json(text: Column) -> Column:
    part = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")
    return F.struct(*(F.get(part, i).cast("double").alias(k) for i, k in enumerate("xywh")))


def node_json(first: Column, predicate: Column) -> Column:
    """{first,predicate}: of an index node the number of its children, of a reference its path; null without one."""
    return F.concat(F.lit("{"), first.cast("string"), F.lit(","), F.coalesce(predicate, F.lit("null")), F.lit("}"))


#: Serialized sizes in bytes.
POINT_BYTES, RECT_BYTES, LONG_BYTES, CHAR_BYTES = 16, 32, 8, 2
#: A node's own bytes besides its predicate: kind, size, place and number of children or records.
NODE_BYTES = 17


def string_bytes(s: Column) -> Column:
    """Two bytes of length and the characters."""
    return F.octet_length(s) + 2


def pair_bytes(key: Column | int) -> Column:
    """A key and its record's number."""
    return (F.lit(key) if isinstance(key, int) else key) + LONG_BYTES
