"""The quadtree over points."""

from __future__ import annotations

from dataclasses import astuple, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rects import POINT_BYTES, RECT_BYTES, WORLD, Rect, edge, point_in, step_of
from .opclass import IndexParams, OpClass

DEFAULT = IndexParams(fanout=4, blocksize=100, resolution=40, path_shrink="LEAF", node_shrink=True)
#: Digits that a long holds, and levels for which doubles tell the cells of a world apart.
_DIGITS, _DEEPEST = 18, 48
#: A query's rectangle is covered by so many ranges of paths at most.
_RANGES = 16


class Quad(OpClass):
    """Cells are halved in both directions: 0 upper left, 1 upper right, 2 lower left, 3 lower right. They hold their
    left and lower edges, those at the world's right and upper edge these too, so each point has one cell. Keys are
    compared with the cells' bounds, which binary fractions of the world hold exactly."""

    keys, symbols, predicate_bytes = ("x", "y"), "0123", RECT_BYTES

    def __init__(self, world: Rect = WORLD, **params):
        self.world, self.params = world, replace(DEFAULT, **params)
        if self.params.resolution > _DEEPEST or world.x0 >= world.x1 or world.y0 >= world.y1:
            raise ValueError(f"a quadtree has {_DEEPEST} levels at most, and a world with an inside")

    def space(self) -> dict:
        return {"world": list(astuple(self.world))}

    def path(self, depth: int) -> Column:
        """A level's digit is 1 for the right half and 2 for the lower one: the bits of a cell's column and of its row
        from above, written as decimal digits, add up to the path."""
        w, n = self.world, 1 << depth
        across = step_of(F.col("x"), w.x0, w.x1, n)
        down = F.lit(n - 1) - step_of(F.col("y"), w.y0, w.y1, n)
        out = []
        for first in range(0, depth, _DIGITS):
            size = min(_DIGITS, depth - first)
            bits = lambda c: F.bin(F.shiftright(c, depth - first - size).bitwiseAND(F.lit((1 << size) - 1))).cast("long")  # noqa: B023, E731
            out.append(F.lpad((bits(across) + 2 * bits(down)).cast("string"), size, "0"))
        return F.concat(*out) if out else F.lit("")

    def valid(self) -> Column:
        return point_in(F.col("x"), F.col("y"), self.world)

    def cell(self, path: str) -> Rect:
        w, n = self.world, 1 << len(path)
        col, row = (sum(int(d) >> k & 1 and n >> i + 1 for i, d in enumerate(path)) for k in (0, 1))
        row = n - 1 - row
        return Rect(edge(w.x0, w.x1, n, col), edge(w.y0, w.y1, n, row), edge(w.x0, w.x1, n, col + 1), edge(w.y0, w.y1, n, row + 1))

    def cell_of(self, path: Column) -> Column:
        """(x, y, w, h) of a path's cell."""
        w, n = self.world, F.pow(F.lit(2.0), F.length(path))
        number = lambda bits: F.conv(F.concat(F.lit("0"), F.translate(path, "0123", bits)), 2, 10).cast("double")
        wide, high = F.lit(w.x1 - w.x0) / n, F.lit(w.y1 - w.y0) / n
        return F.struct((F.lit(w.x0) + number("0101") * wide).alias("x"), (F.lit(w.y0) + number("1100") * high).alias("y"), wide.alias("w"), high.alias("h"))

    def in_range(self, lo, hi) -> Column:
        return point_in(F.col("x"), F.col("y"), Rect.corners(*lo, *hi))

    def may_hold(self, least: dict, most: dict, lo, hi) -> bool:
        return Rect(least["x"], least["y"], most["x"], most["y"]).overlaps(Rect.corners(*lo, *hi))

    def paths(self, lo, hi) -> list[tuple[str, str]]:
        """The cells that the rectangle touches, the coarsest of those it cuts divided until there are _RANGES: keys
        outside the world have the path of the cell nearest to them, so the rectangle is moved to its edge too."""
        w, r = self.world, Rect.corners(*lo, *hi)
        near = lambda v, a, b: min(max(v, a), b)
        r = Rect(near(r.x0, w.x0, w.x1), near(r.y0, w.y0, w.y1), near(r.x1, w.x0, w.x1), near(r.y1, w.y0, w.y1))
        whole, cut, depth = [], [""], self.params.resolution
        while cut and len(whole) + len(cut) < _RANGES and len(cut[0]) < depth:
            kids = [p for p in (cut[0] + s for s in self.symbols) if self.cell(p).overlaps(r)]
            cut = cut[1:] + [p for p in kids if not r.covers(self.cell(p))]
            whole += [p for p in kids if r.covers(self.cell(p))]
        return [(p + "0" * (depth - len(p)), p + "3" * (depth - len(p))) for p in sorted(whole + cut)]

    def region(self, path: str) -> dict:
        r = self.cell(path)
        return {"prefix": path, "x0": r.x0, "x1": r.x1, "y0": r.y0, "y1": r.y1}

    def key_bytes(self) -> Column:
        return F.lit(POINT_BYTES)

    def _choose(self, at: str, parts: dict[str, int]) -> Column:
        if at in parts:
            return F.lit(parts[at])
        left, low = F.col("x") < self.cell(at + "1").x0, F.col("y") < self.cell(at + "0").y0
        ul, ur, ll, lr = (self._choose(at + s, parts) for s in self.symbols)
        return F.when(low, F.when(left, ll).otherwise(lr)).otherwise(F.when(left, ul).otherwise(ur))
