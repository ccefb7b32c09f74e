"""The character trie over strings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.rects import CHAR_BYTES, string_bytes
from .opclass import IndexParams, OpClass

DEFAULT = IndexParams(fanout=27, blocksize=125, resolution=50, path_shrink="LEAF", node_shrink=False)


class Trie(OpClass):
    """A level is a character: a letter, or the terminator for the end and all other characters. The first character
    divides the first level. Strings of any alphabet are kept as they are; paths place them, and answers and pruning go
    by the strings themselves."""

    keys, symbols, predicate_bytes = ("str",), S.SYMBOLS, CHAR_BYTES

    def __init__(self, **params):
        self.params = replace(DEFAULT, **params)

    def path(self, depth: int) -> Column:
        return S.path(F.col("str"), depth)

    def valid(self) -> Column:
        return F.col("str").isNotNull()

    def in_range(self, lo, hi) -> Column:
        return S.in_range(F.col("str"), lo, hi)

    def may_hold(self, least: dict, most: dict, lo, hi) -> bool:
        return S.interval_may_hold(least["str"], most["str"], lo, hi)

    def region(self, path: str) -> dict:
        return {"prefix": path, "x0": None, "x1": None, "y0": None, "y1": None}

    def key_bytes(self) -> Column:
        return string_bytes(F.col("str"))

    def _choose(self, at: str, parts: dict[str, int]) -> Column:
        if at in parts:
            return F.lit(parts[at])
        c = F.substring(self.path(len(at) + 1), len(at) + 1, 1)
        out = self._choose(at + self.symbols[0], parts)
        for s in reversed(self.symbols[1:]):
            out = F.when(c == s, self._choose(at + s, parts)).otherwise(out)
        return out
