"""Index families: what the engine needs to know of a key type, as native column expressions."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many parts are told apart by nested CASE; more by bisecting their first paths.
CASE_PARTS = 512


@dataclass(frozen=True)
class IndexParams:
    """fanout: children of a node; blocksize: records of a leaf; resolution: largest depth; path_shrink: 'NEVER' (all
    leaves at the largest depth), 'LEAF' (a leaf ends its path) or 'TREE' (and nodes with one child are left out of
    the catalog); node_shrink: whether empty children are left out of it."""

    fanout: int
    blocksize: int
    resolution: int
    path_shrink: str = "LEAF"
    node_shrink: bool = True

    def __post_init__(self):
        if self.path_shrink not in ("NEVER", "LEAF", "TREE") or min(self.fanout, self.blocksize, self.resolution) < 1:
            raise ValueError(f"bad index parameters: {self}")


class OpClass(ABC):
    """A space is divided by paths: strings of one symbol a level. The methods give expressions over the key's columns,
    so that planning and execution stay with the optimizer."""

    params: IndexParams
    #: The key's columns.
    keys: tuple[str, ...]
    #: The symbols of a level, in child order, which is their order as characters.
    symbols: str
    #: Bytes of a node's predicate.
    predicate_bytes: int = 0

    @abstractmethod
    def path(self, depth: int) -> Column:
        """The key's path, depth symbols long (a cell of that level)."""

    @abstractmethod
    def valid(self) -> Column:
        """Whether the key lies in the space that the index divides."""

    @abstractmethod
    def in_range(self, lo, hi) -> Column:
        """The exact test of a key against a query."""

    @abstractmethod
    def may_hold(self, least: dict, most: dict, lo, hi) -> bool:
        """Whether keys between least and most (by column, as found in a part's records) can lie in the range: never a
        false no."""

    @abstractmethod
    def region(self, path: str) -> dict:
        """The catalog's columns that describe a path's cell: prefix, x0, x1, y0, y1, null where they don't apply."""

    @abstractmethod
    def key_bytes(self) -> Column:
        """The serialized size of a key."""

    def space(self) -> dict:
        """What a stored index has to be opened with besides its parameters, as JSON can hold it."""
        return {}

    def paths(self, lo, hi) -> list[tuple[str, str]]:
        """Ranges of paths, ends included, that hold every key of the range; none: any path may."""
        return []

    def choose(self, parts: dict[str, int]) -> Column:
        """The number of the part (path: number) in whose cell the key lies: nested CASE over the key's columns, or, of
        many parts, the last whose path isn't after the key's. The parts' cells must tile the space."""
        if len(parts) <= CASE_PARTS:
            return self._choose("", parts)
        starts = sorted(parts)
        given, numbers = F.array(*map(F.lit, starts)), F.array(*(F.lit(parts[p]) for p in starts))
        path = self.path(max(map(len, starts)))
        ends = F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi"))

        def halve(a, _):
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            low = F.get(given, mid) <= path
            return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

        rounds = F.sequence(F.lit(1), F.lit(len(starts).bit_length()))
        return F.get(numbers, F.aggregate(rounds, ends, halve, lambda a: a["lo"]))

    @abstractmethod
    def _choose(self, at: str, parts: dict[str, int]) -> Column: ...
