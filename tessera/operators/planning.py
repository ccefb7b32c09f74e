"""Sampling keys and planning the partitions of an index."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .opclass import OpClass

#: Partitions for each block of input, before rounding up.
PER_BLOCK = 2.5
DEFAULT_FRACTION = 1e-4
#: So many counts of cells reach the driver at once, never keys.
PLAN_CELLS = 70_000


def n_partitions(total_bytes: int, block_bytes: int, fanout: int) -> int:
    """PER_BLOCK for each begun block, rounded up to a number that splitting one cell at a time into its children can
    reach: 1 + k * (fanout - 1)."""
    wanted = int((total_bytes // block_bytes + 1) * PER_BLOCK)
    return 1 + -(-(wanted - 1) // (fanout - 1)) * (fanout - 1)


def fraction_of(percent: float | None) -> float:
    """A sample's fraction as given on the command line: above 1 it's a percentage, 1 is all."""
    if percent is None:
        return DEFAULT_FRACTION
    if not 0 < percent <= 100:
        raise ValueError(f"a sample is a fraction up to 1 or a percentage up to 100, not {percent}")
    return percent / 100 if percent > 1 else percent


def sample_keys(records: DataFrame, opclass: OpClass, fraction: float, seed: int = 42) -> DataFrame:
    """The distinct keys of a Bernoulli sample; the same for the same input and seed."""
    keys = records.select(*opclass.keys).where(opclass.valid())
    return (keys if fraction >= 1 else keys.sample(False, fraction, seed)).distinct()


def plan_partitions(keys: DataFrame, opclass: OpClass, n: int) -> list[tuple[str, int]]:
    """(path, sampled keys) of n parts that tile the space, in order; the place is the part's number.

    The space is divided once, then the part with the most sampled keys (the first of equals) until there are n; its
    children take its place. Cells are counted as deep as PLAN_CELLS counts allow; when a part beyond is to be divided,
    it and the others that may be are counted deeper, so parts follow the keys wherever they crowd. Parts at the
    resolution aren't divided further. Without keys the first part is."""
    deepest = opclass.params.resolution
    counts: dict[str, int] = {}
    known: set[str] = set()  # paths whose children are counted

    def count(open_parts: list[str]) -> None:
        more = 1
        while len(open_parts) * len(opclass.symbols) ** (more + 1) <= PLAN_CELLS and more < deepest:
            more += 1
        depth = {p: min(len(p) + more, deepest) for p in open_parts}
        for size in sorted(set(map(len, open_parts))):
            some = [p for p in open_parts if len(p) == size]
            path = opclass.path(depth[some[0]])
            held = keys.select(path.alias("p"))
            if size:
                held = held.where(F.substring("p", F.lit(1), F.lit(size)).isin(some))
            for r in held.groupBy("p").agg(F.count("*").alias("n")).collect():
                for level in range(size + (size > 0), len(r["p"]) + 1):
                    counts[r["p"][:level]] = counts.get(r["p"][:level], 0) + r["n"]
                    known.add(r["p"][: level - 1])

    count([""])
    # (fewer keys, path) of the parts that can be divided; in this order the first of equals comes first
    heap = [(-counts.get(s, 0), s) for s in opclass.symbols]
    heapify(heap)
    done = []
    while heap and len(heap) + len(done) < n:
        fewer, most = heappop(heap)
        if len(most) >= deepest:
            done.append((fewer, most))
            continue
        if fewer and most not in known:
            heappush(heap, (fewer, most))
            unknown = sorted((k, p) for k, p in heap if k and p not in known and len(p) < deepest)
            count([p for _, p in unknown[: PLAN_CELLS // len(opclass.symbols)]])
            continue
        for s in opclass.symbols:
            heappush(heap, (-counts.get(most + s, 0), most + s))
    return sorted((p, -fewer) for fewer, p in heap + done)
