"""Local trees as sets of path prefixes: leaves, nodes and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rects import LONG_BYTES, NODE_BYTES
from .opclass import OpClass
from .order import with_neighbours, with_place

#: Consecutive records whose leaves are found in one task, besides their neighbours.
CHUNK = 100_000


def cells(records: DataFrame, opclass: OpClass, depth: int) -> DataFrame:
    """(path, n, bytes): how many records each cell of the deepest level holds, and the size of their keys and ids."""
    size = opclass.key_bytes().cast("long") + LONG_BYTES
    return records.groupBy(F.coalesce(opclass.path(depth), F.lit("")).alias("path")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def _shared(a: Column, b: Column) -> Column:
    """How many symbols two paths begin with in common."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("|"), b), r"^([^|]*)[^|]*\|\1", 1))


def overfull(deepest: DataFrame, block: int) -> DataFrame:
    """deepest (path, n, any others) with full: the length of the longest prefix of the path that more than block
    records have, -1 if even the empty one hasn't.

    Records lie in the order of their paths. A prefix holds more than block of them if a record and the one block
    places on share it, and every record between these two does too. So one sort and a running maximum over block + 1
    places answer all levels at once, however many there are. A cell takes part with block + 1 records at most: more
    change nothing, and a cell that a third of all records share stays small."""
    copies = deepest.select("path", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(block + 1)).cast("int"))).alias("copy"))
    placed = with_place(copies.select("path"), "path")
    near = Window.partitionBy("chunk").orderBy("place")
    out = with_neighbours(placed, block, max(CHUNK, 4 * block))
    out = out.withColumn("most", F.coalesce(_shared(F.col("path"), F.lead("path", block).over(near)), F.lit(-1)))
    reach = 1
    while reach < block + 1:  # most: the maximum over the last `reach` places
        step = min(reach, block + 1 - reach)
        out = out.withColumn("most", F.greatest("most", F.lag("most", step).over(near)))
        reach += step
    found = out.where("own").groupBy("path").agg(F.max("most").alias("full"))
    return deepest.join(found.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path")).drop("_path")


def cell_leaves(deepest: DataFrame, opclass: OpClass, depth: int | None = None, first: Column | int = 1) -> DataFrame:
    """deepest with leaf, the cell's shortest prefix, of `first` symbols at least, with at most blocksize records, or of
    the largest depth, however many records that has."""
    depth = depth or opclass.params.resolution
    if opclass.params.path_shrink == "NEVER":
        return deepest.withColumn("leaf", F.col("path"))
    first = F.lit(first) if isinstance(first, int) else first
    size = F.least(F.lit(depth), F.greatest(F.col("full") + 1, first))
    return overfull(deepest, opclass.params.blocksize).withColumn("leaf", F.substring("path", F.lit(1), size)).drop("full")


def leaves(deepest: DataFrame, opclass: OpClass, depth: int | None = None, first: int = 1) -> DataFrame:
    """(leaf, level, n, bytes) of the tree's leaves. The order of records doesn't matter and none is dropped."""
    found = cell_leaves(deepest, opclass, depth, first)
    return found.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("leaf", F.length("leaf").alias("level"), "n", "bytes")


def with_leaf(records: DataFrame, opclass: OpClass, depth: int | None = None, first: int = 1) -> DataFrame:
    """records with the column leaf."""
    depth = depth or opclass.params.resolution
    of_cell = cell_leaves(cells(records, opclass, depth), opclass, depth, first).select(F.col("path").alias("_cell"), "leaf")
    path = F.coalesce(opclass.path(depth), F.lit(""))
    return records.withColumn("_path", path).join(of_cell, F.col("_path") == F.col("_cell")).drop("_path", "_cell")


def prefix_counts(deepest: DataFrame, level: int) -> DataFrame:
    """(prefix, level, n) of the nodes of one level that hold a record."""
    return deepest.groupBy(F.substring("path", F.lit(1), F.lit(level)).alias("prefix")).agg(F.sum("n").alias("n")).select("prefix", F.lit(level).alias("level"), "n")


def above(ends: DataFrame) -> DataFrame:
    """(prefix, level, n, bytes) of the nodes above leaves: a leaf's records count for each of its prefixes."""
    each = ends.select("leaf", "n", "bytes", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("level"))
    return each.groupBy(F.substring("leaf", F.lit(1), F.col("level")).alias("prefix"), "level").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def nodes(deepest: DataFrame, opclass: OpClass, depth: int | None = None) -> DataFrame:
    """(prefix, level, n, bytes, children) of the tree's nodes, leaves with 0 children; bytes are those of the records.
    path_shrink 'TREE' leaves out nodes with one child (the child stands for them); node_shrink False adds empty
    children."""
    found = leaves(deepest, opclass, depth)
    last = found.select(F.col("leaf").alias("prefix"), "level", "n", "bytes", F.lit(0).cast("long").alias("children"))
    inner = above(found)
    if opclass.params.node_shrink:
        parents = [x.where("prefix <> ''").select(F.substring("prefix", F.lit(1), F.col("level") - 1).alias("_up")) for x in (inner, last)]
        kids = reduce(DataFrame.union, parents).groupBy("_up").agg(F.count("*").alias("children"))
        inner = inner.join(kids, F.col("prefix") == F.col("_up")).select("prefix", "level", "n", "bytes", "children")
    else:
        inner = inner.withColumn("children", F.lit(len(opclass.symbols)).cast("long"))
    if opclass.params.path_shrink == "TREE":
        inner = inner.where("children > 1 or prefix = ''")
    out = inner.unionByName(last)
    return out if opclass.params.node_shrink else out.unionByName(empty_children(inner, out, opclass))


def empty_children(inner: DataFrame, held: DataFrame, opclass: OpClass) -> DataFrame:
    """The children of inner nodes that hold nothing."""
    all_kids = inner.select(F.explode(F.array(*(F.concat("prefix", F.lit(s)) for s in opclass.symbols))).alias("prefix"), (F.col("level") + 1).alias("level"))
    none = all_kids.join(held.select(F.col("prefix").alias("_h")), F.col("prefix") == F.col("_h"), "left_anti")
    return none.select("prefix", "level", *(F.lit(0).cast("long").alias(c) for c in ("n", "bytes", "children")))


def subtree_bytes(catalog: DataFrame, opclass: OpClass) -> DataFrame:
    """(prefix, level, n, size) of a catalog's nodes: the bytes of the records, and of all nodes, in the subtree."""
    own = F.lit(NODE_BYTES + opclass.predicate_bytes)
    each = catalog.select(F.col("prefix").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("level"))).alias("_l"))
    below = each.groupBy(F.substring("_p", F.lit(1), F.col("_l")).alias("_top"), F.col("_l")).agg(F.count("*").alias("_nodes"))
    out = catalog.join(below, (F.col("prefix") == F.col("_top")) & (F.col("level") == F.col("_l")))
    return out.select("prefix", "level", "n", (F.col("bytes") + F.col("_nodes") * own).alias("size"))


def preorder(catalog: DataFrame) -> DataFrame:
    """(place, prefix): from 1, parents before children, children in symbol order."""
    return with_place(catalog.select("prefix"), "prefix").select((F.col("place") + 1).alias("place"), "prefix")
