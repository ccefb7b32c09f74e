"""K-d tree sharding by distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 24
#: Metadata of a document that its text decides, so that equal texts lie at one point.
DIMENSIONS = ("size", "n_chars", "n_lines", "n_marks")
#: Bins of a round's histogram of a node; a cut is accepted within this share of a shard's target bytes.
BINS, TOLERANCE = 1024, 0.0025
ALL = (-(2**63), 2**63 - 1)


@dataclass
class Node:
    shards: int
    first: int  # the number of its first shard
    bytes: int = 0
    axis: str = ""
    cut: list = field(default_factory=list)  # rows at or above it, compared in order, go right
    left: "Node | None" = None
    right: "Node | None" = None

    def leaves(self) -> list["Node"]:
        return self.left.leaves() + self.right.leaves() if self.left else [self]


def _at_or_above(keys: list[str], cut: list) -> Column:
    """(keys) >= (cut), compared in order; the cut may have fewer parts."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, cut))):
        out = (F.col(key) > value) | ((F.col(key) == value) & out)
    return out


def _keys(axis: str) -> list[str]:
    return [axis, "text_hash", "_id"]


def shard_of(node: Node) -> Column:
    """The tree as nested CASE expressions: the number of a row's leaf's first shard."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(_at_or_above(_keys(node.axis), node.cut), shard_of(node.right)).otherwise(shard_of(node.left))


def grow(meta: DataFrame, shards: int = SHARDS, dimensions=DIMENSIONS, tolerance: float = TOLERANCE) -> Node:
    """The tree over meta (the dimensions as longs, text_hash, _id and size).

    Every node with more than one shard is cut where its bytes divide as its shards do, along that dimension in which
    it's widest as a share of the whole table's width. All nodes of a level are cut together: a round gives a histogram
    of bytes per node (nodes x BINS rows at most reach the driver), the bin that holds the median is the next round's
    range. Where one value of the dimension holds more bytes than the tolerance, the text's hash divides it, and where
    one text does, the doc_id: equal texts part only if a group of them is too large for either side. Where the row at
    the median is itself larger than the tolerance, the next widest dimension is tried, at last the text's hash, and
    the cut nearest to the median is taken."""
    total, *ends = meta.agg(F.sum("size"), *(f(d) for d in dimensions for f in (F.min, F.max))).first()
    root = Node(shards, 0, total or 0)
    if not total:
        return root
    whole = {d: max(1, ends[2 * i + 1] - ends[2 * i]) for i, d in enumerate(dimensions)}
    slack = tolerance * total / shards
    while open_nodes := [n for n in root.leaves() if n.shards > 1]:
        at = meta.withColumn("node", shard_of(root)).where(F.col("node").isin([n.first for n in open_nodes]))
        wide = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *(f(d).alias(f"{k}_{d}") for d in dimensions for k, f in (("lo", F.min), ("hi", F.max)))).collect()}
        small = [n.first for n in open_nodes if n.first in wide and wide[n.first]["n"] <= BINS]
        if small:  # few rows: the driver takes them all and finishes these nodes
            rows: dict[int, list] = {}
            for r in at.where(F.col("node").isin(small)).select("node", *dimensions, "text_hash", "_id", "size").collect():
                rows.setdefault(r["node"], []).append(r)
            for n in open_nodes:
                if n.first in rows:
                    _finish(n, rows[n.first], dimensions, whole, slack)
        work = {}
        for n in open_nodes:
            if n.left:
                continue
            if (r := wide.get(n.first)) is None:  # no rows: everything to the left, which is empty too
                _split(n, dimensions[0], [0], 0)
                continue
            n.bytes = r["bytes"]
            work[n.first] = _search(n, {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in dimensions}, whole, r["n"])
        while work:
            for first, w in _round(at, work).items():
                if (done := _advance(work[first], w, slack)) is not None:
                    _split(work.pop(first)["node"], *done)
    return root


def _search(n: Node, ends: dict, whole: dict, rows: int) -> dict:
    """What a node looks for: its axes, widest first and at last the text's hash, and the bytes below its cut."""
    order = list(whole)
    axes = sorted(order, key=lambda d: (-(ends[d][1] - ends[d][0]) / whole[d], order.index(d))) + ["text_hash"]
    w = {"node": n, "axes": axes, "n": rows, "found": [], "ends": ends, "target": n.bytes * (n.shards // 2) / n.shards}
    _start(w)
    return w


def _finish(n: Node, rows: list, dimensions, whole: dict, slack: float) -> None:
    """Grows a node of few rows to its leaves."""
    if n.shards == 1:
        return
    if not rows:
        _split(n, dimensions[0], [0], 0)
    else:
        n.bytes = sum(r["size"] for r in rows)
        w = _search(n, {d: (min(r[d] for r in rows), max(r[d] for r in rows)) for d in dimensions}, whole, len(rows))
        done = None
        while done is None:
            held: dict[tuple, int] = {}
            for r in rows:
                key = tuple(r[k] for k in _keys(w["axis"]))
                held[key] = held.get(key, 0) + r["size"]
            done = _advance(w, sorted(held.items()), slack)
        _split(n, *done)
    right = [bool(n.cut) and tuple(r[k] for k in _keys(n.axis))[: len(n.cut)] >= tuple(n.cut) for r in rows]
    _finish(n.left, [r for r, x in zip(rows, right) if not x], dimensions, whole, slack)
    _finish(n.right, [r for r, x in zip(rows, right) if x], dimensions, whole, slack)


def _start(w: dict) -> None:
    """Looks at the whole range of the next axis."""
    axis = w["axes"].pop(0)
    lo, hi = w["ends"].get(axis, ALL)
    w |= {"axis": axis, "prefix": [], "lo": lo, "hi": hi, "below": 0, "rows": w["n"]}


def _split(n: Node, axis: str, cut: list, below: int) -> None:
    half = n.shards // 2
    n.axis, n.cut = axis, cut
    n.left, n.right = Node(half, n.first, below), Node(n.shards - half, n.first + half, n.bytes - below)


def _inside(w: dict) -> Column:
    """The rows of the range that a node now looks at."""
    keys = _keys(w["axis"])
    out = (F.col("node") == w["node"].first) & F.col(keys[len(w["prefix"])]).between(w["lo"], w["hi"])
    for k, v in zip(keys, w["prefix"]):
        out = out & (F.col(k) == v)
    return out


def _round(at: DataFrame, work: dict) -> dict[int, list]:
    """For each node its range by bin, in order, as (least value, largest value, bytes, rows); of a range of few rows
    the rows, as (keys, bytes)."""
    out: dict[int, list] = {first: [] for first in work}
    few = {first: w for first, w in work.items() if w["rows"] is not None and w["rows"] <= BINS}
    many = {first: w for first, w in work.items() if first not in few}
    if few:
        one = [F.when(F.col("node") == first, F.array(*_keys(w["axis"]))) for first, w in few.items()]
        rows = at.where(reduce(lambda a, b: a | b, map(_inside, few.values()))).select("node", F.coalesce(*one).alias("keys"), "size").groupBy("node", "keys").agg(F.sum("size").alias("bytes")).collect()
        for r in sorted(rows, key=lambda r: (r["node"], r["keys"])):
            out[r["node"]].append((r["keys"], r["bytes"]))
    if many:
        value = bins = F.lit(None)
        wide = "decimal(38,0)"
        for first, w in many.items():
            key, here = F.col(_keys(w["axis"])[len(w["prefix"])]), F.col("node") == first
            share = (key.cast(wide) - F.lit(w["lo"]).cast(wide)).cast("double") / float(w["hi"] - w["lo"] + 1)
            value, bins = F.when(here, key).otherwise(value), F.when(here, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(bins)
        rows = at.where(reduce(lambda a, b: a | b, map(_inside, many.values()))).groupBy("node", bins.alias("bin")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        for r in sorted(rows, key=lambda r: (r["node"], r["lo"])):
            out[r["node"]].append((r["lo"], r["hi"], r["bytes"], r["n"]))
    return out


def _advance(w: dict, found: list, slack: float) -> tuple[str, list, int] | None:
    """The axis, the cut and the bytes below it, if this round finds one; else the range for the next round is set."""
    target, level = w["target"], len(w["prefix"]) + 1
    if w["rows"] is not None and w["rows"] <= BINS:
        # (by how much too far, keys compared, cut, bytes below): of those near enough that which compares fewest keys
        cuts, below = [], w["below"]
        for i, (keys, held) in enumerate(found):
            deep = level if not i else next(k for k in range(3) if keys[k] != found[i - 1][0][k]) + 1
            cuts.append((abs(below - target), deep, list(keys[:deep]), below))
            below += held
        cuts.append((abs(below - target), level, w["prefix"] + [w["hi"] + 1], below))
        best = min([c for c in cuts if c[0] <= slack], key=lambda c: (c[1], c[0]), default=None) or min(cuts)
        w["found"].append((best[0], len(w["found"]), w["axis"], best[2], best[3]))
        if best[0] > slack and w["axes"]:
            return _start(w)
        return min(w["found"])[2:]
    below = w["below"]
    for i, (lo, hi, held, n) in enumerate(found):
        if below + held >= target or i == len(found) - 1:
            break
        below += held
    if abs(below - target) <= slack:
        return w["axis"], w["prefix"] + [lo], below
    if abs(below + held - target) <= slack or (lo == hi and level == 3):
        return w["axis"], w["prefix"] + [hi + 1], below + held
    if lo == hi and n > BINS:  # this one value is too large for either side
        w |= {"prefix": w["prefix"] + [lo], "lo": ALL[0], "hi": ALL[1], "below": below, "rows": n}
    else:
        w |= {"lo": lo, "hi": hi, "below": below, "rows": n}
    return None


def shard(docs: DataFrame, shards: int = SHARDS, dimensions=DIMENSIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ('bytes'), shard
    (0 to shards - 1, of near equal bytes), slot (gapless from 0 in each shard, by doc_id within hashed runs) and
    grown_shard (null: the law isn't 'key').

    Null texts have no bytes and count as empty; null doc_ids count as the lowest. Rows that repeat a doc_id and a
    text lie together. No rows: none. With fewer rows than shards some shards stay empty. A row is never divided, so
    a shard can be off by the largest row besides the tolerance."""
    parts = C.n_parts(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    meta = docs.select(
        "doc_id",
        C.id_or_lowest().alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.length(text).cast("long").alias("n_chars"),
        (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.translate(text, ".,;:!?|", ""))).cast("long").alias("n_marks"),
        F.xxhash64(text).alias("text_hash"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    meta = C.cut(meta)
    tree = grow(meta, shards, dimensions, tolerance)
    rows = meta.select("doc_id", "_id", "size", "text_crc32", shard_of(tree).cast("int").alias("shard"), F.pmod(F.xxhash64("_id", "text_hash"), F.lit(parts)).alias("run"))
    # slots: a shard's rows in `parts` runs, numbered each for itself, after the rows of the runs before
    offsets = rows.groupBy(F.col("shard").alias("_shard"), F.col("run").alias("_run")).agg(F.count("*").alias("n"))
    offsets = offsets.select("_shard", "_run", (F.sum("n").over(Window.partitionBy("_shard").orderBy("_run")) - F.col("n")).alias("before"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("shard", "run").orderBy("_id", "text_crc32")) - 1)
    rows = rows.join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("run") == F.col("_run")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_kd_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(C.table(spark, sf_dir, "documents"))
