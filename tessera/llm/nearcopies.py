"""Near copies by the Jaccard similarity of word shingles: balls of short SimHashes find the candidates, the shingles
decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .simhash import BLOCK_ROWS, blocks, meetings

#: Texts are near copies if the sets of their shingles of WORDS words have this Jaccard similarity or more.
WORDS, LIKE = 5, 0.8
#: The first SIGN x 64 bits of the short fingerprints are a text's sign. At similarity 0.8 each bit differs with a chance of
#: 0.15, so fewer than 1 in 100,000 pairs differ in more than FAR; of those at 0.55 nearly all do.
SIGN, FAR = 12, 170
#: Rounds in which a text is compared with one other at most.
HOOKS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def text_key(text=None):
    """The key by which a text is decided upon; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each shingle, by text. Words are split as SimHash does; a text of fewer words than a shingle is
    one shingle, one without words too."""
    words = C.Words(_LOWER[raw], at, _IS_WORD)
    h, size = words.hashes(), np.diff(words.first)
    x = words.windows(WORDS)
    hashes, text = [C.window_hashes(h, WORDS)[x]], [words.text[x]]
    for n in range(1, WORDS):
        few = np.flatnonzero(size == n)
        hashes.append(C.window_hashes(h, n)[words.first[few]] if len(few) else np.zeros(0, np.uint64))
        text.append(few)
    none = np.flatnonzero(size == 0)
    hashes, text = np.concatenate([*hashes, np.zeros(len(none), np.uint64)]), np.concatenate([*text, none])
    by = np.argsort(text, kind="stable")
    return hashes[by], text[by]


def _signed(batches):
    for batch in batches:
        raw, at = C.utf8(batch.column("text"))
        key = batch.column("k").to_numpy()
        for i, j in C.chunks(at):
            h, text = shingles(raw[at[i] : at[j]], at[i : j + 1])
            by = np.lexsort((h, text))
            h, text = h[by], text[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[new], text[new]
            values, weak = blocks(h, np.searchsorted(text, np.arange(j - i)))
            sign = np.ascontiguousarray(values[:, : 2 * SIGN]).view(np.int64)
            one = np.unique(key[i:j], return_index=True)[1]
            yield pa.record_batch(
                [pa.array(key[i:j][one]), *(pa.array([r.tobytes() for r in x[one].astype("<u4")], pa.binary()) for x in (values, weak)), pa.array(list(sign[one]), pa.list_(pa.int64()))],
                names=["k", "blocks", "weak", "sign"],
            )


def _verified(batches):
    for batch in batches:
        sides = []
        for name in ("text_a", "text_b"):
            raw, at = C.utf8(batch.column(name))
            sides.append([np.unique(shingles(raw[i:j], np.array([0, j - i]))[0]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
        ok = []
        for a, b in zip(*sides):
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(both >= LIKE * (len(a) + len(b) - both))
        yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))


def _open(now: DataFrame) -> DataFrame:
    """now without the groups that are connected whole and the texts that are in no other: they give no pairs any more."""
    band = Window.partitionBy("band")
    rows = now.select("k", "of", F.explode("bands").alias("band")).select("k", "band", F.min("of").over(band).alias("x"), F.max("of").over(band).alias("y"))
    left = rows.where("x <> y").groupBy(F.col("k").alias("_k")).agg(F.collect_set("band").alias("bands"))
    return now.drop("bands").join(left, F.col("k") == F.col("_k")).select("k", "sign", "bands", "of")


def near_copies(docs: DataFrame) -> DataFrame:
    """(k, component) for each distinct text of docs (text, any others) that is a near copy of another one: k is its
    text_key, component the least k reachable over pairs of similarity LIKE or more that were compared. Every link is
    verified on the texts themselves.

    Candidates come from SimHashes over the same shingles: texts with a variant of one in common are a group (its band).
    A round compares members of a group with one of them, its leader: never all pairs, so a group of any size costs a row a
    member at most, and texts are read only where the signs are alike. In the first HOOKS rounds each text is compared with
    the nearest of its groups' leaders, which connects most copies of a crowd at a pair a text. The next ones compare with
    all of them, in the groups that aren't connected whole, each group with its own leader; the last is the one that
    connects nothing new. What is connected has one label, and what a round finds connects labels, not texts: that takes
    few steps, and the driver keeps something of each."""
    texts = docs.select(text_key().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    signed = C.cut(texts.mapInArrow(_signed, BLOCK_ROWS).dropDuplicates(["k"]))
    # a row a text, with all its groups: no more than its variants
    now = C.cut(meetings(signed).groupBy("k").agg(F.first("sign").alias("sign"), F.collect_set("band").alias("bands"), F.first("k").alias("of")))
    stars, seen, turn = None, None, 0
    while True:
        hooks = turn < HOOKS
        rank = F.xxhash64("k", F.lit(turn)) if hooks else F.xxhash64("k", "band", F.lit(turn))
        lead = F.first(F.struct("k", "of", "sign")).over(Window.partitionBy("band").orderBy(rank, "k"))
        far = sum(F.bit_count(F.col("sign")[i].bitwiseXOR(F.col("l.sign")[i])) for i in range(SIGN))
        met = now.select("k", "of", "sign", F.explode("bands").alias("band")).withColumn("l", lead).where((F.col("of") != F.col("l.of")) & (far <= FAR))
        if hooks:
            met = met.groupBy("k", "of").agg(F.min_by("l", F.struct(far, F.xxhash64("l.k", F.lit(turn)))).alias("l"))
        pairs = met.select(F.least("k", "l.k").alias("a"), F.greatest("k", "l.k").alias("b"), F.least("of", "l.of").alias("x"), F.greatest("of", "l.of").alias("y")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = C.cut(pairs)
        # texts are read again, but only those that are compared are moved
        ends = pairs.select(F.col("a").alias("_k")).union(pairs.select("b")).distinct()
        read = C.cut(texts.join(ends, F.col("k") == F.col("_k"), "left_semi").dropDuplicates(["k"]))
        a, b = (read.select(F.col("k").alias(f"k_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = pairs.join(a, F.col("a") == F.col("k_a")).join(b, F.col("b") == F.col("k_b")).select("x", "y", "text_a", "text_b")
        found = C.cut(both.mapInArrow(_verified, "x long, y long"))
        if not hooks and found.isEmpty():
            return components(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))).withColumnRenamed("node", "k")
        # components of components: what earlier rounds connected is one node
        label = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
        stars = label if stars is None else stars.union(label)
        now = C.cut(now.join(label, F.col("of") == F.col("node"), "left").select("k", "sign", "bands", F.coalesce("component", "of").alias("of")))
        if turn == 0:
            now = C.cut(_open(now))
        seen = pairs.select("a", "b") if seen is None else seen.union(pairs.select("a", "b"))
        turn += 1
        # what the round has shuffled lies on disk until the driver collects its garbage
        texts.sparkSession.sparkContext._jvm.System.gc()
