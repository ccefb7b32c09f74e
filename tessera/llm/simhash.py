"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common as C
from .components import components

WORDS, RADIUS, SEED = 4, 4, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text: bit b is 1 if over half of its shingles' XXH64 have it."""
    w = text.translate(_LOWER).split()  # on space and \\x09-\\x0D, as bytes.split() does
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate([[0], end[: -words] + 1]).tolist()
    h = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(start, end[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        raw, at = C.utf8(batch.column("text"))
        data = raw.tobytes()
        fp = np.array([fingerprint(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; null and empty texts and texts without words have fingerprint 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def ball(radius: int) -> np.ndarray:
    """Masks of all flips of at most radius of 64 bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def _variants(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    return (fps[:, None] ^ masks).ravel()


#: Fingerprints of a source, and those whose variants a bucket holds.
SOURCE_FPS, BUCKET_FPS = 4096, 16384
_EDGES = "a long, b long"
_MET = "at int, own boolean, variant binary, fp binary, node binary"


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (fp long, node long, one row a fingerprint) to edges (a, b) between nodes: fingerprints within radius
    are connected, and each edge is such a pair.

    Every fingerprint emits all variants within radius/2 flips (2081 for radius 4). They meet in two steps: packed
    32-bit cells of the variants find out which can occur twice; only those are emitted again, in full, grouped
    exactly, and the pairs verified. All fingerprints that share a variant lie within the radius of each other, so a
    group gives a star to its smallest node, not all pairs; a source sends one row a variant, so a popular variant
    costs at most one row a source."""
    spark, half = nodes.sparkSession, radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")
    sources, buckets = C.fan_out(spark, nodes.count(), SOURCE_FPS, BUCKET_FPS)
    nodes = C.to_sources(nodes.select("fp", "node", F.pmod(F.xxhash64("fp"), F.lit(sources)).alias("src")), sources)

    def emit(batches):
        masks, held = ball(half), {}
        for batch in batches:
            fp, src = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("src").to_numpy(zero_copy_only=False)
            for s in np.unique(src):
                held.setdefault(int(s), []).append(fp[src == s])

        def keys(fps: np.ndarray) -> np.ndarray:
            out = np.empty(len(fps) * len(masks), np.uint64)
            for i in range(0, len(fps), 256):
                v = C.mix(_variants(fps[i : i + 256], masks))
                out[i * len(masks) : i * len(masks) + len(v)] = C.cell_key(v, buckets)
            return out

        yield from C.cell_rows(((s, keys(np.concatenate(held[s]))) for s in sorted(held)), buckets)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        types = {"at": pa.int32(), "own": pa.bool_(), **dict.fromkeys(("variant", "fp", "node"), pa.binary())}
        if not right.num_rows or not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in types.items()})
        masks = ball(half)
        fps, node = left["fp"].to_numpy().view(np.uint64), left["node"].to_numpy()
        cells = [[], [], []]
        keys = np.sort(np.concatenate([np.uint64(b << 32) | C.unpack_cells(x).astype(np.uint64) for b, x in zip(right["bucket"].to_pylist(), right["blob"].to_pylist())]))
        for i in range(0, len(fps), 256):
            v = _variants(fps[i : i + 256], masks)
            h = C.mix(v)
            hit = np.flatnonzero(C.is_in(C.cell_key(h, buckets), keys))
            who = i + hit // len(masks)
            for held, x in zip(cells, (v[hit], fps[who], node[who])):
                held.append(x)
        v, f, n = (np.concatenate(x) for x in cells)
        order = np.lexsort((n, v))
        v, f, n = v[order], f[order], n[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        # links inside this source: to the smallest node of the variant; across sources that node alone goes on
        own = _star(f, n, head, radius)
        v, f, n = v[new], f[new], n[new]
        b = C.bucket_of(C.mix(v), buckets)
        rows = [(int(k), False, *(x[b == k].tobytes() for x in (v, f, n))) for k in np.unique(b)]
        # the source's own links need no partner: any bucket passes them on
        rows.append((left["src"][0].as_py() % buckets, True, own[0].tobytes(), own[1].tobytes(), b""))
        return pa.table({k: pa.array(x, t) for (k, t), x in zip(types.items(), zip(*rows))})

    def join(batches):
        for _, rows in C.runs(batches):
            for _, a, b, _ in filter(lambda r: r[0], rows):
                yield pa.record_batch([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["a", "b"])
            v, f, n = (np.frombuffer(b"".join(r[i] for r in rows if not r[0]), t) for i, t in ((1, np.uint64), (2, np.uint64), (3, np.int64)))
            if not len(v):
                continue
            order = np.lexsort((n, v))
            v, f, n = v[order], f[order], n[order]
            new = np.ones(len(v), bool)
            new[1:] = v[1:] != v[:-1]
            a, b = _star(f, n, np.flatnonzero(new)[np.cumsum(new) - 1], radius)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    parts = C.n_parts(spark)
    returned = C.repeated_cells(nodes.mapInArrow(emit, C.CELLS), parts)
    met = nodes.groupBy("src").cogroup(returned.groupBy("src")).applyInArrow(meet, _MET)
    return C.to_buckets(met, "at", parts).mapInArrow(join, _EDGES).distinct()


def _star(fp: np.ndarray, node: np.ndarray, head: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified distinct edges from each entry to the entry at head."""
    far = np.bitwise_count(fp ^ fp[head])
    at = np.flatnonzero((far <= radius) & (node != node[head]))
    pairs = np.unique(np.stack([node[at], node[head[at]]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


# ---- short fingerprints, for texts that differ in more bits than a ball of 64 can hold -----------------------------------

#: Two texts are candidates if one of BLOCKS SimHashes of 32 bits, each of its own hash function, differs in 2 bits at
#: most. A ball takes the flips of the WEAK bits whose counts are nearest to half: the others hardly ever differ.
BLOCKS, WEAK = 96, 12
#: Shingles that are counted at once, and such runs that 16 bits can sum.
_RUN, _RUNS = 15, 4096
_OF_BLOCK = C.mix(np.arange(1, BLOCKS // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLOCK_ROWS = "k long, blocks binary, weak binary, sign array<long>"


def _counts(x: np.ndarray, begin: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts how many of its hashes have each of 64 bits. x: _RUN rows whose columns are runs of hashes (0
    beyond a text's last one), which are added as bit planes; begin and text: parts of at most _RUNS runs, and their
    texts."""
    planes = [list(x), [], [], []]
    for low, high in zip(planes, planes[1:]):
        while len(low) > 1:
            a, b, c = low.pop(), low.pop(), low.pop()
            d = a ^ b
            low.append(d ^ c)
            np.bitwise_and(d, c, out=d)
            high.append(np.bitwise_or(np.bitwise_and(a, b), d, out=d))
    four = np.unpackbits(planes[3][0].astype("<u8", copy=False).view(np.uint8), bitorder="little")
    for p in planes[2::-1]:
        four += four
        four += np.unpackbits(p[0].astype("<u8", copy=False).view(np.uint8), bitorder="little")
    four, even = four.view("<u8").reshape(-1, 8), np.uint64(0x00FF00FF00FF00FF)
    part = np.empty((len(begin), 64), np.int64)
    for i, lanes in enumerate((four & even, (four >> np.uint64(8)) & even)):
        part[:, i::2] = np.add.reduceat(lanes, begin, axis=0).astype("<u8").view("<u2").reshape(-1, 32)
    if len(text) == n:
        return part
    return np.add.reduceat(part, np.searchsorted(text, np.arange(n)), axis=0)


def blocks(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BLOCKS short SimHashes of each text, and as masks the weak bits of each. h: the hashes of the texts' distinct
    shingles, one at least each, text after text from begin on."""
    n, size = len(begin), np.diff(begin, append=len(h))
    runs = -(-size // _RUN)
    of = np.repeat(np.arange(n), runs)
    run = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = run * _RUN + np.arange(_RUN)[:, None]
    held = at < size[of]
    h = h[np.where(held, begin[of] + at, 0)]
    held = np.where(held, ~np.uint64(0), np.uint64(0))
    starts = np.flatnonzero(run % _RUNS == 0)
    values, weak = np.empty((n, BLOCKS), np.uint32), np.empty((n, BLOCKS), np.uint32)
    for r in range(BLOCKS // 2):
        ones = 2 * _counts(C.mix(h ^ _OF_BLOCK[r]) & held, starts, of[starts], n) - size[:, None]
        values[:, 2 * r : 2 * r + 2] = np.packbits(ones > 0, axis=1, bitorder="little").view("<u4")
        # of bits that are as near to half the lower one
        near = np.argpartition((np.abs(ones) * 32 + np.arange(64) % 32).reshape(n, 2, 32), WEAK, axis=2)[:, :, :WEAK]
        weak[:, 2 * r : 2 * r + 2] = (np.uint32(1) << near.astype(np.uint32)).sum(2, dtype=np.uint32)
    return values, weak


def _block_variants(values: np.ndarray, weak: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, place of its text) of all that a source's texts emit: each the block itself, and of those with an equal
    block one, another in each block, its flips. A variant is of one block."""
    variants, place = [], []
    for r in range(BLOCKS):
        v, salt = values[:, r].astype(np.uint64) | np.uint64(r << 32), C.mix(key ^ np.uint64(r + 1))
        order = np.lexsort((salt, v))
        one = order[np.diff(v[order], prepend=np.uint64(2**63)) != 0]
        bits = np.flatnonzero(np.unpackbits(weak[one, r].astype("<u4").view(np.uint8), bitorder="little")) % 32
        variants += [v, (v[one, None] ^ (np.uint64(1) << bits.reshape(-1, WEAK).astype(np.uint64))).ravel()]
        place += [np.arange(len(v)), np.repeat(one, WEAK)]
    return C.mix(np.concatenate(variants)), np.concatenate(place)


def _source(table) -> tuple[np.ndarray, ...]:
    """values, weak bits and keys of the rows of BLOCK_ROWS."""
    of = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), "<u4").reshape(-1, BLOCKS)
    return of("blocks"), of("weak"), table["k"].to_numpy().view(np.uint64)


def meetings(signed: DataFrame) -> DataFrame:
    """(k, band, sign) for the texts of signed (BLOCK_ROWS, one a k): texts with a band in common hold one variant of a
    short fingerprint, so differ in two of its bits at most. Like links: packed cells find out which variants can occur
    twice, only those become rows."""
    spark = signed.sparkSession
    sources, buckets = C.fan_out(spark, signed.count(), SOURCE_FPS // 2, BUCKET_FPS)
    nodes = signed.withColumn("src", F.pmod(F.xxhash64("k"), F.lit(sources)))

    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cells = list(C.cell_rows([(key[0].as_py(), C.cell_key(_block_variants(*_source(table))[0], buckets))], buckets))
        return pa.Table.from_batches(cells)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        band, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            keys = np.sort(np.concatenate([np.uint64(b << 32) | C.unpack_cells(x).astype(np.uint64) for b, x in zip(right["bucket"].to_pylist(), right["blob"].to_pylist())]))
            band, at = _block_variants(*_source(left))
            hit = np.flatnonzero(C.is_in(C.cell_key(band, buckets), keys))
            band, at = band[hit], at[hit]
        return pa.table([left["k"].take(pa.array(at)), pa.array(band.view(np.int64)), left["sign"].take(pa.array(at))], names=["k", "band", "sign"])

    returned = C.repeated_cells(nodes.groupBy("src").applyInArrow(emit, C.CELLS), C.n_parts(spark))
    return nodes.groupBy("src").cogroup(returned.groupBy("src")).applyInArrow(meet, "k long, band long, sign array<long>")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of at most radius differing bits, itself included.
    Rows without words share fingerprint 0 and are linked like any other. Repeated rows keep their rows and share a
    component. A null doc_id keeps its row: it counts as the lowest id and comes back as null, also as component_id.
    An empty table gives an empty one."""
    fps = C.cut(fingerprints(docs).select("doc_id", "fp", C.id_or_lowest().alias("_id")))
    nodes = C.cut(fps.groupBy("fp").agg(F.min("_id").alias("node")).select("fp", "node"))
    found = components(links(nodes, radius)).withColumnRenamed("node", "_node")
    # two fingerprints can share their smallest doc_id only where that doc_id is repeated with different texts
    label = nodes.join(found, F.col("node") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component"))
    out = fps.join(label, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != C.NULL_ID, F.col("component")).alias("component_id"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
