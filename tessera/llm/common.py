"""Shared parts of the training-data operators: shared-folder tables, Arrow text access, word hashing
and the two-way cell exchange."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..sources.shared import cut, shared_dir  # noqa: F401

#: Rows without a doc_id take part as this id, which sorts before all others.
NULL_ID = -(2**63)

#: At most so many bytes of text are vectorised at once (one longer text is taken alone).
CHUNK_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Python workers that this driver's session starts find this package where it lies, unless it's installed or
    was sent with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def kept(key, make):
    """What a worker keeps from task to task, such as a model: of one operator at a time, so that those of a pipeline
    don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def n_parts(spark: SparkSession) -> int:
    """The session's shuffle partitions: the one knob that follows the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_or_lowest(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


# ---- text in Arrow batches -------------------------------------------------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of texts with about limit bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Odd factors, a start for each of two hash functions, and the bytes that k characters of an eight take.
_START = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_FACTORS = ((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)), (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of some texts: byte spans, the text each lies in, and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        """is_word: for each byte value, whether it belongs to words."""
        self.raw, base = raw, offsets - offsets[0]
        inside = is_word[raw]
        n = len(raw)
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[base[:-1]] = False
        self.start = np.flatnonzero(inside & ~before[:n])
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[base[1:]] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        #: words of text i are first[i]:first[i+1]
        self.first = np.searchsorted(self.start, base)
        self.text = np.repeat(np.arange(len(base) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """Hashes of the words' bytes, taken eight at a time. Every step passes through mix, so words can't be made
        to collide by what cancels out in a sum. which: 0 or 1, two functions that have nothing to do with each other."""
        size = self.end - self.start
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.raw) + 1, "<u8", padded, strides=(1,))
        h = mix(size.astype(np.uint64) * _START[which])
        at, where, left = np.arange(len(size)), self.start, size
        for _ in range(LONG_WORD // 8):
            h[at] = mix(h[at] ^ (eight[where] & _KEEP[np.minimum(left, 8)]))
            more = left > 8
            at, where, left = at[more], where[more] + 8, left[more] - 8
            if not len(at):
                break
        for i in at.tolist():
            h[i] = xxh64_intdigest(self.raw[self.start[i] : self.end[i]].tobytes(), which)
        return h

    def windows(self, k: int) -> np.ndarray:
        """The word indices at which k consecutive words of one text start."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :])


def window_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash for each run of k word hashes (runs over text borders too), from those of runs of 1, 2, 4, ... words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    first, second = _FACTORS[which]
    done, out, run, size = 0, None, words, 1
    while True:
        if k & size:
            m = len(words) - done - size + 1
            out = run if out is None else mix(out[:m] * first + run[done : done + m] * second)
            done += size
        if done == k:
            return out[:n]
        run = mix(run[:-size] * first + run[size:] * second)
        size *= 2


# ---- two-way cell exchange ---------------------------------------------------------------------------------------
#
# Sources hold hashes; some question about equal hashes anywhere is answered bucket by bucket and the answer goes
# back to the sources that asked. Cells are (bucket, 32 bits). A source sends its cells as one packed blob a bucket, 2 to
# 4 bytes a cell instead of a row. Sources and buckets hold what a task can hold, whatever the session's partitions.

#: There are so many buckets at least.
LEAST_BUCKETS = 64


def fan_out(spark: SparkSession, amount: int, per_source: int, per_bucket: int) -> tuple[int, int]:
    """(sources, buckets) of an exchange of so much (bytes, fingerprints): per_source and per_bucket at most, but more
    sources, up to three for each of the session's partitions, where each still has a sixty-fourth of that. Buckets
    stay LEAST_BUCKETS until they are full: the blobs then grow as the sources do, so as the input."""
    sources = max(-(-amount // per_source), min(3 * n_parts(spark), -(-64 * amount // per_source)), 1)
    return sources, max(LEAST_BUCKETS, -(-amount // per_bucket))


def to_sources(rows: DataFrame, sources: int) -> DataFrame:
    """rows dealt by column src, three sources to a partition."""
    return rows.repartition(max(2, -(-sources // 3)), "src")


def to_buckets(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows dealt by the bucket in column key (first of all columns), bucket after bucket: for runs()."""
    return rows.repartitionById(parts, F.pmod(F.col(key), F.lit(parts)).cast("int")).sortWithinPartitions(key)


def runs(batches):
    """(bucket, its rows without the bucket): one bucket at a time is held, whatever a partition has."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield now, rows


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(33)) % np.uint64(buckets)


def pack_cells(cells: np.ndarray) -> bytes:
    """Sorted uint32, with repeats: counts by the leading k bits, then the other bits in whole bytes and a nibble. k is
    what makes the blob smallest, so a cell takes 2 to 4 bytes, fewer the more there are."""
    n = len(cells)
    k = min((16, 12, 8, 4, 0), key=lambda k: (1 << k) + n * (32 - k) / 8)
    counts = np.bincount(cells >> np.uint32(32 - k), minlength=1 << k) if k else np.array([n])
    wide = counts.max() > 255
    low = cells.astype("<u4").view(np.uint8).reshape(-1, 4)
    out = [bytes([k | wide << 7]), counts.astype("<u4" if wide else np.uint8).tobytes(), np.ascontiguousarray(low[:, : (32 - k) // 8]).tobytes()]
    if k % 8:
        half = np.zeros((n + 1) // 2 * 2, np.uint8)
        half[:n] = low[:, (32 - k) // 8] & 15
        out.append((half[::2] | half[1::2] << 4).tobytes())
    return b"".join(out)


def unpack_cells(blob: bytes) -> np.ndarray:
    k, kind = blob[0] & 127, np.dtype("<u4") if blob[0] & 128 else np.dtype(np.uint8)
    counts = np.frombuffer(blob, kind, 1 << k, 1)
    at, n, whole = 1 + counts.nbytes, int(counts.sum(dtype=np.int64)), (32 - k) // 8
    low = np.zeros((n, 4), np.uint8)
    low[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, at).reshape(-1, whole)
    if k % 8:
        half = np.frombuffer(blob, np.uint8, (n + 1) // 2, at + n * whole)
        low[::2, whole] = (half & 15)[: (n + 1) // 2]
        low[1::2, whole] = (half >> 4)[: n // 2]
    cells = low.view("<u4").ravel()
    return cells | np.repeat(np.arange(1 << k, dtype=np.uint32) << np.uint32(32 - k), counts) if k else cells


def cell_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash's bucket and cell as one number."""
    return (bucket_of(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def cells_by_bucket(key: np.ndarray, buckets: int):
    """(bucket, sorted cells) of cell keys, which are sorted in place; a cell that occurs more often is kept twice, as
    counts of two are enough."""
    key.sort()
    if len(key) > 2:
        keep = np.ones(len(key), bool)
        keep[2:] = key[2:] != key[:-2]
        key = key[keep]
    edges = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), (key[edges[b] : edges[b + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """Longs with their first bytes together, then their second ones: what is equal in most compresses well."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in the set; both are hashes, so their low bits tell most of the others apart."""
    out = np.zeros(len(values), bool)
    if not len(sorted_set) or not len(values):
        return out
    low = np.uint64((1 << (16 * len(sorted_set)).bit_length()) - 1)
    near = np.zeros(int(low) + 1, bool)
    near[sorted_set & low] = True
    maybe = np.flatnonzero(near[values & low])
    at = np.searchsorted(sorted_set, values[maybe])
    at[at == len(sorted_set)] = 0
    out[maybe] = sorted_set[at] == values[maybe]
    return out


CELLS = "bucket int, src long, blob binary"
_cells = pa.schema([("bucket", pa.int32()), ("src", pa.int64()), ("blob", pa.binary())])


def cell_rows(per_source, buckets: int):
    """Record batches of CELLS for (src, cell keys) pairs."""
    for src, key in per_source:
        rows = [(b, pack_cells(c)) for b, c in cells_by_bucket(key, buckets)]
        if rows:
            yield pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([src] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=_cells)


def _repeated(batches):
    """For the blobs of whole buckets: those cells of each blob that occur twice or more in their bucket."""
    for b, blobs in runs(batches):
        cells = np.concatenate([unpack_cells(x) for _, x in blobs])
        cells.sort()
        again = np.unique(cells[1:][cells[1:] == cells[:-1]])
        del cells
        if not len(again):
            continue
        src, out = [], []
        for s, x in blobs:
            mine = unpack_cells(x)
            if len(mine := np.unique(mine[is_in(mine, again)])):
                src.append(s)
                out.append(pack_cells(mine))
        yield pa.record_batch([pa.array([b] * len(src), pa.int32()), pa.array(src, pa.int64()), pa.array(out, pa.binary())], schema=_cells)


def repeated_cells(cells: DataFrame, parts: int) -> DataFrame:
    """CELLS to CELLS: back to each source, those of its cells that occur more than once anywhere."""
    return to_buckets(cells, "bucket", parts).mapInArrow(_repeated, CELLS)


# ---- sorted numbers in few bits ------------------------------------------------------------------------------------


def pack_sorted(values: np.ndarray, universe: int) -> bytes:
    """Sorted distinct numbers below universe: the low bits of each as they are, the high ones as a bitmap of steps,
    which takes about 2 + log2(universe / n) bits a number."""
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    steps = np.zeros(n + (universe >> low) + 1, np.uint8)
    steps[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=low, bitorder="little") if low else np.zeros(0, np.uint8)
    return bytes([low]) + n.to_bytes(4, "little") + np.packbits(bits.ravel()).tobytes() + np.packbits(steps).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    low, n = blob[0], int.from_bytes(blob[1:5], "little")
    whole = -(-n * low // 8)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=5 + whole)))[:n] - np.arange(n)
    out = high.astype(np.uint64) << np.uint64(low)
    if low:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, whole, 5), count=n * low).reshape(n, low)
        eight = np.zeros((n, 8), np.uint8)
        eight[:, : -(-low // 8)] = np.packbits(bits, axis=1, bitorder="little")
        out |= eight.view("<u8").ravel()
    return out
