"""Exact substring dedup of word windows behind a count-min prefilter."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 20
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


#: The sketch has DEPTH rows of counters, WIDE counters in each for every window that the texts may hold.
DEPTH, WIDE = 2, 8
#: Texts of a source, texts whose windows' counters a bucket holds, and bytes for each word (with its space) at least.
SOURCE_BYTES, BUCKET_BYTES, WORD_BYTES = 32 << 20, 64 << 20, 6


def _windows(texts, k: int, both: bool):
    """For chunks of texts: (first text, the words, window starts, their hashes, or None, their second hashes)."""
    raw, at = C.utf8(texts)
    for i, j in C.chunks(at):
        words = C.Words(raw[at[i] : at[j]], at[i : j + 1], _IS_WORD)
        where = words.windows(k)
        h = [C.window_hashes(words.hashes(x), k, x)[where] if len(where) else np.zeros(0, np.uint64) for x in range(1 + both)]
        yield i, words, where, h[0], h[1] if both else None


def _counters(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each hash in a row of 2^bits."""
    return C.mix(h + np.uint64(row)) >> np.uint64(64 - bits)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Which entries of sorted arrays begin a run of equal ones."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


_SKETCH = "at int, src int, cells binary, many binary"
_KNOWN = "at int, src int, cells binary"
_MET = "at int, src int, h1 binary, h2 binary, id binary, start binary, many binary"
_BACK = "at int, src int, n int, real binary, own binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def remove_repeats(docs: DataFrame, window: int = WINDOW, wide: int = WIDE, source_bytes: int = SOURCE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text, kept_sha256.

    A word goes if a window of `window` words covers it whose word sequence also starts earlier, at a smaller doc_id
    or earlier in the same document.

    1. Every source counts its windows in a count-min sketch: DEPTH rows, in each of which a hash of its own gives a
       window a counter; counters stop at two. Counters that aren't 0 are sent, by ranges of counters.
    2. The sources' sketches are merged range by range, and each source gets back those of its counters that came to
       two. A window's estimate is the least of its counters: it may be too high, never too low.
    3. Windows estimated at two or more are grouped exactly, by two 64-bit hashes that have nothing to do with each
       other; each source sends a sequence once, with its first place, so a sequence that a third of the corpus shares
       costs one entry a source. What comes back is two bits an entry, in the order in which it was sent: whether the
       sequence is repeated at all and whether its first place is the source's own.

    Null texts have no words. Rows that repeat a doc_id with the same text are at the same place and don't remove each
    other; a null doc_id counts as the lowest. Texts shorter than a window stay whole; words are joined by one space."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sources, buckets = C.fan_out(spark, size, source_bytes, bucket_bytes)
    buckets = 1 << (buckets - 1).bit_length()
    bits = max((wide * (size // WORD_BYTES + 1)).bit_length(), buckets.bit_length() + 3)
    span, top = (1 << bits) // buckets, np.uint64(65 - buckets.bit_length())
    parts = C.n_parts(spark)
    # rows of one doc_id (or of none) go to many sources
    src = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(sources)).cast("int")
    docs = C.to_sources(docs.select("doc_id", C.id_or_lowest().alias("_id"), "text", src.alias("src")), sources)

    def sketch(part: pa.Table) -> pa.Table:
        h, src, rows = np.concatenate([np.zeros(0, np.uint64), *(x[3] for x in _windows(part["text"], window, False))]), part["src"][0].as_py(), []
        for row in range(DEPTH):
            c = np.sort(_counters(h, row, bits))
            new = np.flatnonzero(_firsts(c))
            many = np.diff(np.append(new, len(c))) > 1
            c = c[new]
            edges = np.searchsorted(c, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(span))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                i, j = edges[b], edges[b + 1]
                rows.append((row * buckets + b, src, C.pack_sorted(c[i:j] - np.uint64(b * span), span), _bits(many[i:j])))
        return _table(_SKETCH, rows)

    def merge(batches):
        for at, rows in C.runs(batches):
            total, held = np.zeros(span, np.uint8), []
            for src, cells, many in rows:
                c = C.unpack_sorted(cells).astype(np.uint32)
                total[c] = np.minimum(total[c] + 1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(c)), 2)
                held.append((src, c))
            known = ((at, src, c[total[c] > 1].astype(np.uint64)) for src, c in held)
            yield from _table(_KNOWN, [(a, s, C.pack_sorted(c, span)) for a, s, c in known if len(c)]).to_batches()

    def estimated(part: pa.Table, known: pa.Table):
        """The windows of a source (its rows by _id) that are estimated at two or more, by hashes and place: h, g, _id,
        start and text. Buckets are ranges of h."""
        got = [[], [], [], []]
        cells: list[list] = [[np.zeros(0, np.uint64)] for _ in range(DEPTH)]
        for at, c in sorted(zip(known["at"].to_pylist(), known["cells"].to_pylist())):
            cells[at // buckets].append(C.unpack_sorted(c) + np.uint64(at % buckets * span))
        cells = [np.concatenate(c) for c in cells]
        for i, words, where, h, g in _windows(part["text"], window, True) if len(cells[0]) else ():
            hit = np.arange(len(h))
            for row in range(DEPTH):
                hit = hit[C.is_in(_counters(h[hit], row, bits), cells[row])]
            text = words.text[where[hit]]
            for held, x in zip(got, (h[hit], g[hit], where[hit] - words.first[text], i + text)):
                held.append(x)
        h, g, s, t = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.uint64, np.uint64, np.int64, np.int64), got))
        d = part["_id"].to_numpy()[t]
        order = np.argsort(h, kind="stable")  # windows come by place
        if ((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])).any():
            order = np.lexsort((s, d, g, h))
        return tuple(x[order] for x in (h, g, d, s, t))

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            h, g, d, s, _ = estimated(left.sort_by("_id"), right)
            new = np.flatnonzero(_firsts(h, g))
            many = np.diff(np.append(new, len(h))) > 1
            h, g, d, s = (x[new] for x in (h, g, d, s))
            edges, src = np.searchsorted(h >> top, np.arange(buckets + 1, dtype=np.uint64)), left["src"][0].as_py()
            for k in np.flatnonzero(np.diff(edges)).tolist():
                i, j = edges[k], edges[k + 1]
                rows.append((k, src, h[i:j].tobytes(), g[i:j].tobytes(), C.planes(d[i:j]), C.planes(s[i:j]), _bits(many[i:j])))
        return _table(_MET, rows)

    def first(batches):
        for at, rows in C.runs(batches):
            sizes = [len(r[1]) // 8 for r in rows]
            h, g = (np.frombuffer(b"".join(r[i] for r in rows), np.uint64) for i in (1, 2))
            d, s = (np.concatenate([C.unplanes(r[i]) for r in rows]) for i in (3, 4))
            many = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=n) for r, n in zip(rows, sizes)]).astype(bool)
            order = np.lexsort((s, d, g, h))
            new = _firsts(h[order], g[order])
            group = np.cumsum(new) - 1
            head = order[np.flatnonzero(new)[group]]
            real, own = np.zeros(len(h), bool), np.zeros(len(h), bool)
            real[order] = (np.bincount(group) > 1)[group] | (np.bincount(group, weights=many[order]) > 0)[group]
            own[order] = (d[order] == d[head]) & (s[order] == s[head])
            ends = np.cumsum(sizes).tolist()
            yield from _table(_BACK, [(at, r[0], j - i, _bits(real[i:j]), _bits(own[i:j])) for r, i, j in zip(rows, [0, *ends], ends)]).to_batches()

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        """right: what emit got (at, src, cells) and what came back for what it sent (at, n, real, own)."""
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "kept_sha256": []}
        back = right.filter(pa.compute.is_valid(right["n"])).sort_by("at")
        known = right.filter(pa.compute.is_null(right["n"]))
        gone_text, gone_start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows:
            left = left.sort_by("_id")
        if left.num_rows and back.num_rows:
            h, g, d, s, t = estimated(left, known)
            new = _firsts(h, g)
            entry = np.cumsum(new) - 1
            real, own = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(back[c].to_pylist(), back["n"].to_pylist())]).astype(bool) for c in ("real", "own"))
            head = np.flatnonzero(new)[entry]
            gone = real[entry] & ~(own[entry] & (d == d[head]) & (s == s[head]))
            order = np.argsort(t[gone], kind="stable")
            gone_text, gone_start = t[gone][order], s[gone][order]
        raw, at = C.utf8(left["text"]) if left.num_rows else (None, np.zeros(1, np.int64))
        for i, j in C.chunks(at):
            words = C.Words(raw[at[i] : at[j]], at[i : j + 1], _IS_WORD)
            a, b = np.searchsorted(gone_text, (i, j))
            where = words.first[gone_text[a:b] - i] + gone_start[a:b]
            edge = np.bincount(where, minlength=len(words.start) + window + 1) - np.bincount(where + window, minlength=len(words.start) + window + 1)
            covered = np.cumsum(edge)[: len(words.start)] > 0
            n_words = np.diff(words.first)
            n_gone = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
            data = words.raw.tobytes()
            base = at[i : j + 1] - at[i]
            for t in range(j - i):
                if n_gone[t]:
                    x, y = words.first[t], words.first[t + 1]
                    left_over = np.flatnonzero(~covered[x:y]) + x
                    text_out = b" ".join([data[p:q] for p, q in zip(words.start[left_over].tolist(), words.end[left_over].tolist())])
                else:
                    text_out = b" ".join(data[base[t] : base[t + 1]].split())
                out["kept_text"].append(text_out)
                out["kept_sha256"].append(hashlib.sha256(text_out).hexdigest())
            out["n_words"].append(n_words)
            out["n_removed"].append(n_gone)
        cols = [left["doc_id"].cast(pa.int64()).combine_chunks()]
        cols += [pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64()) for k in ("n_words", "n_removed")]
        cols += [pa.array(out["kept_text"], pa.binary()).cast(pa.string()), pa.array(out["kept_sha256"], pa.string())]
        return pa.table(cols, names=list(out))

    by_src = docs.groupBy("src")
    known = C.to_sources(C.to_buckets(by_src.applyInArrow(sketch, _SKETCH), "at", parts).mapInArrow(merge, _KNOWN), sources)
    met = by_src.cogroup(known.groupBy("src")).applyInArrow(emit, _MET)
    back = C.to_buckets(met, "at", parts).mapInArrow(first, _BACK)
    none = F.lit(None)
    answers = known.select("at", "src", "cells", none.cast("int").alias("n"), none.cast("binary").alias("real"), none.cast("binary").alias("own"))
    answers = answers.union(back.select("at", "src", none.cast("binary").alias("cells"), "n", "real", "own"))
    return by_src.cogroup(answers.groupBy("src")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE_SQL = rf"""
with docs as (select row_number() over (order by doc_id) as k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
words as (select k, doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
spans as (select k, doc_id, i, array_to_string(w[i:i + {WINDOW} - 1], ' ') as s from (select k, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as i from docs)),
repeated as (select k, i from (select k, i, doc_id, min(struct_pack(d := doc_id, i := i)) over (partition by s) as first from spans) where first <> struct_pack(d := doc_id, i := i)),
marked as (select words.k, doc_id, word, words.i, count(repeated.i) over (partition by words.k order by words.i rows between {WINDOW} - 1 preceding and current row) > 0 as gone
    from words left join repeated on words.k = repeated.k and words.i = repeated.i),
kept as (select k, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as t from marked group by k)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (k)"""
