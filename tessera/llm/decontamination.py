"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A shared span of SPAN words is guaranteed to share a fingerprint: GRAM-word grams, the least of each
#: SPAN - GRAM + 1 consecutive ones. Shorter items are one window of all their words, found by grams of that length.
SPAN, GRAM = 10, 5
#: Up to so many benchmark fingerprints (8 bytes each) are sent to every task as a prefilter; beyond, the documents'
#: fingerprints are joined without it.
MAX_SENT = 1_000_000

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _texts(batch) -> tuple[np.ndarray, np.ndarray]:
    raw, at = C.utf8(batch.column("text"))
    return _LOWER[raw], at


def winnow(words: C.Words, hashes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The positions (first words) of the selected grams: the least hash of each span, the rightmost of equals."""
    w = span - gram + 1
    h = C.window_hashes(hashes, gram)
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = h[:n].copy(), np.arange(n)
    for s in range(1, w):
        take = h[s : s + n] <= low
        low[take] = h[s : s + n][take]
        at[take] = np.flatnonzero(take) + s
    return np.unique(at[words.windows(span)])


def _item_fingerprints(batches, span: int, gram: int):
    """(hash, n, item_id); n: 0 for winnowed grams, else the length of a short item."""
    for batch in batches:
        raw, at = _texts(batch)
        ids, out = batch.column("item_id").cast(pa.int64()), []
        for i, j in C.chunks(at):
            words = C.Words(raw[at[i] : at[j]], at[i : j + 1], _IS_WORD)
            h = words.hashes()
            x = winnow(words, h, span, gram)
            out.append((C.window_hashes(h, gram)[x], 0, i + words.text[x]))
            size = np.diff(words.first)
            for n in np.unique(size[(size > 0) & (size < span)]).tolist():
                t = np.flatnonzero(size == n)
                out.append((C.window_hashes(h, n)[words.first[t]], n, i + t))
        for h, n, t in out:
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), ids.take(pa.array(t))], names=["hash", "n", "item_id"])


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, max_sent: int = MAX_SENT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_words: the
    (start, end) ranges of hit words. items has item_id and text.

    A window is `span` consecutive words of an item, or all of an item that has fewer, but not none. A document's word
    is hit if it lies in any occurrence of a window. Both sides are winnowed, their fingerprints joined, and each hit
    is extended to whole windows by comparing the words themselves, so a hash that only happens to be equal adds
    nothing and every shared window is found.

    Null texts have no words; items without words, or with a null item_id, match nothing; an item_id that is repeated
    counts once. Repeated documents and null doc_ids keep their rows. Without items every document is clean."""
    spark = docs.sparkSession
    buckets = C.n_parts(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    prints = C.cut(items.mapInArrow(lambda it: _item_fingerprints(it, span, gram), "hash long, n int, item_id long").distinct())
    count, shorts = prints.agg(F.count("*"), F.array_distinct(F.collect_set("n"))).first()
    shorts = sorted(n for n in shorts if n)  # below span, so a few lengths at most
    sent = None
    if count <= max_sent:
        sent = {n: np.unique(np.array([r[0] for r in prints.where(F.col("n") == n).select("hash").distinct().collect()], np.int64).view(np.uint64)) for n in (0, *shorts)}
        sent = spark.sparkContext.broadcast(sent)

    def scan(batches):
        """A row a document: its key, and its fingerprints as (hash, n), with the text if there are any."""
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, at = _texts(batch)
            for i, j in C.chunks(at):
                words = C.Words(raw[at[i] : at[j]], at[i : j + 1], _IS_WORD)
                h = words.hashes()
                x = winnow(words, h, span, gram)
                found = [(x, C.window_hashes(h, gram)[x], 0)]
                for n in shorts:
                    x = words.windows(n)
                    found.append((x, C.window_hashes(h, n)[x], n))
                if sent is not None:
                    found = [(x[m], g[m], n) for x, g, n in found for m in (C.is_in(g, sent.value[n]),)]
                text = np.concatenate([words.text[x] for x, _, _ in found])
                g = np.concatenate([g for _, g, _ in found]).view(np.int64)
                n = np.concatenate([np.full(len(g), n, np.int32) for _, g, n in found])
                order = np.lexsort((n, g, text))
                text, g, n = text[order], g[order], n[order]
                new = np.ones(len(g), bool)
                new[1:] = (text[1:] != text[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1])
                text, g, n = text[new], g[new], n[new]
                ends = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                has = np.diff(ends) > 0
                part = batch.slice(i, j - i)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(key, key + j - i)),
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        part.column("text").cast(pa.string()).take(pa.array(np.arange(j - i), mask=~has)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(g), pa.array(n)], names=["hash", "n"])),
                    ],
                    names=["key", "doc_id", "n_words", "text", "prints"],
                )
                key += j - i

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: documents (key, text); right: (item_id, item) once, and candidates (of, item_id)."""
        item_words: dict[int, list] = {}
        by_key: dict[int, set] = {}
        for k, i, t in zip(right["of"].to_pylist(), right["item_id"].to_pylist(), right["item"].to_pylist()):
            if k is None:
                item_words.setdefault(i, []).append(_split(t))
            else:
                by_key.setdefault(k, set()).add(i)
        out = []
        for k, t in zip(left["key"].to_pylist(), left["text"].to_pylist()):
            windows: dict[int, dict[bytes, set]] = {}
            for it in by_key.get(k, ()):
                for w in filter(None, item_words[it]):
                    n = min(span, len(w))
                    for x in range(len(w) - n + 1):
                        windows.setdefault(n, {}).setdefault(b" ".join(w[x : x + n]), set()).add(it)
            words, found, ranges = _split(t), set(), []
            for n, which in windows.items():
                for x in range(len(words) - n + 1):
                    if (got := which.get(b" ".join(words[x : x + n]))) is not None:
                        found |= got
                        ranges.append((x, x + n))
            merged: list[list[int]] = []
            for x, y in sorted(ranges):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(y, merged[-1][1])
                else:
                    merged.append([x, y])
            if merged:
                out.append((k, sum(y - x for x, y in merged), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), [{"start": x, "end": y} for x, y in merged]))
        cols = list(zip(*out)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["hit_key", "n_hit", "n_items", "items_sha256", "hit_words"])

    scanned = C.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "key long, doc_id long, n_words long, text string, prints array<struct<hash:long,n:int>>"))
    pairs = scanned.select("key", F.explode("prints").alias("p")).select("key", "p.*").join(prints, ["hash", "n"]).select("key", "item_id").distinct()
    src = F.pmod(F.xxhash64("key"), F.lit(8 * buckets)).alias("src")
    pairs = pairs.select(F.col("key").alias("of"), "item_id", src.alias("src2"))
    # an item's text goes once to each source that has a candidate of it
    texts = pairs.select("src2", "item_id").distinct().join(items.withColumnRenamed("text", "item"), "item_id")
    candidates = pairs.select("of", "item_id", F.lit(None).cast("string").alias("item"), "src2").union(texts.select(F.lit(None).cast("long"), "item_id", "item", "src2"))
    found = scanned.where("text is not null").select("key", "text", src).groupBy("src").cogroup(candidates.groupBy("src2")).applyInArrow(extend, "hit_key long, n_hit long, n_items long, items_sha256 string, hit_words array<struct<start:long,end:long>>")
    return scanned.select("key", "doc_id", "n_words").join(found, F.col("key") == F.col("hit_key"), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        "hit_words",
    )


_LOWER_BYTES = bytes(_LOWER)
_TO_SPACE = bytes(c if _IS_WORD[c] else 32 for c in _LOWER.tolist())


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACE).split()


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("hit_words")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with docs as (select row_number() over (order by doc_id) as k, doc_id, {_WORDS_SQL} as w from documents),
items as (select item_id, {_WORDS_SQL} as w from benchmark where item_id is not null),
item_windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
    from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select item_id, w, least({SPAN}, len(w)) as n from items where len(w) > 0))),
doc_windows as (select k, n, i, array_to_string(w[i:i + n - 1], ' ') as s
    from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from item_windows) where len(w) >= n)),
found as (select k, doc_windows.n, i, item_id from doc_windows join item_windows using (n, s)),
hit as (select k, count(distinct j) as n_hit from (select k, unnest(range(i, i + n)) as j from found) group by k),
listed as (select k, count(*) as n_items, string_agg(item, ',' order by item) as t from (select distinct k, cast(item_id as varchar) as item from found) group by k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(t, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hit using (k) left join listed using (k)"""
