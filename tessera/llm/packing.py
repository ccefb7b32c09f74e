"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import tokenizer

LENGTH, OPEN, END = 2048, 64, 1
#: The fullest window goes as it is with fewer free places; with more, the piece that didn't fit is cut to fill it.
MAX_GAP = 8
#: So many partitions' open windows are merged together.
MERGED = 32
#: Fixed value: the word-level pre-token pattern of the tokenizer file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Fixed value: how the vocabulary marks tokens that end a pre-token.
WORD_END = "</w>"
#: Words, and pre-tokens, whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 350_000
BLOCK_BYTES = 2 << 20


class Ragged:
    """Strings and the numbers that belong to each, side by side. A string that at() hasn't seen gets the next place;
    new() tells those that still have no numbers, in that order, and add() gives them theirs."""

    def __init__(self):
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.n, self.start, self.flat = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)

    def at(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def new(self) -> list[str]:
        return list(islice(reversed(self.index), len(self.index) - self.n))[::-1]

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        ends = self.start[self.n] + np.cumsum(sizes)
        while len(self.start) <= self.n + len(sizes):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.start[self.n] : ends[-1]] = values
        self.start[self.n + 1 : self.n + 1 + len(sizes)] = ends
        self.n += len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at all places, one after the other, and how many each has."""
        begin = self.start[at]
        sizes = self.start[at + 1] - begin
        return self.flat[_runs(begin, sizes)], sizes


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Token ids of whole texts. The tokenizer's normaliser and pre-tokenizer never look across white space, and its
    pre-tokens are encoded one by one, so the ids of each white-space separated word are kept, and under them those of
    each pre-token. Words beyond the common scripts (where Unicode versions may differ) are encoded whole; texts with
    special strings or control characters that Python alone takes for white space are encoded as they are."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.words, self.parts = Ragged(), Ragged()
        self.find = regex.compile(PRE_TOKEN + r"|\n").findall
        vocabulary = self.tok.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _learn(self, words: list[str]) -> None:
        """The ids of new words, in their order."""
        rest = [i for i, w in enumerate(words) if not (w.isascii() or (max(w) <= "\u04ff" and "\u03a3" not in w and is_normalized("NFC", w)))]
        others = set(rest)
        plain = [w for i, w in enumerate(words) if i not in others] if rest else words
        found = self.find("".join([w + "\n" for w in plain]).lower())
        counts = np.diff(np.array([i for i, p in enumerate(found) if p == "\n"], np.int64), prepend=-1) - 1
        at = self.parts.at([p for p in found if p != "\n"])
        if new := self.parts.new():
            for i in range(0, len(new), 256):
                self._add_parts(new[i : i + 256])
        ids, of_part = self.parts.take(at)
        sizes = np.diff(np.concatenate([[0], np.cumsum(of_part)])[np.concatenate([[0], np.cumsum(counts)])])
        if rest:
            whole = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
            order = np.argsort(np.concatenate([np.delete(np.arange(len(words)), rest), rest]), kind="stable")
            sizes, ids = np.concatenate([sizes, [len(x) for x in whole]]), np.concatenate([ids, *whole])
            ids = ids[_runs((np.cumsum(sizes) - sizes)[order], sizes[order])]
            sizes = sizes[order]
        self.words.add(sizes, ids)

    def _add_parts(self, some: list[str]) -> None:
        """New pre-tokens are encoded as one text: the last id of each is one that ends a word. If they don't come out so,
        one by one."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) != len(some) or ends[-1] != len(ids) - 1:
            found = [x.ids for x in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            return self.parts.add(np.fromiter(map(len, found), np.int64, len(found)), np.array([y for x in found for y in x], np.uint32))
        self.parts.add(np.diff(ends, prepend=-1), ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if "<|" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t}
        split = [[] if i in odd else t.split() for i, t in enumerate(texts)]
        if self.words.n > KEPT_WORDS:
            self.words = Ragged()
        if self.parts.n > KEPT_WORDS:
            self.parts = Ragged()
        at = self.words.at(list(chain.from_iterable(split)))
        if new := self.words.new():
            self._learn(new)
        flat, sizes = self.words.take(at)
        cut = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, split)])]
        out = [flat[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for i in odd:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


class Packer:
    """Open windows; emit(window) gets the closed ones, a window being a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, emit, length: int = LENGTH, n_open: int = OPEN, max_gap: int = MAX_GAP):
        self.emit, self.length, self.n_open, self.max_gap = emit, length, n_open, max_gap
        self.free: list[tuple[int, int]] = []  # (free places, window), sorted
        self.windows: dict[int, list] = {}
        self.made = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.length * self.length
        for i in range(0, whole, self.length):
            self.emit([(doc_id, i, ids[i : i + self.length], n)])
        if whole < n:
            self._place(doc_id, whole, ids[whole:], n)

    def _place(self, doc_id, start: int, ids: np.ndarray, n: int) -> None:
        k = bisect_left(self.free, (len(ids), -1))
        if k == len(self.free):  # none fits
            if len(self.free) >= self.n_open:
                gap, window = self.free.pop(0)
                held = self.windows.pop(window)
                if gap >= self.max_gap:
                    held.append((doc_id, start, ids[:gap], n))
                    start, ids = start + gap, ids[gap:]
                self.emit(held)
                return self._place(doc_id, start, ids, n)
            self.made += 1
            free, window = self.length, self.made
            self.windows[window] = []
        else:
            free, window = self.free.pop(k)
        self.windows[window].append((doc_id, start, ids, n))
        if free == len(ids):
            self.emit(self.windows.pop(window))
        else:
            insort(self.free, (free - len(ids), window))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_names = [x.split()[0] for x in _PIECES.split(", ")]


def _pieces(windows: list[tuple[int, list]]) -> pa.Table:
    rows = []
    for sequence, window in windows:
        offset = 0
        for doc_id, start, ids, n in window:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset))
            offset += len(ids)
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)], names=_names)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, n_open: int = OPEN) -> DataFrame:
    """Per piece of a row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and the end id 1. Full windows go at once; the rest of a document goes
    to that of a partition's n_open open windows which it fills best. When it fits none, the fullest is emitted, after
    a cut of the piece has filled it if more than a few places are free. What is open when partitions end is merged,
    MERGED partitions together: windows are filled to the end, and the last one is cut at powers of two, which are
    not padded. A task holds n_open windows, a merge MERGED * n_open at most.

    Null and empty texts are the end id alone. Repeated rows and null doc_ids are packed like others. No rows: none.
    The order of rows within input partitions must not change when a task runs again (a table read from files)."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def online(batches):
        base, n, closed = TaskContext.get().partitionId(), 0, []
        packer, enc = Packer(closed.append, length, n_open), C.kept(("ids", path), lambda: Encoder(path))

        def flush():
            nonlocal n
            out = _pieces([((base << 32) + n + i, w) for i, w in enumerate(closed)])
            n += len(closed)
            closed.clear()
            out = out.append_column("part", pa.nulls(out.num_rows, pa.int64())).append_column("ids", pa.nulls(out.num_rows, pa.binary()))
            return out.to_batches()

        for batch in batches:
            _, at = C.utf8(batch.column("text"))
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in C.chunks(at, BLOCK_BYTES):
                for doc_id, x in zip(ids[i:j], enc.encode([t or "" for t in texts[i:j].to_pylist()])):
                    packer.add(doc_id, np.append(x, np.uint32(END)))
                yield from flush()
        left = [p for _, w in sorted((free, w) for free, w in packer.free) for p in packer.windows[w]]
        if left:
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in ([p[0] for p in left], [p[1] for p in left], [len(p[2]) for p in left], [None] * len(left), [p[3] for p in left], [None] * len(left), [None] * len(left), [base] * len(left))), pa.array([p[2].astype("<u4").tobytes() for p in left], pa.binary())], names=[*_names, "part", "ids"])

    def merge(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        windows, room, window = [], 0, []
        for doc_id, start, n, blob in zip(*(part[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            ids = np.frombuffer(blob, "<u4")
            while len(ids):
                if not room:
                    window, room = [], length
                    windows.append(window)
                take = min(room, len(ids))
                window.append((doc_id, start, ids[:take], n))
                start, ids, room = start + take, ids[take:], room - take
        if room:
            windows[-1:] = _powers_of_two(windows[-1])
        return _pieces([((1 << 62) + (key[0].as_py() << 32) + i, w) for i, w in enumerate(windows)])

    first = C.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(online, _PIECES + ", part long, ids binary"))
    rest = first.where("part is not null").withColumn("group", F.floor(F.col("part") / MERGED)).groupBy("group").applyInArrow(merge, _PIECES)
    return first.where("part is null").select(*_names).union(rest)


def _powers_of_two(window: list) -> list[list]:
    """The window's pieces in windows whose lengths are descending powers of two."""
    left, out = sum(len(p[2]) for p in window), []
    pieces = window[::-1]
    while left:
        room, now = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc_id, start, ids, n = pieces.pop()
            now.append((doc_id, start, ids[:room], n))
            if len(ids) > room:
                pieces.append((doc_id, start + room, ids[room:], n))
            room -= min(room, len(ids))
        out.append(now)
    return out


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
