"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from heapq import nsmallest
from itertools import combinations
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The classifier is fitted on at most so many labelled documents, by the hash of their doc_id.
TRAIN_DOCS = 6000
#: The kernel of two words: common subsequences of ORDER characters within REACH characters, each weighed by DECAY for
#: every character that it spans in either word; as a cosine, to the POWER. All three steps keep it positive definite.
#: What is below LEAST counts as 0.
ORDER, REACH, DECAY, POWER, LEAST = 4, 7, 0.7, 2, 1e-3
#: Landmarks are words of the labelled sentences: of those that stand out in toxic texts one for each neighbourhood
#: (kernel of COVERED or more), the LOOKALIKES clean words that come nearest to them, and SAMPLED others by their hash.
COVERED, LOOKALIKES, SAMPLED = 0.3, 16, 32
#: A word that stands out is in so many toxic documents, and behind so many different words, at least, and its number of
#: toxic documents times the logarithm of how much oftener they have it than clean ones is EVIDENCE or more.
CONTEXTS, EVIDENCE = 3, 14.0
#: Of near copies one teaches: those that share so many of SKETCH least shingle hashes with a text before.
SKETCH, SHARED = 16, 6
#: A toxic text has so many witness sentences at most, with margins of the floor or more; rounds of choosing and fitting.
WITNESSES = 3
WITNESS_ROUNDS, FIRST_FLOOR, FLOOR = 6, 0.15, -0.9
#: A sentence without an end has so many words at most; a word of more characters is looked at in overlapping parts.
SENTENCE, PART = 32, 32
#: Words whose weights a worker keeps; beyond that it starts anew.
KEPT_WORDS = 250_000
#: So many of a text's highest sentences count, with margins up to these.
HIGHEST, CLIP = 3, (3.0, 1.0, 1.0)
#: What a toxic text counts when the curve is fitted, and one with changed words; a clean one counts 1.
MISSED, CHANGED = 1.5, 0.3

#: Characters written for others.
_LOOKS = str.maketrans("013457@$!", "oieastasi")


#: Stands before a word: words that begin alike have more in common. Codes of characters take _BITS bits.
START, _START, _BITS = "^", 53, 6
#: A word has so many letters at least; with START they make one subsequence.
SHORTEST = ORDER - 1


def unit(word: str) -> str:
    """A word as the kernel sees it: letters alone, so that marks put between them don't count."""
    if word.isalpha():
        return word
    return "".join(c for c in word.translate(_LOOKS) if c.isalpha()) if any(c.isalpha() for c in word) else ""


def _encode(words: list[str], width: int) -> np.ndarray:
    """Characters as small numbers, 0 beyond the end; those outside a-z share 26 numbers, which is enough here."""
    if not len(words):
        return np.zeros((0, width), np.uint8)
    c = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), -1)
    return np.where((c >= 97) & (c <= 122), c - 96, np.where(c == ord(START), _START, np.where(c > 0, 27 + c % 26, 0))).astype(np.uint8)


def _patterns() -> list[tuple[int, ...]]:
    """Where the characters of a subsequence stand after its first."""
    return list(combinations(range(1, REACH), ORDER - 1))


def _subsequences(codes: np.ndarray):
    """For each pattern that fits: the codes of the subsequences that start at each place, and how many characters they
    span. Those that go over a word's end end in 0."""
    shifted = [codes.astype(np.int32) << (_BITS * (ORDER - 1 - i)) for i in range(ORDER)]
    width = codes.shape[1]
    for pattern in _patterns():
        n = width - pattern[-1]
        if n > 0:
            yield sum((shifted[i + 1][:, o : o + n] for i, o in enumerate(pattern)), shifted[0][:, :n]), pattern[-1] + 1


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, value): the weights of each row's occurrences of a subsequence, summed."""
    # sorted within rows, with the pattern's span in the low bits
    every = np.concatenate([np.zeros((len(codes), 0), np.int32), *((u << 4) + span for u, span in _subsequences(codes))], axis=1)
    every.sort(axis=1)
    row = np.repeat(np.arange(len(codes)), every.shape[1])
    flat = every.ravel()
    whole = (flat >> 4) & ((1 << _BITS) - 1) > 0
    row, flat = row[whole], flat[whole]
    if not len(flat):
        return row, flat, np.zeros(0)
    new = np.concatenate([[True], (flat[1:] >> 4 != flat[:-1] >> 4) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    return row[at], flat[at] >> 4, np.add.reduceat(DECAY ** (flat & 15).astype(np.float64), at)


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))  # a word's weight: beta . kernel(word, landmarks)
    bias: float = -1.0
    slopes: tuple[float, ...] = (1.0,) + (0.0,) * HIGHEST  # score = sigmoid(slopes . traits of a text + offset)
    offset: float = 0.0

    def __post_init__(self):
        """A table of the landmarks' subsequences, and for each the landmarks that have it and its share of them."""
        codes = _encode([START + w for w in self.landmarks], 1 + max(map(len, self.landmarks), default=0))
        mark, which, value = features(codes)
        value /= np.sqrt(np.bincount(mark, weights=value**2, minlength=len(codes)))[mark] if len(mark) else 1
        order = np.argsort(which, kind="stable")
        known, first = np.unique(which[order], return_index=True)
        self.table = np.zeros(1 << _BITS * ORDER if len(known) else 1, np.uint16 if len(known) < 65_535 else np.int32)
        self.table[known] = np.arange(1, len(known) + 1)
        self.first = np.append(first, len(order))
        self.mark, self.value = mark[order], value[order]

    def kernel(self, units: list[str]) -> np.ndarray:
        """Units by landmarks. A unit of more than PART characters counts as its best part."""
        wide = len(self.landmarks)
        out = np.zeros((len(units), wide), np.float32)
        parts, of = [], []
        for i, u in enumerate(units):
            if SHORTEST <= len(u) <= PART:
                parts.append(START + u)
                of.append(i)
            elif len(u) > PART:
                for j in range(0, len(u) - PART // 2, PART // 2):
                    parts.append((START if not j else "") + u[j : j + PART])
                    of.append(i)
        if not parts or not wide:
            return out
        of, size = np.array(of), np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), 2048):
            at = order[i : i + 2048]
            codes = _encode([parts[k] for k in at.tolist()], int(size[at].max()))
            got = []
            for u, span in _subsequences(codes):
                found = self.table[u]
                hit = np.flatnonzero(found)
                got.append((hit // found.shape[1], found.ravel()[hit].astype(np.int64) - 1, np.full(len(hit), DECAY**span)))
            row, which, weight = (np.concatenate(x) for x in zip(*got))
            many = self.first[which + 1] - self.first[which]
            take = np.repeat(self.first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(np.repeat(row, many) * wide + self.mark[take], weights=np.repeat(weight, many) * self.value[take], minlength=len(at) * wide).reshape(-1, wide)
            # a word's own kernel is at least that of its occurrences one by one: who is below LEAST even so is done
            near = np.flatnonzero((both.max(1) ** 2 / _one_by_one(size[at])) ** (POWER / 2) >= LEAST)
            if not len(near):
                continue
            own_row, _, own = features(codes[near])
            share = (both[near] / np.sqrt(np.bincount(own_row, weights=own**2, minlength=len(near)))[:, None]) ** POWER
            np.maximum.at(out, of[at[near]], np.where(share >= LEAST, share, 0).astype(np.float32))
        return out

    def weights(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units), np.float32)
        for i in range(0, len(units) if self.landmarks else 0, 8192):
            out[i : i + 8192] = self.kernel(units[i : i + 8192]) @ self.beta.astype(np.float32)
        return out

    def score(self, traits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(traits @ np.array(self.slopes) + self.offset, -30, 30)))


def _one_by_one(size: np.ndarray) -> np.ndarray:
    """The summed squares of the weights of all occurrences in a word of so many characters, none taken for equal."""
    out = np.zeros(len(size))
    for p in _patterns():
        out += np.maximum(0, size - p[-1]) * DECAY ** (2 * (p[-1] + 1))
    return out


class Scorer:
    """Traits of whole texts. A sentence's margin is the bias and its words' weights; a text has those of its HIGHEST
    highest sentences, for want of more that of an empty one, and the logarithm of the number of its sentences, as of
    many one is high by chance. Every distinct word is compared with the landmarks once."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.weight, self.letters, self.ends = np.zeros(1 << 16, np.float32), np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool)

    def _learn(self, words: list[str]) -> None:
        units = [unit(w) for w in words]
        first, n = len(self.index), len(words)
        while len(self.weight) < first + n:
            self.weight, self.letters, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.weight, self.letters, self.ends))
        self.weight[first : first + n] = self.model.weights(units)
        self.letters[first : first + n] = [min(2, len(u)) for u in units]
        self.ends[first : first + n] = [w[-1] in ".!?" for w in words]
        self.index.update(zip(words, range(first, first + n)))

    def traits(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        out = np.full((len(texts), HIGHEST + 1), self.model.bias)
        out[:, HIGHEST] = 0
        words = [w for x in split for w in x]
        if not words:
            return out
        if len(self.index) > KEPT_WORDS:
            self.reset()
        if new := set(words).difference(self.index):
            self._learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        text = np.repeat(np.arange(len(split)), sizes)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        weight = self.weight[at].astype(np.float64)
        # letters that stand alone, three or more in a row, are one word
        alone = np.append(self.letters[at] < 2, False)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alone]).astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i >= 3:
                for k in np.unique(text[i:j]).tolist():
                    run = [w for w, t in zip(words[i:j], text[i:j].tolist()) if t == k]
                    letters = "".join(map(unit, run))
                    if len(letters) >= 3:
                        last = max(x for x in range(i, j) if text[x] == k)
                        weight[last] += self.model.weights([letters])[0]
        # sentences: from one end to the next, of SENTENCE words at most
        ends = self.ends[at].copy()
        ends[start[(start > 0) & (start <= len(at))] - 1] = True
        ends[-1] = True
        begin = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        size = np.diff(np.append(begin, len(at)))
        more = [np.arange(b, b + s, SENTENCE) for b, s in zip(begin[size > SENTENCE].tolist(), size[size > SENTENCE].tolist())]
        begin = np.sort(np.concatenate([begin[size <= SENTENCE], *more])).astype(np.int64)
        # a sentence below an empty one counts as that
        total, of = self.model.bias + np.maximum(0, np.add.reduceat(weight, begin)), text[begin]
        order = np.lexsort((-total, of))
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        high = rank < HIGHEST
        out[of[high], rank[high]] = total[order][high]
        out[:, HIGHEST] = np.log(np.maximum(1, np.bincount(of, minlength=len(texts))))
        out[:, :HIGHEST] = np.minimum(out[:, :HIGHEST], CLIP)
        return out


# ---- fitting ----------------------------------------------------------------------------------------------------


def _sentences(text: str) -> list[list[str]]:
    out, now = [], []
    for w in text.lower().split():
        now.append(w)
        if w[-1] in ".!?" or len(now) == SENTENCE:
            out.append(now)
            now = []
    return out + [now] if now else out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Landmarks, Nyström features, a squared-hinge linear machine over sentences, and a logistic curve over texts.

    Labels are for whole texts, so the sentences of a toxic text that hold nothing like a landmark are not taken as
    toxic; a sentence of a clean text is clean. With no text of either label no text is predicted toxic."""
    if not (0 in labels and 1 in labels):
        return Model()
    first = _first_of_copies(texts)
    texts, labels = [texts[i] for i in first], [labels[i] for i in first]
    toxic, clean = max(1, sum(y == 1 for y in labels)), max(1, sum(y == 0 for y in labels))
    held = {0: Counter(), 1: Counter()}
    contexts: dict[str, set] = defaultdict(set)  # of toxic texts, as many as are asked for
    for text, y in zip(texts, labels):
        before, here = "", set()
        for u in map(unit, text.lower().split()):
            if len(u) >= SHORTEST:
                here.add(u)
                if y and len(contexts[u]) < CONTEXTS:
                    contexts[u].add(before)
            before = u
        held[y].update(here)
    rate = {}
    for u, c in contexts.items():
        if min(held[1][u], len(c)) >= CONTEXTS:
            a, b = held[1][u] / toxic, (held[0][u] + 0.5) / clean
            if a > 5 * b and held[1][u] * log(a / b) >= EVIDENCE:
                rate[u] = held[1][u] * log(a / b)
    del contexts
    # a word that so many toxic and no clean texts hold by chance is rarer than one in the vocabulary
    chance = log(toxic / (toxic + clean))
    sure = {u for u in rate if held[1][u] * chance + log(len(held[1]) + 1) < log(0.05) and 50 * held[0][u] <= held[1][u]}
    marks = _covering(sorted(sorted(rate), key=lambda u: -rate[u]))
    if not marks:
        return Model()
    # clean words that look most like them, and others as they come
    alike = Model(marks)
    pool = sorted(u for u in held[0] if u not in rate and len(u) <= PART)
    near = np.concatenate([np.zeros(0), *(alike.kernel(pool[i : i + 20_000]).max(1) for i in range(0, len(pool), 20_000))])
    more = [pool[i] for i in np.argsort(-near, kind="stable")[:LOOKALIKES] if near[i] >= LEAST]
    del alike
    more += nsmallest(SAMPLED, set(held[0]) | set(held[1]), key=lambda u: (crc32(u.encode()), u))
    landmarks = marks + sorted(set(more) - set(marks))
    model = Model(landmarks)
    gram = model.kernel(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T  # K^(-1/2), with a floor for landmarks that are alike
    certain = np.array([u in sure for u in marks])
    # toxic sentences once more, with a character put into their sure words: so the machine learns to bear that
    altered = []
    for text, y in zip(texts, labels):
        for s in map(lambda s: list(map(unit, s)), _sentences(text) if y else []):
            if not sure.isdisjoint(s):
                altered.append([_with_insertion(u, len(altered)) if u in sure else u for u in s])
    # the words that are like some landmark, and the sentences with any; the others are the bias alone
    some: dict[str, int] = {}
    found = []  # of each such word how many landmarks it's like, which, and how much
    every = sorted({*held[0], *held[1], *(u for s in altered for u in s)})
    for i in range(0, len(every), 8192):
        k = model.kernel(every[i : i + 8192])
        at = np.flatnonzero(k.any(1))
        some.update(zip([every[i + x] for x in at.tolist()], range(len(some), len(some) + len(at))))
        row, mark = np.nonzero(k)
        found.append((np.bincount(row, minlength=len(k))[at], mark.astype(np.int32), k[row, mark]))
    many, which, much = (np.concatenate(x) for x in zip(*found))
    at = np.concatenate([[0], np.cumsum(many)])
    del every, held, pool, found
    rows, of = [], []
    for i, text in enumerate(texts):
        for s in _sentences(text):
            if r := [some[u] for u in map(unit, s) if u in some]:
                rows.append(np.array(r, np.int32))
                of.append(i)
    if not rows:
        return Model()
    own = len(rows)
    rows += [np.array([some[u] for u in s if u in some], np.int32) for s in altered]
    n, wide = len(rows), len(landmarks)
    cells, sure_best = [], np.zeros(n, np.float32)
    for i in range(0, n, 4096):  # words' kernels summed sentence by sentence; what isn't 0 is kept
        part = rows[i : i + 4096]
        flat = np.concatenate(part)
        size = many[flat]
        take = np.repeat(at[flat] - np.cumsum(size) + size, size) + np.arange(size.sum())
        here, col, value = np.repeat(np.repeat(np.arange(len(part)), [len(r) for r in part]), size), which[take], much[take]
        total = np.bincount(here * wide + col, weights=value, minlength=len(part) * wide)
        cell = np.flatnonzero(total)
        cells.append(((i + cell // wide).astype(np.int32), (cell % wide).astype(np.int32), total[cell].astype(np.float32)))
        known = certain[np.minimum(col, len(marks) - 1)] & (col < len(marks))
        np.maximum.at(sure_best, i + here[known], value[known])
    row, col, value = (np.concatenate(x) for x in zip(*cells))
    begin = np.searchsorted(row, np.arange(n + 1))
    del rows, cells, many, which, much, altered, some
    of, y = np.array(of), np.array(labels)

    def mapped(some_rows: np.ndarray) -> np.ndarray:
        """Nyström features of sentences, a one, and a last row for an empty sentence."""
        out = np.zeros((len(some_rows) + 1, wide + 1))
        for i in range(0, len(some_rows), 4096):
            r = some_rows[i : i + 4096]
            sums = np.zeros((len(r), wide))
            for j, k in enumerate(r.tolist()):
                sums[j, col[begin[k] : begin[k + 1]]] = value[begin[k] : begin[k + 1]]
            out[i : i + len(r), :wide] = sums @ root
        out[:, wide] = 1
        return out

    # a toxic text's witnesses are its highest sentences, as far as they reach the floor, and those with a sure word; a
    # clean text's sentences must all be clean
    holds = sure_best[:own] >= 0.9
    margin, bad = np.bincount(row, weights=value * (col < len(marks)), minlength=n), np.zeros(own, bool)
    floor = FIRST_FLOOR
    for _ in range(WITNESS_ROUNDS):
        order = np.lexsort((-margin[:own], of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        high = order[(y[of[order]] == 1) & (rank < WITNESSES) & (margin[order] >= floor)]
        good = np.union1d(high, np.flatnonzero(holds & (y[of] == 1)))
        bad[order[(y[of[order]] == 0) & (rank < HIGHEST)]] = True
        if not len(good):
            return Model()
        good = np.concatenate([good, np.arange(own, n)])
        keep = np.concatenate([good, np.flatnonzero(bad)])
        # texts without a sentence of their own here are empty sentences
        empty = int((y == 0).sum()) - len(np.unique(of[bad]))
        w, b = _machine(mapped(keep), np.concatenate([np.ones(len(good)), -np.ones(bad.sum() + 1)]), np.concatenate([np.ones(len(keep)), [max(1, empty)]]))
        margin, floor = np.bincount(row, weights=value * (root @ w)[col], minlength=n) + b, FLOOR
    model.beta, model.bias = root @ w, float(b)
    # toxic texts with all but one of their sentences with sure words left out, and that one changed, teach the curve too
    changed = []
    for i, (text, y) in enumerate(zip(texts, labels)):
        has = [(s, not sure.isdisjoint(map(unit, s))) for s in (_sentences(text) if y else [])]
        if one := next((s for s, x in has if x), None):
            changed.append(" ".join([w for s, x in has if not x for w in s] + [_with_insertion(w, i) if unit(w) in sure else w for w in one]))
    scorer, every = Scorer(model), texts + changed
    traits = np.concatenate([scorer.traits(every[i : i + 256]) for i in range(0, len(every), 256)])
    known, times = np.array(labels + [1] * len(changed)), np.array([MISSED if y else 1.0 for y in labels] + [CHANGED] * len(changed))
    model.slopes, model.offset = _logistic(traits, known, times)
    return model


def _with_insertion(word: str, seed: int) -> str:
    h = crc32(f"{seed} {word}".encode())
    at = 1 + h % max(1, len(word) - 1)
    return word[:at] + chr(97 + (h >> 8) % 26) + word[at:]


def _covering(words: list[str]) -> list[str]:
    """Those words that none chosen before covers: each of the words is covered by one of them, so their number follows
    the stems, and a stem of many variants keeps no other out."""
    marks, left = [], words
    while left:
        marks.append(left[0])
        near = Model(left[:1]).kernel(left[1:])[:, 0]
        left = [u for u, k in zip(left[1:], near.tolist()) if k < COVERED]
    return marks


def _first_of_copies(texts: list[str]) -> list[int]:
    """The places of the texts that aren't near copies of one before, by the least hashes of their three-word shingles."""
    owner: dict[int, int] = {}
    out = []
    for i, text in enumerate(texts):
        w = text.lower().split()
        least = nsmallest(SKETCH, {crc32(" ".join(w[j : j + 3]).encode()) for j in range(max(1, len(w) - 2))})
        votes = Counter(owner[h] for h in least if h in owner)
        if votes and max(votes.values()) >= min(SHARED, len(least)):
            continue
        out.append(i)
        owner.update(dict.fromkeys(least, i))
    return out


def _machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = 2.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + cost * the squared hinges, each as often as it counts, by Newton steps. x ends with a column of ones."""
    weight = times * cost
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6

    def loss(w):
        return (ridge * w * w).sum() / 2 + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w))
        on = slack > 0
        grad = ridge * w - 2 * (weight * slack * y) @ x
        hess = np.diag(ridge)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096][on[i : i + 4096]]
            hess += 2 * (part * weight[i : i + 4096][on[i : i + 4096], None]).T @ part
        step = np.linalg.solve(hess, grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def _logistic(traits: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 100) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of a logistic curve through the labels, smoothed as Platt does. Higher margins never lower a
    score: what would is left out, last ones first."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    use = list(range(traits.shape[1]))
    while use[0] == 0:
        x = np.column_stack([traits[:, use], np.ones(len(y))])
        w = np.zeros(x.shape[1])
        w[0] = 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            step = np.linalg.solve(hess, x.T @ (times * (p - target)) + 1e-2 * w)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if not (against := [k for k, v in zip(use, w) if k < HIGHEST and v <= 0]):
            slopes = np.zeros(traits.shape[1])
            slopes[use] = w[:-1]
            return tuple(slopes.tolist()), float(w[-1])
        use.remove(max(against))
    return Model().slopes, 0.0


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of at most `limit` labelled documents outside the held-out fold: those with the least hashes.
    Equal texts teach once."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most `limit` rows of two numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    return rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))


def _fit(batches):
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("toxic").to_pylist()
    m = fit(texts, labels)
    yield pa.record_batch([pa.array([json.dumps([m.landmarks, m.beta.tolist(), m.bias, m.slopes, m.offset])])], names=["model"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """One task fits on the bounded sample, in an order that makes the fit the same every time; the model alone comes
    to the driver."""
    rows = training_rows(docs, labels, limit).repartition(1).sortWithinPartitions(F.xxhash64("text"), "text")
    got = rows.mapInArrow(_fit, "model string").first()
    if got is None:
        return fit([], [])
    landmarks, beta, *rest = json.loads(got["model"])
    return Model(landmarks, np.array(beta, np.float64), *rest)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) to (doc_id, score double, predicted int): whole texts, one pass, nothing shuffled."""
    parts = (model.landmarks, model.beta, model.bias, model.slopes, model.offset)
    key = repr((parts[0], parts[1].tolist(), *parts[2:])).encode()

    def run(batches):
        scorer = C.kept(key, lambda: Scorer(Model(*parts)))
        for batch in batches:
            _, at = C.utf8(batch.column("text"))
            texts, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for i, j in C.chunks(at):
                score = scorer.model.score(scorer.traits([t or "" for t in texts[i:j].to_pylist()]))
                yield pa.record_batch([ids[i:j], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """Per row of docs (doc_id, text, any others): doc_id, held_out, score, predicted.

    labels (doc_id, toxic) teach, but not those of the held-out fold, crc32(doc_id) mod 5 = 0. Only the text makes the
    score. Null and empty texts have the score of a text without words; null doc_ids are not held out; null labels
    teach nothing, repeated ones count once, as toxic if any is. Without labels of both kinds every score is 0 and
    nothing is predicted toxic. Repeated rows keep their rows."""
    out = score_texts(docs, train(docs, labels, limit))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
