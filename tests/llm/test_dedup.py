"""SimHash near-duplicates, substring dedup and the exchange they share, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tessera.llm import common as C
from tessera.llm import simhash
from tessera.llm.components import components
from tessera.llm.simhash import ball, fingerprint, links, near_duplicates
from tessera.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """{place: least id} over all pairs; fps: (id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(fps):
        for j, (b, y) in enumerate(fps[:i]):
            if bin(x ^ y).count("1") <= 4 or a == b:
                parent[find(i)] = find(j)
    low = {}
    for i, (a, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), a), a)
    return [low[find(i)] for i in range(len(fps))]


def test_fingerprints(messy):
    for _, t in messy:
        assert fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_near_duplicates(docs_of, messy):
    got = near_duplicates(docs_of(messy)).collect()
    lowest = C.NULL_ID
    want = plain_components([(lowest if i is None else i, plain_fingerprint(t)) for i, t in messy])
    rows = sorted((repr(i), f"{plain_fingerprint(t):016x}", repr(None if c == lowest else c)) for (i, t), c in zip(messy, want))
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in got) == rows


def test_near_duplicates_of_nothing(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_links_are_all_close_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {f for b in base for f in [b] + [b ^ sum(1 << k for k in r.sample(range(64), d)) for d in (1, 2, 3, 4, 4, 5, 6) for _ in range(2)]}
    # a crowd around one fingerprint
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    found = {(e["a"], e["b"]) for e in links(nodes).collect()}
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in found)
    label = {e["node"]: e["component"] for e in components(links(nodes)).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == plain_components(list(enumerate(fps)))
    with pytest.raises(ValueError):
        links(nodes, 3)


def test_ball():
    assert len(ball(2)) == len(set(ball(2).tolist())) == 2081 and np.bitwise_count(ball(2)).max() == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_end_with_the_last_star(spark, monkeypatch):
    """Stars need no round, a chain of three edges one or two; nothing is broadcast."""
    from tessera.llm import components as module

    steps, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda rows: steps.append(rows._jdf.queryExecution().toString()) or cut(rows))
    for edges, want, most in (([(1, 5), (5, 1), (1, 6), (2, 7), (3, 3)], {5: 1, 6: 1, 7: 2}, 1), ([(1, 4), (4, 2), (2, 3)], {2: 1, 3: 1, 4: 1}, 3)):
        steps.clear()
        assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
        assert len(steps) <= most and not any("BroadcastExchange" in x for x in steps)


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1500, 5000, 70_000, 300_000])
def test_packed_cells(n):
    r = np.random.default_rng(n)
    for top in (40, 2**20, 2**32):
        cells = np.sort(r.integers(0, top, n, np.uint64).astype(np.uint32))
        assert (C.unpack_cells(C.pack_cells(cells)) == cells).all()
    places = r.integers(-(2**63), 2**63 - 1, n)
    assert (C.unplanes(C.planes(places)) == places).all()


def plain_removal(rows, k=20):
    seen, out = {}, []
    low = [(C.NULL_ID if i is None else i, t) for i, t in rows]
    words = [WORD.findall(t or "") for _, t in low]
    for (i, _), w in zip(low, words):
        for s in range(len(w) - k + 1):
            at = seen.setdefault(tuple(w[s : s + k]), (i, s))
            seen[tuple(w[s : s + k])] = min(at, (i, s))
    for (i, _), w in zip(low, words):
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s : s + k])] < (i, s):
                gone[s : s + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), kept))
    return out


def test_substring_dedup(docs_of, messy):
    got = remove_repeats(docs_of(messy)).collect()
    want = [(repr(i), *x, hashlib.sha256(x[2].encode()).hexdigest()) for (i, _), x in zip(messy, plain_removal(messy))]
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"], r["kept_sha256"]) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 300
    assert remove_repeats(docs_of([])).count() == 0


def test_substring_dedup_of_a_hot_passage(docs_of):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs_of(rows)).collect()}
    assert got == {i: 25 * (i > 0) for i in range(300)}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_cancel_out_in_sums(docs_of):
    """Words that every polynomial modulo a power of two takes for equal: windows behind them are different."""
    word, tail = thue_morse(1024), " ".join(f"t{i}" for i in range(19))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} {tail}"), (2, f"{other} {tail}"), (3, f"x {tail}"), (4, f"{other} {tail} end")]
    # and sequences of words of that pattern
    rows += [(10 + i, " ".join(x if c == "a" else y for c in thue_morse(64))) for i, (x, y) in enumerate((("one", "two"), ("two", "one")))]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in remove_repeats(docs_of(rows)).collect()}
    assert got == {i: x[1:] for (i, _), x in zip(rows, plain_removal(rows))}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [0, 0, 0, 20]


@pytest.mark.parametrize("sizes", [{"wide": 1}, {"source_bytes": 3000}, {"source_bytes": 3000, "bucket_bytes": 100, "wide": 1}])
def test_a_crowded_sketch_loses_none(docs_of, messy, sizes):
    """Few counters, many sources, many buckets: the same rows."""
    got = remove_repeats(docs_of(messy), **sizes).collect()
    want = [(repr(i), x[1], x[2]) for (i, _), x in zip(messy, plain_removal(messy))]
    assert sorted((repr(r["doc_id"]), r["n_removed"], r["kept_text"]) for r in got) == sorted(want)


def test_one_hot_id(docs_of):
    """A third of all rows have no doc_id: different texts, and the same."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"n{i} {passage} m{i}" if i % 2 else "again and again " * 10) for i in range(100)] + [(i, f"k{i} {passage}" if i % 3 else f"own{i} " * 5) for i in range(200)]
    got = remove_repeats(docs_of(rows)).collect()
    assert sorted((repr(r["doc_id"]), r["n_removed"], r["kept_text"]) for r in got) == sorted((repr(i), x[1], x[2]) for (i, _), x in zip(rows, plain_removal(rows)))


@pytest.mark.parametrize("n,universe", [(0, 9), (1, 1), (7, 7), (300, 2**40), (50_000, 2**19), (5, 2**50)])
def test_sorted_numbers(n, universe):
    values = np.unique(np.random.default_rng(n).integers(0, universe, n, np.uint64))
    packed = C.pack_sorted(values, universe)
    assert (C.unpack_sorted(packed) == values).all()
    assert n < 100 or len(packed) * 8 < len(values) * (3 + np.log2(universe / len(values))) + 100


def test_word_and_window_hashes():
    text = b"word  a-longer-word-of-many-letters word " + b"z" * 200 + b" " + b"z" * 201 + b" word"
    words = C.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([c not in b" " for c in range(256)]))
    for which in (0, 1):
        h = words.hashes(which)
        assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 4
        r = np.random.default_rng(which).integers(0, 2**63, 60, np.uint64)
        for k in (1, 2, 3, 5, 7, 10, 20):
            w = C.window_hashes(np.concatenate([r, r]), k, which)
            assert len(w) == 121 - k and (w[: 61 - k] == w[60:]).all() and len(set(w[:60].tolist())) == 60
    assert (words.hashes(0) != words.hashes(1)).all()
    assert len(C.window_hashes(np.zeros(3, np.uint64), 4)) == 0


def test_short_fingerprints():
    """Each bit is that of over half of the hashes; the weak ones are the nearest to half."""
    r = np.random.default_rng(3)
    size = np.array([1, 4, 15, 16, 300, 70_000])
    begin = np.cumsum(size) - size
    h = r.integers(0, 2**63, size.sum(), np.uint64)
    values, weak = simhash.blocks(h, begin)
    assert (np.bitwise_count(weak) == simhash.WEAK).all()
    for i, q in [(i, q) for i in range(len(size)) for q in (0, 17, simhash.BLOCKS // 2 - 1)]:
        x = C.mix(h[begin[i] : begin[i] + size[i]] ^ simhash._OF_BLOCK[q])
        twice = 2 * np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64) - size[i]
        for half in (0, 1):
            mine, bits = twice[32 * half :][:32], values[i, 2 * q + half]
            assert [bool(bits >> np.uint32(b) & np.uint32(1)) for b in range(32)] == (mine > 0).tolist()
            is_weak = np.array([bool(weak[i, 2 * q + half] >> np.uint32(b) & np.uint32(1)) for b in range(32)])
            assert abs(mine[is_weak]).max() <= abs(mine[~is_weak]).min()
