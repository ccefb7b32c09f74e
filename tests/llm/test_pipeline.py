"""Each stage against plain Python on small documents, and the whole run."""

import hashlib
import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_near_duplicates_keep_one(spark, docs_of, messy):
    kept = P.drop_near_duplicates(spark, docs_of(messy), SF)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 8 in ids and 9 not in ids and 5 in ids and 6 not in ids and None in ids
    assert kept.columns == docs_of([]).columns


def test_secrets_are_marked(spark, docs_of):
    rows = [(1, 'é token = "abcdefghijkl" and deadbeefdeadbeef.'), (2, "clean"), (3, None), (4, "api_key=deadbeefdeadbeefdeadbeef x"), (5, "")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.redact_secrets(spark, docs_of(rows).withColumn("n_chars", F.length("text").cast("long")), SF).collect()}
    want = {1: 'é [SECRET]" and [SECRET].', 2: "clean", 3: None, 4: "[SECRET] x", 5: ""}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}


def test_contaminated_documents_go(spark, docs_of):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    kept = P.drop_contaminated(spark, docs_of([(1, "a " + item), (2, "clean text"), (None, None)]), SF)
    assert {r["doc_id"] for r in kept.collect()} == {2, None}


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.run(spark, SF).collect()
    left = {r["doc_id"] for r in out}
    assert 0 < len(left) < docs.count()
    copies = docs.groupBy("text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").collect()
    assert all(sum(d["doc_id"] in left for d in docs.where(F.col("text") == c["text"]).collect()) <= 1 for c in copies)
    assert len({hashlib.sha256(repr(r).encode()).hexdigest() for r in out}) == len(out)


def test_near_copies_by_similarity(spark, docs_of):
    """Copies of similarity 0.8 and more go, however many bits of a SimHash they differ in; others stay."""
    r = random.Random(5)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, want = [], set()
    for i in range(40):
        w = [f"v{r.randrange(10**5)}" for _ in range(200)]
        c = list(w)
        for k in r.sample(range(5, 195), 1 + i % 6):
            c[k] = "changed"
        a, b = shingles(" ".join(w)), shingles(" ".join(c))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(c))]
        want |= {2 * i} if len(a & b) >= 0.8 * len(a | b) else {2 * i, 2 * i + 1}
    assert 45 < len(want) < 80
    assert {x["doc_id"] for x in P.drop_near_duplicates(spark, docs_of(rows), SF).collect()} == want


def test_null_and_repeated_ids_go_by_their_own_text(spark, docs_of):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    texts = [f"word{i} is a clean text number{i} of its own{i}" for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, "a " + item), (7, texts[2]), (7, texts[3]), (7, "b " + item), (None, texts[4]), (9, texts[4]), (None, texts[5]), (None, texts[5])]
    left = lambda d: sorted((repr(x["doc_id"]), x["text"]) for x in d.collect())
    clean = [x for x in rows if item not in x[1]]
    assert left(P.drop_contaminated(spark, docs_of(rows), SF)) == sorted((repr(i), t) for i, t in clean)
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (None, texts[5])]
    assert left(P.drop_near_duplicates(spark, docs_of(clean), SF)) == sorted((repr(i), t) for i, t in want)
    toxic = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    gone = [x["text"] for x in toxic.collect() if x["text"]]
    kept = {x["text"] for x in P.drop_toxic(spark, toxic, SF).collect()}
    bad = next(t for t in gone if t not in kept)
    mixed = toxic.union(spark.createDataFrame([(None, bad), (None, texts[0]), (None, texts[1])], "doc_id long, text string"))
    assert {x["text"] for x in P.drop_toxic(spark, mixed, SF).where("doc_id is null").collect()} == {texts[0], texts[1]}


ONE_BY_ONE = [(n, f) for n, f in P.STAGES]


@pytest.mark.parametrize("name,stage", ONE_BY_ONE)
def test_stage_of_nothing(spark, docs_of, name, stage):
    out = stage(spark, docs_of([]), SF)
    assert out.count() == 0 and (name == "packing" or out.columns == docs_of([]).columns)


@pytest.mark.parametrize("name,stage", ONE_BY_ONE)
def test_stage_of_odd_rows(spark, docs_of, name, stage):
    """Nulls, repeated ids with different texts, a text of a megabyte, clashing names: nothing crashes, and clean rows
    that no other row is like stay."""
    r = random.Random(13)
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    rows = [(None, text(30)), (None, text(30)), (7, text(30)), (7, text(30)), (8, None), (9, text(130_000)), (10, text(3)), (None, None), (11, "")]
    out = stage(spark, docs_of(rows), SF)
    got = [(x["doc_id"], x["text"]) for x in out.collect()] if name != "packing" else out.collect()
    if name == "packing":
        assert len({(x["doc_id"], x["doc_tokens"]) for x in got}) >= 7 and sum(x["length"] for x in got if x["start"] == 0) > 0
    elif name == "near_duplicates":  # null and empty texts have no words in common with others, but with each other
        assert sorted(map(repr, got)) == sorted(map(repr, [x for x in rows if x[1]] + [(8, None)]))
    else:
        assert sorted(map(repr, got)) == sorted(map(repr, rows))


def test_toxic_documents_go(spark):
    """All that the operator predicts toxic, and nothing else, whatever the ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {x["doc_id"] for x in QUERIES["op2_toxicity"](spark, SF).where("predicted = 1").collect()}
    kept = {x["doc_id"] for x in P.drop_toxic(spark, docs, SF).collect()}
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    bad = {texts[i] for i in toxic}
    assert toxic and kept == {i for i, t in texts.items() if t not in bad}


def test_packing_keeps_every_token(spark, docs_of, messy):
    pieces = P.pack_tokens(spark, docs_of(messy), SF).collect()
    by_doc = {}
    for x in pieces:
        by_doc.setdefault((x["doc_id"], x["doc_tokens"]), []).append((x["start"], x["length"]))
    ids = [i for i, _ in messy]
    for (i, n), parts in by_doc.items():
        assert sum(k for _, k in parts) == n * max(1, ids.count(i) if i == 8 else 1)


def test_a_crowd_of_near_copies(spark, docs_of):
    """One base, hundreds of copies with a word changed: one stays, and unlike texts that share a passage do too."""
    r = random.Random(21)
    base = [f"b{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        c = list(base)
        c[r.randrange(150)] = f"c{i}"
        rows.append((i, " ".join(c)))
    rows += [(1000 + i, " ".join(base[:30] + [f"u{r.randrange(10**6)}" for _ in range(120)])) for i in range(60)]
    kept = {x["doc_id"] for x in P.drop_near_duplicates(spark, docs_of(rows), SF).collect()}
    assert kept == {0} | set(range(1000, 1060))


def test_near_duplicates_come_from_simhash(spark, docs_of, monkeypatch):
    """The stage takes its candidates from the SimHash operator, and only pairs in one of its balls."""
    from tessera.llm import nearcopies, simhash

    seen = []
    monkeypatch.setattr(nearcopies, "meetings", lambda signed: seen.append(simhash.meetings(signed)) or seen[-1])
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "changed", *words[51:]])), (3, "a text like no other one of them")]
    assert {x["doc_id"] for x in P.drop_near_duplicates(spark, docs_of(rows), SF).collect()} == {1, 3}
    groups = [x["n"] for x in seen[0].groupBy("band").agg(F.countDistinct("k").alias("n")).collect()]
    assert max(groups) == 2
    monkeypatch.setattr(nearcopies, "meetings", lambda signed: simhash.meetings(signed).limit(0))
    assert P.drop_near_duplicates(spark, docs_of(rows), SF).count() == 3


def test_near_duplicates_take_few_jobs(spark, docs_of):
    """Chains of copies that no round connects whole: the driver keeps something of every job."""
    r = random.Random(8)
    rows = []
    for g in range(12):
        c = [f"g{g}v{r.randrange(10**6)}" for _ in range(150)]
        for i in range(25):
            for _ in range(2):
                c[r.randrange(150)] = f"c{i}x{r.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(c)))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    began = jobs()
    kept = {x["doc_id"] for x in P.drop_near_duplicates(spark, docs_of(rows), SF).collect()}
    assert kept == {100 * g for g in range(12)}
    assert jobs() - began < 230
