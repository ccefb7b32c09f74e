"""The string kernel against its definition, and the classifier's held-out accuracy."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as X
from tessera.llm import common as C

SF = "/root/testdata/sf0.1"


def plain_kernel(s, t):
    """The gap-weighted count of common subsequences, by its definition."""
    def weights(w):
        out = Counter()
        for places in combinations(range(len(w)), X.ORDER):
            if (span := places[-1] - places[0] + 1) <= X.REACH:
                out[tuple(w[i] for i in places)] += X.DECAY**span
        return out

    a, b = weights("^" + s), weights("^" + t)
    both = lambda x, y: sum(v * y[k] for k, v in x.items())
    return 0.0 if not a or not b else (both(a, b) / (both(a, a) * both(b, b)) ** 0.5) ** X.POWER


def test_kernel():
    words = ["idiot", "idxiot", "moron", "oron", "aabbaabb", "abababab", "xyz", "ido", "mo", "", "verylongwordofmanyletters", "öüäß", "idiotidiot"]
    marks = ["idiot", "abab", "ido", "aabba", "öüä"]
    got = X.Model(marks).kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            want = plain_kernel(w, m)
            assert np.isclose(got[i, j], want if want >= X.LEAST else 0, rtol=1e-4, atol=1e-6), (w, m)


def test_kernel_is_positive_definite():
    """Of any words: what is rounded to 0 aside."""
    r = random.Random(4)
    words = sorted({"".join(r.choice("aeinst") for _ in range(r.randrange(3, 10))) for _ in range(200)})
    gram = X.Model(words).kernel(words).astype(float)
    assert np.allclose(np.diag(gram), 1, atol=1e-5) and np.allclose(gram, gram.T, atol=1e-5)
    assert np.linalg.eigvalsh(gram).min() > -len(words) * X.LEAST


def test_units():
    assert [X.unit(w) for w in ("Plain", "i-d.i*o-t", "st0p!", "12.5", "|", "é1")] == ["Plain", "idiot", "stopi", "", "", "éi"]


@pytest.fixture(scope="module")
def trained():
    r = random.Random(3)
    clean = ["".join(r.choice("aeionrsthld") for _ in range(r.randrange(2, 9))) for _ in range(800)]
    bad = ["grubnik", "fozzwit", "plonker"]
    texts, labels = [], []
    for i in range(600):
        w = [r.choice(clean) for _ in range(r.randrange(20, 120))]
        y = i % 6 == 0
        if y:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(x + "." if j % 12 == 11 else x for j, x in enumerate(w)))
        labels.append(int(y))
    return X.fit(texts, labels), clean, bad, texts, labels


def test_insults_with_inserted_characters(trained):
    model, clean, bad, texts, labels = trained
    scorer, r = X.Scorer(model), random.Random(9)
    score = lambda ts: model.score(scorer.traits(ts))
    for change in (lambda w: w, str.upper, lambda w: "-".join(w), lambda w: " ".join(w), lambda w: w[:3] + "x" + w[3:], lambda w: w[:2] + w[1] + w[2:], lambda w: w + "!", lambda w: w[:4] + "*" + w[4:]):
        got = [s for w in bad for s in score([" ".join([*r.choices(clean, k=30), change(w), *r.choices(clean, k=30)])])]
        assert min(got) > 0.5, change(bad[0])
    innocent = score([" ".join(r.choices(clean, k=300)) for _ in range(100)])
    assert (innocent < 0.5).all()
    assert (score(texts) >= 0.5).astype(int).tolist() == labels


def test_very_long_words_and_texts(trained):
    model, clean, bad, *_ = trained
    scorer = X.Scorer(model)
    got = model.score(scorer.traits(["", " ", "x" * 10_000, "e" * 500 + bad[0] + "e" * 500, " ".join(clean) * 30 + f" {bad[1]}", "a b c", "|"]))
    assert (got[[0, 1, 2, 5, 6]] < 0.5).all() and got[4] > 0.5 and got[0] == got[1]


def test_without_labels(spark, docs_of, messy):
    for rows in ([], [(4, 1)], [(4, 0)], [(None, 1), (4, None)]):
        got = X.toxicity(docs_of(messy), spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == len(messy) and not any(r["predicted"] for r in got)
    assert X.toxicity(docs_of([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    # labels of the fold are never read: turned round they change nothing
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = X.toxicity(docs, turned).withColumnRenamed("doc_id", "i").join(labels, F.col("i") == F.col("doc_id")).where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["i"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = np.mean([r["predicted"] == r["toxic"] for r in got])
    clean_kept = np.mean([r["predicted"] == 0 for r in got if r["toxic"] == 0])
    recall = np.mean([r["predicted"] for r in got if r["toxic"] == 1])
    assert recall >= 0.9 and right > 0.97 and clean_kept > 0.98


def test_a_stem_of_many_variants_keeps_no_other_out():
    """Sixty variants of one stem, each in more toxic texts than the other stem, which has to be found all the same."""
    r = random.Random(11)
    clean = ["".join(r.choice("aeionrsthld") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    variants = ["grubnik" + x + y for x in "bcfgjkmpqv" for y in "uwxyzb"]
    texts, labels = [], []
    for i in range(900):
        w = [r.choice(clean) for _ in range(40)]
        if i % 3 == 0:
            for x in ["fozzwit"] if i % 90 == 0 else r.sample(variants, 6):
                w.insert(r.randrange(len(w)), x)
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = X.fit(texts, labels)
    got = model.score(X.Scorer(model).traits([" ".join([*r.choices(clean, k=30), x]) for x in ("fozzwit", "fozzxwit", variants[7], "")]))
    # the rare stem is found; with a character put in it's a hundred times as likely as nothing at all
    assert got[0] > 0.5 and got[2] > 0.5 and got[1] > 50 * got[3] and got[3] < 0.5
    assert all(model.kernel([v]).max() >= X.COVERED for v in variants)
