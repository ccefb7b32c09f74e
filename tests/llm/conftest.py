import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, src long, fp long, node long, hash long, n int, blob string, bucket int, kept string, shard int"


def make(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 1, 1, 1, 1, 1, "b", 1, "k", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text): nulls, empties, white space of all kinds, repeats, ties, near copies and a very long text."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "中文", "don't", "😀", "A|b", "x.y"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(40)
    words = base.split()
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a b c"), (6, "a b c"), (7, "A  B\tc"), (None, "null id text here now"), (8, base), (9, base), (10, " ".join(words[:60] + ["new"] + words[60:]))]
    rows += [(11, " ".join(words[:-1])), (12, text(30) + " " + passage), (13, passage + " " + text(25)), (14, text(10) + " " + passage + " " + text(3) + " " + passage), (15, "same " * 200), (16, text(20000)), (8, base), (17, "\x1c odd\x85space\xa0here  "), (18, "x" * 5000)]
    return rows + [(100 + i, text(r.randrange(1, 60))) for i in range(25)]
