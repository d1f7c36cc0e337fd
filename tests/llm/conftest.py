import random

import pytest
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string, host string, payload string"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, kept string, id string"


def prose(seed, n, extra=()):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(("an", "the", "ti", "on", "er", "re", "st", "ing")) for _ in range(rng.randint(1, 4))))
        if extra and rng.random() < 0.05:
            out.append(rng.choice(extra))
    return " ".join(out)


def document_rows():
    """Nulls, empties, repeats, ties, long texts, near copies, shared passages, columns with clashing names."""
    rng = random.Random(5)
    shared = prose(900, 120)
    rows = []
    for i in range(60):
        words = prose(i, 130).split()
        rows.append((i, " ".join(words)))
        if i % 3 == 0:  # near copies: one word differs
            words[rng.randrange(len(words))] = "changed"
            rows.append((100 + i, " ".join(words)))
        if i % 4 == 0:
            rows.append((200 + i, prose(300 + i, 60) + " " + shared + "\n" + prose(400 + i, 60)))
    rows += [(500 + i, prose(1, 130)) for i in range(30)]  # a hot group of copies
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "one two"), (604, "one two"), (605, "ONE two"), (606, "a"), (607, "x" * 3000)]
    rows += [(608, prose(7, 40_000)), (609, "Ünï çödé ñ 日本語   \x85 \x1c end"), (610, "same line\nsame line\nother\nsame line"), (611, "ab " * 500)]
    rows += [(0, prose(0, 130)), (0, prose(0, 130)), (None, prose(12, 130)), (None, None), (612, "# $ " * 60 + prose(13, 60)), (613, shared)]
    return [(i, t, "en" if (i or 0) % 5 else None, "src0", None if t is None else len(t), "clash", "clash") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter(F.lit(False))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(60)] + [(1, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 1)]
    return spark.createDataFrame(rows, LABELS)
