import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, print string, n int, words string, _id long, key string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["ta", "re", "li", "mon", "des", "ver", "ing", "ous", "é", "pa"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(n))


def rows(texts):
    return [(i, t, "en", "a" if k % 3 else "b", len(t or ""), 9, "x", 1, "w", 2, "k") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty, wordless and long texts, copies, near copies, a chain, repeated rows, a shared passage."""
    base, passage = prose(1, 120), prose(2, 70)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    further = near.copy()
    further[20] = "again"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, " ".join(further)), (4, None), (5, ""), (6, " \t\n "), (None, base),
        (8, "one two"), (9, "One  Two"), (10, prose(3, 6000)), (11, prose(4, 40) + "\n" + passage + "\n" + prose(5, 40)),
        (12, prose(6, 30) + "\n" + passage + "\n" + prose(7, 90)), (13, prose(8, 200)), (13, prose(8, 200)), (14, "a b c d"),
    ]
    return rows(texts)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
