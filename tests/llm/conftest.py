import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with exact copies, near copies, shared passages, nulls, empties, repeated rows and one long text."""
    rng = random.Random(5)
    passage = words(rng, 120)
    rows = []
    for i in range(60):
        t = words(rng, rng.randint(5, 150))
        if i % 6 == 0:
            t = t + " " + passage
        if i % 10 == 3:
            t = passage + "\n\n" + t
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    base = words(rng, 300)
    for i in range(60, 75):
        w = base.split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "en", "hot", 0))
    rows += [(80 + i, "one and the same short text", "de", "hot", 27) for i in range(12)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\t ", "en", "s1", 4), (103, "é ñ 日本 \U0001f600 " * 30, "es", "s2", 0)]
    rows += [(104, words(rng, 4000), "en", "s3", 0), (105, "a" * 5000, "en", "s3", 5000), (3, rows[3][1], "en", "s3", 0), (None, "no id here", "en", None, 0)]
    return rows


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
