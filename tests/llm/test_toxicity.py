import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import queries, toxicity


def rows(n, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["Rotter", "rotters", "swine"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    d, y = rows(900)
    docs, labels = spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~queries.held_out())
    got = toxicity.score(docs, model).withColumn("h", queries.held_out()).where("h").collect()
    truth = dict(y)
    assert len(got) > 200
    assert sum((r.score >= 0.7) == truth[r.doc_id] for r in got) / len(got) >= 0.97
    again = toxicity.fit(docs.repartition(7), labels, ~queries.held_out())
    assert np.allclose(model.w, again.w) and model.b == again.b


def test_factors_learn_a_pair_that_weights_miss():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(1500):
        a, b = (int(v) for v in rng.random(2) < 0.5)
        xs.append(np.array(sorted([1] * a + [2] * b + [10 + int(rng.integers(50))])))
        ys.append(float(a and b))
    m = toxicity.train(xs, np.array(ys), steps=600)
    i, j = (int(np.flatnonzero(m.terms == t)[0]) for t in (1, 2))
    z = lambda *k: m.b + m.w[list(k)].sum() + (m.v[i] @ m.v[j] if len(k) == 2 else 0)
    assert z(i, j) > 0 > max(z(i), z(j))


def test_a_pair_is_learned_of_which_neither_term_tells_anything(spark):
    """The label says whether two words agree; the single words are as frequent in both classes."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(vocab) for _ in range(15)] + ["insult" if a else "praise", "they" if b else "someone"]
        rng.shuffle(w)
        docs.append((str(i), " ".join(w), 1))
        labels.append((str(i), int(a == b)))
    df = spark.createDataFrame(docs, ["doc_id", "text", "__text"])
    lab = spark.createDataFrame(labels, "doc_id string, toxic int")
    model = toxicity.fit(df, lab, ~queries.held_out())
    assert {toxicity.term_hash(t) for t in ("insult", "praise", "they", "someone")} <= set(model.terms.tolist())
    got = toxicity.score(df, model).withColumn("h", queries.held_out()).where("h").collect()
    truth = dict(labels)
    assert got[0].asDict().keys() == {"doc_id", "__text", "score", "h"} and len(got) > 700
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in got) / len(got) > 0.97


def test_train_and_score_equal_plain_sums():
    rng = np.random.default_rng(2)
    xs = [np.unique(rng.integers(0, 40, 12)) for _ in range(400)]
    ys = np.array([float(3 in x and 5 in x or 7 in x) for x in xs])
    m = toxicity.train(xs, ys)
    object.__setattr__(m, "_lookup", {toxicity.term_hash(f"w{chr(97 + k % 26)}{'x' * (k // 26)}"): i for i, k in enumerate(m.terms.tolist())})
    n = len(m.terms)
    for _ in range(20):
        mine = sorted(rng.choice(n, size=min(n, 5), replace=False).tolist())
        z = m.b + sum(m.w[i] for i in mine) + sum(float(m.v[i] @ m.v[j]) for i in mine for j in mine if i < j)
        s = m.v[mine].sum(axis=0)
        assert abs(z - (m.b + m.w[mine].sum() + 0.5 * float((s * s).sum() - (m.v[mine] ** 2).sum()))) < 1e-9
    text = " ".join(f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in m.terms.tolist())
    z = m.b + m.w.sum() + sum(float(m.v[i] @ m.v[j]) for i in range(n) for j in range(i + 1, n))
    assert abs(m(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_edges(spark, docs, empty, corpus):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, F.lit(True))
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), model)
    assert got.count() == len(corpus) and got.agg(F.max("score")).first()[0] < 0.01
    assert toxicity.score(empty, model).count() == 0
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, one, F.lit(True))).agg(F.min("score")).first()[0] > 0.99
