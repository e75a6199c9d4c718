import math

import numpy as np
import pytest

from graphloom.operators import pairs as P


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 6))
    x[7] = x[3]  # an exact copy
    x[9] = x[5] + 1e-7
    group = [i % 2 for i in range(36)] + [5, 5, 6, 7]
    return [(i, group[i], x[i].tolist()) for i in range(40)]


def brute(rows):
    pairs, found = {}, {}
    for i, g, x in rows:
        for j, h, y in rows:
            if g == h and i < j and x is not None and y is not None:
                pairs[i, j] = (g, float(np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y))), math.dist(x, y))
    for g in {p[0] for p in pairs.values()}:
        if d := [p[2] for p in pairs.values() if p[0] == g and p[2] > 0]:
            found[g] = float(np.median(d))
    return pairs, found


@pytest.mark.parametrize("block", [3, 2048])
def test_all_pairs_equal_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "ROWS", 2)
    rows = [*rows, (40, 0, None), (41, None, rows[0][2])]
    v = spark.createDataFrame(rows, "id long, grp int, vector array<double>")
    pairs, medians = brute(rows)
    got = {(r.a, r.b): r.cosine for r in P.cosine_pairs(v, "id", "grp", 0.1).collect()}
    assert set(got) == {p for p, (_, c, _) in pairs.items() if c >= 0.1}
    assert all(abs(c - pairs[p][1]) < 1e-12 for p, c in got.items())
    got = {(r.a, r.b): r.rbf for r in P.rbf_pairs(v, "id", "grp").collect()}
    assert {p for p, r in got.items() if r is None} == {(i, 40) for i, g, _ in rows if g == 0 and i < 40}
    got = {p: r for p, r in got.items() if r is not None}
    want = {p: math.exp(-d * d / (2 * (medians[g] ** 2 + 1e-8))) for p, (g, _, d) in pairs.items()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    got = {(r.a, r.b): r.w for r in P.similarity_pairs(v, "id", "grp").collect()}
    assert all(abs(got[p] - max(0, 0.35 * pairs[p][1] + 0.15 * want[p])) < 1e-12 for p in want)


def test_a_group_is_dealt_over_cells(spark, rows, monkeypatch):
    """No task holds a whole group, and a cell holds two blocks at most."""
    monkeypatch.setattr(P, "BLOCK", 4)
    v = spark.createDataFrame([(i, 0, x) for i, _, x in rows], "id long, grp int, vector array<double>")
    sizes = [r["count"] for r in P.cells(v, "id", "grp").groupBy("i", "j").count().collect()]
    assert len(sizes) == 55 and max(sizes) == 8


def test_a_vector_without_length_has_cosine_nan_as_in_sql(spark):
    v = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0])], "id long, grp int, vector array<double>")
    assert [math.isnan(r.cosine) for r in P.cosine_pairs(v, "id", "grp", 0.3).collect()] == [True]
