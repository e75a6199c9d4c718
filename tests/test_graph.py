import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import detectors as D
from graphloom.operators import eigen
from graphloom.operators import features as X
from graphloom.operators import graph as G
from graphloom.operators import merge
from graphloom.operators import quality as Q
from graphloom.operators.components import connected_components


def graph(spark, pairs, extra=()):
    nodes = sorted({x for p in pairs for x in p[:2]} | set(extra))
    rows = [(min(a, b), max(a, b), float(w[0]) if w else 1.0) for a, b, *w in pairs]
    return spark.createDataFrame(rows, "src string, dst string, weight double"), spark.createDataFrame([(n,) for n in nodes], "node string")


def cliques(k=5):
    a = [(f"a{i}", f"a{j}") for i in range(k) for j in range(i)]
    b = [(f"b{i}", f"b{j}") for i in range(k) for j in range(i)]
    return [*a, *b, ("a0", "b0", 0.5)]


def parts(m):
    out = {}
    for r in m.collect():
        out.setdefault(r.community, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def sbm(seed=42, blocks=4, size=50, p_in=0.3, p_out=0.02):
    rng = random.Random(seed)
    n = blocks * size
    return [(f"n{i:03}", f"n{j:03}") for i in range(n) for j in range(i) if rng.random() < (p_in if i // size == j // size else p_out)]


def rand_index(m, size=50):
    """Adjusted for chance."""
    label = {r.node: r.community for r in m.collect()}
    names = sorted(label)
    a = np.array([label[x] for x in names])
    b = np.array([int(x[1:]) // size for x in names])
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    c2 = lambda x: (x * (x - 1) / 2).sum()
    s, x, y, n = c2(t), c2(t.sum(1)), c2(t.sum(0)), len(a) * (len(a) - 1) / 2
    return (s - x * y / n) / ((x + y) / 2 - x * y / n)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 200)]
    p = {x: x for e in pairs for x in e}

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        p[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in p}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_measures_of_a_star(spark):
    e, v = graph(spark, [("hub", f"l{i}") for i in range(10)], ["alone"])
    deg = {r.node: r.degree for r in G.degrees(e, v).collect()}
    assert deg["hub"] == 10 and deg["alone"] == 0
    assert all(r.clustering == 0 for r in G.clustering(e, v).collect())
    rank = {r.node: r["rank"] for r in G.pagerank(e, v, 20).collect()}
    assert max(rank, key=rank.get) == "hub" and abs(sum(rank.values()) - 1) < 1e-9
    between = {r.node: r.betweenness for r in G.betweenness_sampled(e, v, 12).collect()}
    assert max(between, key=between.get) == "hub" and between["l1"] == 0
    assert {r.node: r.eigenvector for r in G.eigenvector_centrality(e, v, 60).collect()}["hub"] > 0.6


def test_clustering_and_common_neighbours(spark):
    e, v = graph(spark, cliques(4))
    c = {r.node: (r.triangles, round(r.clustering, 6)) for r in G.clustering(e, v).collect()}
    assert c["a1"] == (3, 1.0) and c["a0"] == (3, 0.5)
    assert {r.node: r.common for r in G.common_neighbors(e, v, "a1").collect()}["a2"] == 2


def test_merging(spark):
    raw = spark.createDataFrame([(1, "Bob", "p", "x"), (2, "bob", "p", "y"), (3, "Bob", "q", "z")], "seq int, title string, type string, description string")
    got = {(r.key, r.type): (r.title, r.description) for r in merge.merge_entities(raw).collect()}
    assert got == {("bob", "p"): ("Bob", "x; y"), ("bob", "q"): ("Bob", "z")}
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (2, "b", "a", 7.0)], "seq int, source string, target string, weight double")
    assert [tuple(r) for r in merge.canonical_edges(edges).collect()] == [("a", "b", 7.0)]


def test_quality(spark):
    e, v = graph(spark, cliques(), ["alone"])
    m = v.select("node", F.when(F.col("node").startswith("a") & (F.col("node") != "alone"), 0).otherwise(1).cast("bigint").alias("community")).where("node <> 'alone'")
    q = Q.modularity(e, m, v).first()[0]
    assert 0.4 < q < 0.5
    assert all(0 <= r.conductance <= 1 for r in Q.conductance(e, m, v).collect())
    assert Q.complete_singletons(m, v).count() == Q.complete_largest(m, v).count() == 11
    mix = {r.community: r for r in Q.edge_mix(e, m).collect()}
    assert mix[0].internal == 10 and mix[0].external == 1 and mix[0].density == 1.0
    assert [tuple(r) for r in Q.size_stats(m, 4).collect()] == [(2, 5.0, 5.0, 5, 5, 10, 0.5)]


def test_connected_cores(spark):
    e, v = graph(spark, [("a", "b"), ("b", "c"), ("d", "e")], ["f"])
    m = v.select("node", F.lit(1).cast("bigint").alias("community"))
    assert parts(Q.connected_cores(e, m, 3)) == [["a", "b", "c"]]
    assert Q.connected_cores(e, m, 4).count() == 0


@pytest.mark.parametrize("detect", [D.leiden, lambda e, v: D.spectral(e, v, 2), lambda e, v: D.score(e, v, 2), lambda e, v: D.nac2(e, v, 2)])
def test_two_cliques(spark, detect):
    e, v = graph(spark, cliques())
    got = parts(detect(e, v))
    assert got == [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]]


@pytest.mark.parametrize("name", ["leiden", "spectral", "score"])
def test_planted_partition(spark, name):
    e, v = graph(spark, sbm())
    m = D.leiden(e, v) if name == "leiden" else getattr(D, name)(e, v, 4)
    assert rand_index(m) >= 0.9
    assert m.count() == v.count()


@pytest.mark.parametrize("name", ["spectral", "score"])
def test_planted_partition_by_sparse_products(spark, monkeypatch, name):
    monkeypatch.setattr(D, "DENSE_LIMIT", 20)
    e, v = graph(spark, sbm(), ["alone"])
    m = getattr(D, name)(e, v, 5)
    assert rand_index(m.where("node <> 'alone'")) >= 0.9
    assert m.count() == v.count()


@pytest.mark.parametrize("by_size", [False, True])
def test_leading_vectors_equal_the_dense_ones(spark, by_size):
    e, v = graph(spark, sbm(seed=5))
    nodes = sorted(r.node for r in v.collect())
    a = eigen.adjacency(e, v, normalised=not by_size)
    dense = np.zeros((len(nodes), len(nodes)))
    for r in a.collect():
        dense[nodes.index(r.src), nodes.index(r.dst)] += r.w
    assert abs(dense - dense.T).max() < 1e-12
    values, vectors = np.linalg.eigh(dense)
    order = np.argsort(-np.abs(values) if by_size else -values)[:4]
    x, names, theta = eigen.leading(a, v, 4, by_size=by_size, tol=1e-6)
    got = {r.node: [r[c] for c in names] for r in x.collect()}
    mine = np.array([got[n] for n in nodes])
    assert np.allclose(theta, values[order], atol=1e-6)
    assert np.allclose(np.abs(mine.T @ vectors[:, order]), np.eye(4), atol=1e-3)


def test_reruns_agree(spark):
    e, v = graph(spark, sbm(seed=3, size=20))
    a, b = D.leiden(e, v), D.leiden(e.repartition(7), v.repartition(3))
    assert parts(a) == parts(b)


def test_hierarchy_and_exact_k(spark):
    e, v = graph(spark, sbm(size=15, p_in=0.5))
    h, parents = D.leiden_hierarchy(e, v, 8)
    assert {r.level for r in h.select("level").distinct().collect()} >= {0, 1}
    assert parents.where("parent = -1").count() > 0
    assert len(parts(D.to_exact_k(v.select("node", F.lit(0).cast("bigint").alias("community")), 3))) == 3


def test_allocation():
    assert D.allocate([10, 5, 1], 8) == [5, 2, 1]
    assert sum(D.allocate([4, 4, 4], 2)) == 3  # each component has one at least
    assert D.allocate([2, 2], 10) == [2, 8] or sum(D.allocate([2, 2], 10)) >= 4


def test_adjusted_covariates_equal_the_matrix_form(spark):
    pairs = cliques(4)
    e, v = graph(spark, pairs)
    nodes = [r.node for r in v.collect()]
    rng = np.random.default_rng(0)
    x = rng.standard_normal((len(nodes), 3))
    f = spark.createDataFrame([(n, f"f{j}", float(x[i, j])) for i, n in enumerate(nodes) for j in range(3)], "node string, f string, x double")
    a = np.zeros((len(nodes), len(nodes)))
    for r in e.collect():
        i, j = nodes.index(r.src), nodes.index(r.dst)
        a[i, j] = a[j, i] = r.weight
    a += 1e-6 * np.eye(len(nodes))
    d = a.sum(1)
    density = len(pairs) / (len(nodes) * (len(nodes) - 1) / 2)
    phi = d / (d + d.mean() * (1 + density))
    s = 1 / np.sqrt(d + 1e-10)
    z = phi[:, None] * x + (1 - phi[:, None]) * (0.5 * a @ x + 0.5 * (s[:, None] * a * s) @ x)
    got = {(r.node, r.f): r.x for r in X.adjust(e, v, f, loops=1e-6).collect()}
    assert all(abs(got[n, f"f{j}"] - z[i, j]) < 1e-9 for i, n in enumerate(nodes) for j in range(3))


def test_fingerprint_ignores_order(spark):
    e, _ = graph(spark, cliques())
    assert G.fingerprint(e).first() == G.fingerprint(e.orderBy(F.desc("dst")).repartition(3)).first()
