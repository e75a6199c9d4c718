import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import detectors as D
from graphloom.operators import graph as G
from graphloom.operators import eigen
from graphloom.operators import leiden as L
from graphloom.operators.components import connected_components
from tests.test_graph import cliques, graph, parts, sbm


@pytest.mark.parametrize("cap", [None, 12])
def test_where_the_rounds_run_changes_nothing(spark, monkeypatch, cap):
    e, v = graph(spark, [*sbm(seed=7, size=25), ("x1", "x2"), ("x2", "x3"), ("x3", "x1")], ["alone"])
    near = L.partition(L.prepare(e, v), cap)
    monkeypatch.setattr(L, "LOCAL", 0)
    monkeypatch.setattr(L, "STEP", 50)
    g = L.prepare(e, v)
    assert isinstance(g.links, L._Spread)
    far = L.partition(g, cap)
    assert (near[0] == far[0]).all() and near[1] == far[1]


def test_no_other_method_above_a_size(spark, monkeypatch):
    """Leiden was label propagation in components of over 200,000 nodes."""
    monkeypatch.setattr(D, "label_propagation", None)
    n = 200_001
    v = spark.range(n).select(F.format_string("n%07d", "id").alias("node"))
    e = spark.range(n - 1).select(F.format_string("n%07d", "id").alias("src"), F.format_string("n%07d", F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    m = D.leiden(e, v)
    sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("n"), (F.max("node") > F.min("node")).alias("many")).agg(F.sum("n"), F.count(F.lit(1))).first()
    assert sizes[0] == n and 100 < sizes[1] < n / 20


def test_sizes_keep_to_the_limit_and_parts_are_connected(spark):
    e, v = graph(spark, sbm(seed=9, size=30))
    label, held = L.partition(L.prepare(e, v), 10)
    assert held and np.bincount(label).max() <= 10
    m = D.leiden(e, v)
    inner = e.join(m.withColumnRenamed("node", "src").withColumnRenamed("community", "a"), "src").join(m.withColumnRenamed("node", "dst").withColumnRenamed("community", "b"), "dst").where("a = b")
    assert connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select("component").distinct().count() == len(parts(m))


def test_a_limit_that_is_not_felt_is_reported(spark):
    e, v = graph(spark, cliques())
    g = L.prepare(e, v)
    assert not L.partition(g, 10)[1] and L.partition(g, 3)[1]
    assert len(parts(D.leiden_k(e, v, 2))) == 2


def brute_betweenness(pairs, nodes):
    nb = {x: set() for x in nodes}
    for a, b in pairs:
        nb[a].add(b)
        nb[b].add(a)
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, sigma, order = {s: 0}, {s: 1.0}, [s]
        for x in order:
            for y in nb[x]:
                if y not in depth:
                    depth[y], sigma[y] = depth[x] + 1, 0.0
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    sigma[y] += sigma[x]
        delta = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for y in nb[x]:
                if depth[y] == depth[x] + 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if x != s:
                out[x] += delta[x]
    n = len(nodes)
    return {x: v / max((n - 1) * (n - 2), 1) for x, v in out.items()}


def test_betweenness_of_all_nodes_sends_no_table_to_the_driver(spark, monkeypatch):
    """Exact with every node a pivot; levels were joins that Spark made broadcasts of, with each node's name once for each pivot."""
    pairs = sbm(seed=2, size=8, p_in=0.5, p_out=0.05)
    e, v = graph(spark, pairs, ["alone"])
    monkeypatch.setattr(L, "STEP", 50)
    want = brute_betweenness(pairs, [r.node for r in v.collect()])
    got = {r.node: r.betweenness for r in G.betweenness_sampled(e, v, 100).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_eigenvector_equals_the_dense_one(spark):
    pairs = sbm(seed=4, size=10)
    e, v = graph(spark, pairs, ["alone"])
    nodes = sorted(r.node for r in v.collect())
    a = np.eye(len(nodes))
    for s, d in pairs:
        a[nodes.index(s), nodes.index(d)] = a[nodes.index(d), nodes.index(s)] = 1
    x = np.ones(len(nodes))
    for _ in range(8):
        x = a @ x
        x /= np.linalg.norm(x)
    got = {r.node: r.eigenvector for r in G.eigenvector_centrality(e, v, 8, tolerance=0.0).collect()}
    assert np.allclose([got[n] for n in nodes], x, atol=1e-12)


@pytest.mark.parametrize("colours", [1, 2, 5, 12])
def test_triangles_are_dealt_by_colour_and_counted_once(spark, monkeypatch, colours):
    """A join of all wedges did not need these classes, nor did it keep a task to some of the wedges."""
    monkeypatch.setattr(G, "COLOURS", colours)
    monkeypatch.setattr(G, "WEDGES", 7)
    pairs = sbm(seed=6, size=10)
    e, v = graph(spark, [*pairs, ("n000", "n000")], ["alone"])
    nodes = sorted(r.node for r in v.collect())
    a = np.zeros((len(nodes), len(nodes)))
    for s, d in pairs:
        a[nodes.index(s), nodes.index(d)] = a[nodes.index(d), nodes.index(s)] = 1
    t, deg = np.diag(a @ a @ a) / 2, a.sum(1)
    got = {r.node: (r.triangles, r.clustering) for r in G.clustering(e, v).collect()}
    assert [got[n][0] for n in nodes] == t.tolist()
    assert np.allclose([got[n][1] for n in nodes], t / np.maximum(deg * (deg - 1) / 2, 1))


@pytest.mark.parametrize("normalised", [True, False])
def test_leading_vectors_from_edges_equal_the_dense_ones(spark, monkeypatch, normalised):
    """Vectors are sent once for each block of rows, where a product was a join with every link."""
    monkeypatch.setattr(eigen, "STEP", 50)
    pairs = [(a, b, 1.0 + i % 3) for i, (a, b) in enumerate(sbm(seed=5, size=12))]
    e, v = graph(spark, pairs)
    nodes = sorted(r.node for r in v.collect())
    a = 1e-6 * np.eye(len(nodes))
    for s, d, w in pairs:
        a[nodes.index(s), nodes.index(d)] = a[nodes.index(d), nodes.index(s)] = w
    d = a.sum(1)
    dense = a / np.sqrt(np.outer(d, d)) if normalised else a / d.max()
    values, vectors = np.linalg.eigh(dense)
    order = np.argsort(-values if normalised else -np.abs(values))[:3]
    x, names, theta = eigen.leading_of(e, v, 3, normalised, by_size=not normalised)
    got = {r.node: [r[c] for c in names] for r in x.collect()}
    assert np.allclose(theta, values[order], atol=1e-4)
    assert np.allclose(np.abs(np.array([got[n] for n in nodes]).T @ vectors[:, order]), np.eye(3), atol=0.05)
