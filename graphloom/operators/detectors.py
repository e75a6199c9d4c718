"""Community detectors: linear algebra in one Arrow group for each connected component.

Graphs above ``DENSE_LIMIT`` nodes in a component never become a dense matrix:
spectral clustering and SCORE take their eigenvectors by sparse products
(``operators/eigen.py``), NAC2 the way below. Leiden is distributed at any size.
All results are ``membership(node, community)``; they are deterministic.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import features as X
from graphloom.operators import graph as G
from graphloom.operators import leiden as L
from graphloom.operators.eigen import leading_of
from graphloom.operators.order import with_position
from graphloom.session import materialize

DENSE_LIMIT = 3000


class Detector(Protocol):
    """Anything that partitions a graph."""

    def __call__(self, edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame: ...


# --- numeric kit -------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, restarts: int = 20, seed: int = 42, steps: int = 300) -> np.ndarray:
    """Lloyd's algorithm from k-means++ starts; the best of ``restarts``."""
    n = len(x)
    k = min(k, n)
    rng = np.random.default_rng(seed)
    best, cost = np.zeros(n, int), np.inf
    for _ in range(restarts):
        centres = [x[rng.integers(n)]]
        near = ((x - centres[0]) ** 2).sum(1)
        for _ in range(1, k):
            total = near.sum()
            i = rng.choice(n, p=near / total) if total > 0 else rng.integers(n)
            centres.append(x[i])
            near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
        c = np.array(centres)
        label = None
        for _ in range(steps):
            d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            for j in range(k):
                mine = label == j
                if mine.any():
                    c[j] = x[mine].mean(0)
        value = float(((x - c[label]) ** 2).sum())
        if value < cost - 1e-9:
            best, cost = label, value
    return best


def spectral_labels(a: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """K-means on the rows of the smallest eigenvectors of the normalised Laplacian; empty clusters get a node of the largest."""
    n = len(a)
    k = max(1, min(k, n))
    if k == 1:
        return np.zeros(n, int)
    if k == n:
        return np.arange(n)
    d = a.sum(1)
    s = 1 / np.sqrt(np.maximum(d, 1e-12))
    lap = np.eye(n) - s[:, None] * a * s[None, :] + 1e-6 * np.eye(n)
    vectors = np.linalg.eigh(lap)[1][:, :k]
    rows = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return fill_empty(kmeans(np.round(rows, 9), k, seed=seed), k, d)


def fill_empty(label: np.ndarray, k: int, degree: np.ndarray) -> np.ndarray:
    label = label.copy()
    for j in range(k):
        if not (label == j).any():
            sizes = np.bincount(label, minlength=k)
            donors = np.flatnonzero(label == sizes.argmax())
            if len(donors) > 1:
                label[donors[degree[donors].argmax()]] = j
    return label


def score_labels(a: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Ratios of the leading eigenvectors to the first, standardised, then k-means."""
    n = len(a)
    k = max(1, min(k, n))
    if k == 1:
        return np.zeros(n, int)
    if k == n:
        return np.arange(n)
    values, vectors = np.linalg.eigh(a)
    lead = vectors[:, np.argsort(-np.abs(values), kind="stable")[:k]]
    first = lead[:, :1]
    first = np.where(np.abs(first) < 1e-10, np.where(first < 0, -1e-10, 1e-10), first)
    r = np.clip(lead[:, 1:] / first, -np.log(max(n, 3)) * 10, np.log(max(n, 3)) * 10)
    r = (r - r.mean(0)) / (r.std(0) + 1e-8)
    return kmeans(np.round(r, 9), k, seed=seed)


# --- component-wise detectors -----------------------------------------------


def allocate(sizes: list[int], k: int) -> list[int]:
    """Clusters of each component: proportional, half to even, at least one, the last takes what is left; then repaired to ``k``."""
    total, out, left = sum(sizes), [], k
    for s in sizes[:-1]:
        out.append(max(1, round(k * s / total)))
        left -= out[-1]
    out.append(max(1, left))
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    up = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for _ in range(2 * k):
        grow = next((i for i in down if out[i] < sizes[i]), None) if sum(out) < k else None
        shrink = next((i for i in up if out[i] > 1), None) if sum(out) > k else None
        if grow is not None:
            out[grow] += 1
        elif shrink is not None:
            out[shrink] -= 1
        else:
            break
    return out


def k_allocation(comps: DataFrame, k: int) -> DataFrame:
    """``(component, n, k)``. Only the ``2k`` largest components are folded on the driver; any other gets one cluster."""
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(2 * k).toPandas()
    given = allocate(top["n"].astype(int).tolist(), k) if len(top) else []
    spark = comps.sparkSession
    found = spark.createDataFrame([(c, int(g)) for c, g in zip(top["component"], given, strict=True)], f"component {comps.schema['component'].dataType.simpleString()}, k int")
    return sizes.join(F.broadcast(found), "component", "left").select("component", "n", F.coalesce("k", F.lit(1)).alias("k"))


def by_component(edges: DataFrame, vertices: DataFrame, k: int, labels, large) -> DataFrame:
    """``labels(adjacency, k)`` in each component, one Arrow group each; ids are made unique by component.

    A component that gets one cluster needs no labels. One above ``DENSE_LIMIT``
    nodes takes ``large(edges, nodes, k)``, the same method on a sparse matrix;
    at most ``k`` components get more than one cluster, so these are few.
    """
    comps = materialize(G.components(edges, vertices), "components")
    share = materialize(k_allocation(comps, k), "shares")
    whole = comps.join(share.where("k = 1").select("component"), "component").select("node", "component", F.lit(0).alias("label"))
    loops = vertices.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).unionByName(loops)
    small = share.where((F.col("k") > 1) & (F.col("n") <= DENSE_LIMIT)).select("component", "k")
    rows = rows.join(comps.join(small, "component").withColumnRenamed("node", "src"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.array(sorted(set(pdf["src"])))
        s, d = np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"])
        a = np.zeros((len(nodes), len(nodes)))
        np.maximum.at(a, (s, d), pdf["weight"].to_numpy())
        a = np.maximum(a, a.T) + 1e-6 * np.eye(len(nodes))
        found = labels(a, int(pdf["k"].iloc[0]))
        return pd.DataFrame({"node": nodes, "component": pdf["component"].iloc[0], "label": found.astype(int)})

    out = rows.groupBy("component").applyInPandas(run, "node string, component string, label int").unionByName(whole)
    for big in share.where((F.col("k") > 1) & (F.col("n") > DENSE_LIMIT)).orderBy("component").collect():
        nodes = comps.where(F.col("component") == big["component"])
        own = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
        found = large(own, nodes.select("node"), big["k"])
        out = out.unionByName(found.select("node", F.lit(big["component"]).alias("component"), "label"))
    return numbered(out.select("node", F.struct("component", "label").alias("name")))


def _clusters(vectors: DataFrame, names: list[str], k: int) -> DataFrame:
    """``(node, label)`` by ``pyspark.ml`` k-means on the columns ``names``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = materialize(vectors.select("node", F.array(*[F.round(c, 9) for c in names]).alias("vector")), "embedding")
    v = v.select("node", array_to_vector("vector").alias("features"))
    model = KMeans(k=k, seed=42, maxIter=100, featuresCol="features", predictionCol="label").fit(v)
    return model.transform(v).select("node", F.col("label").cast("int").alias("label"))


def spectral_large(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``spectral_labels`` by sparse products: the smallest eigenvectors of the Laplacian are the leading ones of I minus it."""
    x, names, _ = leading_of(edges, nodes, k, normalised=True)
    norm = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))), F.lit(1e-12))
    return _clusters(x.select("node", *[(F.col(c) / norm).alias(c) for c in names]), names, k)


def score_large(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``score_labels`` by sparse products."""
    x, names, _ = leading_of(edges, nodes, k, normalised=False, by_size=True)
    n = nodes.count()
    first = F.when(F.abs("c0") < 1e-10, F.when(F.col("c0") < 0, -1e-10).otherwise(1e-10)).otherwise(F.col("c0"))
    most = float(np.log(max(n, 3)) * 10)
    r = x.select("node", *[F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c) / first)).alias(c) for c in names[1:]])
    stats = r.agg(*[f(c).alias(f"{c}{t}") for c in names[1:] for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return _clusters(r.select("node", *[((F.col(c) - stats[f"{c}m"]) / (stats[f"{c}s"] + 1e-8)).alias(c) for c in names[1:]]), names[1:], k)


def numbered(named: DataFrame) -> DataFrame:
    """``(node, name)`` to ``membership(node, community)``, communities counted from 0 by descending size."""
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    ids = with_position(sizes.select("name", (-F.col("n")).alias("less"), "first"), ["less", "first"], "community")
    return named.join(ids.select("name", "community"), "name").select("node", "community")


def spectral(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    return by_component(edges, vertices, k, spectral_labels, spectral_large)


def score(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """Eigenvector ratios on all nodes of a component."""
    return by_component(edges, vertices, k, score_labels, score_large)


def covariates(edges: DataFrame, vertices: DataFrame, types: DataFrame | None = None, embeddings: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """Standardised features in long, dense form; the structural ones, then types and embeddings where given."""
    wide = X.structural(edges, vertices, betweenness=True)
    f = X.long_form(wide, ["degree", "clustering", "betweenness", "pagerank", "eigen", "common"])
    if types is not None:
        f = f.unionByName(X.one_hot(types))
    if embeddings is not None:
        f = f.unionByName(X.embedding_features(embeddings, dim))
    n = vertices.count()
    return materialize(X.zscore(X.dense(f, vertices), n), "covariates")


def nac1(edges: DataFrame, vertices: DataFrame, k: int, features: DataFrame | None = None) -> DataFrame:
    """K-means on standardised network-adjusted covariates, by ``pyspark.ml``: distributed at any size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vertices.count()
    features = covariates(edges, vertices) if features is None else features
    z = X.zscore(X.adjust(edges, vertices, features, loops=1e-6), n)
    v = materialize(X.vectors(z), "nac1")
    model = KMeans(k=max(2, min(k, n)), seed=42, maxIter=50, featuresCol="features", predictionCol="label").fit(v.select(array_to_vector("vector").alias("features")))
    out = model.transform(v.select("node", array_to_vector("vector").alias("features")))
    return numbered(out.select("node", F.col("label").alias("name")))


def combined_similarity(a: np.ndarray, z: np.ndarray, alpha: float) -> np.ndarray:
    """max(0, alpha A_norm + (1 - alpha)(0.7 cosine + 0.3 rbf))."""
    s = 1 / np.sqrt(a.sum(1) + 1e-10)
    unit = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-8)
    d2 = np.maximum((z * z).sum(1)[:, None] - 2 * z @ z.T + (z * z).sum(1), 0)
    d = np.sqrt(d2)
    med = np.median(d[d > 1e-9]) if (d > 1e-9).any() else 1.0
    w = 0.7 * unit @ unit.T + 0.3 * np.exp(-d2 / (2 * (med**2 + 1e-8)))
    return np.maximum(alpha * (s[:, None] * a * s[None, :]) + (1 - alpha) * w, 0)


def nac2(edges: DataFrame, vertices: DataFrame, k: int, features: DataFrame | None = None, alpha: float | None = None) -> DataFrame:
    """Spectral clustering of adjacency blended with feature similarity; ``alpha`` follows the modularity of the components.

    Needs all nodes in one matrix, so it is for graphs up to ``DENSE_LIMIT``
    nodes; above that ``nac1`` on the same covariates takes over.
    """
    from graphloom.operators.quality import modularity

    n = vertices.count()
    features = covariates(edges, vertices) if features is None else features
    if n > DENSE_LIMIT:
        return nac1(edges, vertices, k, features)
    if alpha is None:
        comps = G.components(edges, vertices).select("node", F.col("component").alias("community"))
        alpha = 0.3 + 0.4 * modularity(edges, comps, vertices).first()[0]
    z = X.vectors(X.adjust(edges, vertices, features, density_scaled=False))
    rows = z.select(F.lit(0).alias("g"), "node", "vector", F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight"))
    rows = rows.unionByName(edges.select(F.lit(0).alias("g"), F.col("src").alias("node"), F.lit(None).cast("array<double>").alias("vector"), "dst", F.col("weight").cast("double").alias("weight")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"].isna()].sort_values("node")
        nodes, zz = own["node"].to_numpy(), np.vstack(own["vector"].to_list())
        e = pdf[~pdf["dst"].isna()]
        a = np.zeros((len(nodes), len(nodes)))
        s, d = np.searchsorted(nodes, e["node"]), np.searchsorted(nodes, e["dst"])
        a[s, d] = e["weight"]
        a = np.maximum(a, a.T)
        label = spectral_labels(combined_similarity(a, zz, alpha), k)
        if len(np.unique(label)) < k / 2:
            label = kmeans(zz, k)
        return pd.DataFrame({"node": nodes, "name": label.astype(int)})

    return numbered(rows.groupBy("g").applyInPandas(run, "node string, name int"))


def leiden(edges: DataFrame, vertices: DataFrame, max_size: int | None = None) -> DataFrame:
    """Modularity within each component by ``operators/leiden.py``, at any size."""
    g = L.prepare(edges, vertices)
    found = materialize(L.named(g.ids, L.partition(g, max_size)[0]), "leiden")
    g.links.drop()
    return numbered(found)


def leiden_hierarchy(edges: DataFrame, vertices: DataFrame, max_size: int = 10, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """``hierarchy(level, node, community)`` and ``parents(community, parent)``; communities above ``max_size`` are divided again."""
    from graphloom.operators import quality as Q

    top = materialize(leiden(edges, vertices), "leiden")
    out = top.select(F.lit(0).alias("level"), "node", "community")
    parents = top.select("community").distinct().withColumn("parent", F.lit(-1).cast("bigint"))
    cur = top
    for level in range(1, levels):
        inner = Q.next_level_edges(edges, cur, max_size)
        big = cur.groupBy("community").count().where(F.col("count") > max_size).select("community")
        nodes = materialize(cur.join(big, "community", "left_semi"), "leiden-nodes")
        if nodes.isEmpty():
            break
        base = (parents.agg(F.max("community")).first()[0] or 0) + 1
        fine = leiden(inner.select("src", "dst", "weight"), nodes, max_size)
        fine = materialize(fine.select("node", (F.col("community") + base).alias("community")), "leiden")
        if fine.select("community").distinct().count() == nodes.select("community").distinct().count():
            break
        out = out.unionByName(fine.select(F.lit(level).alias("level"), "node", "community"))
        parents = parents.unionByName(fine.join(nodes.select("node", F.col("community").alias("parent")), "node").groupBy("community").agg(F.min("parent").alias("parent")))
        cur = fine
    return out, parents


def leiden_k(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """The size limit whose Leiden partition has nearest to ``k`` communities; one or two off are halved or merged away."""
    g = L.prepare(edges, vertices)
    tried: dict[int, tuple[int, np.ndarray, bool]] = {}

    def attempt(size: int) -> int:
        if size not in tried:
            label, held = L.partition(g, size)
            tried[size] = (len(np.unique(label)), label, held)
        return abs(tried[size][0] - k)

    lo, hi = 2, max(2, len(g.strength) // 2)  # counts fall as the limit grows, so halve the interval instead of sweeping it
    while lo < hi:
        mid = (lo + hi) // 2
        if attempt(mid) == 0:
            break
        count, _, held = tried[mid]
        if count > k and not held:  # the limit was not felt: a larger one gives the same partition
            break
        lo, hi = (mid + 1, hi) if count > k else (lo, mid)
    else:
        attempt(lo)
    best = min(tried, key=lambda s: (abs(tried[s][0] - k), s))
    m = numbered(materialize(L.named(g.ids, tried[best][1]), "leiden-k"))
    g.links.drop()
    return to_exact_k(materialize(m, "leiden-k"), k) if 0 < abs(tried[best][0] - k) <= 2 else m


def to_exact_k(membership: DataFrame, k: int) -> DataFrame:
    """Halves the largest communities (by node order) or merges the two smallest until there are ``k``."""
    m = membership
    for _ in range(100):
        sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
        count = sizes.count()
        if count == k:
            break
        if count < k:
            top = sizes.orderBy(F.desc("n"), "community").first()
            if top["n"] < 2:
                break
            new = m.agg(F.max("community")).first()[0] + 1
            rank = F.row_number().over(Window.partitionBy("community").orderBy("node"))
            split = (F.col("community") == top["community"]) & (F.col("r") > top["n"] // 2)
            m = m.withColumn("r", rank).select("node", F.when(split, F.lit(new)).otherwise(F.col("community")).alias("community"))
        else:
            small = sizes.orderBy("n", "community").limit(2).collect()
            m = m.select("node", F.when(F.col("community") == small[0]["community"], F.lit(small[1]["community"])).otherwise(F.col("community")).alias("community"))
        m = materialize(m, "exact-k")
    return m


def label_propagation(edges: DataFrame, vertices: DataFrame, rounds: int = 8) -> DataFrame:
    """The distributed way for giant components: each node takes its neighbours' heaviest label (ties: the smallest)."""
    nb = materialize(G.both_ways(edges).where("node <> nbr"), "lpa-edges")
    cur = vertices.select("node", F.col("node").alias("label"))
    for i in range(rounds):
        vote = nb.join(cur.withColumnRenamed("node", "nbr"), "nbr").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = vote.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("neg"), "label")).alias("b")).select("node", F.col("b.label").alias("new"))
        # Half of the nodes move in a round, so two sides of an edge don't swap for ever.
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        cur = materialize(cur.join(best, "node", "left").select("node", F.when(moves, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label")), "lpa")
    return numbered(cur.select("node", F.col("label").alias("name")))


def kmeans_embeddings(embeddings: DataFrame, k: int) -> DataFrame:
    """``(node, vector)`` by ``pyspark.ml`` k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = embeddings.select("node", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=42, maxIter=40).fit(v)
    return numbered(model.transform(v).select("node", F.col("prediction").alias("name")))
