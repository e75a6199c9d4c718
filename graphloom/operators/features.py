"""Node features and network-adjusted covariates in long form ``(node, f, x)``: one row for each feature that is not 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G


def structural(edges: DataFrame, vertices: DataFrame, anchor: str | None = None, betweenness: bool = False) -> DataFrame:
    """``(node, degree, clustering, pagerank, eigen, common[, betweenness])``; ``eigen`` is the z-scored degree."""
    first = anchor if anchor is not None else vertices.agg(F.min("node")).first()[0]
    out = G.degrees(edges, vertices).select("node", F.col("degree").cast("double").alias("degree"))
    out = out.join(G.clustering(edges, vertices).select("node", "clustering"), "node")
    out = out.join(G.pagerank(edges, vertices, rounds=100, weighted=False, tolerance=1e-6).select("node", F.col("rank").alias("pagerank")), "node")
    out = out.join(G.degree_zscore(edges, vertices).select("node", F.col("zscore").alias("eigen")), "node")
    out = out.join(G.common_neighbors(edges, vertices, first).select("node", F.col("common").cast("double").alias("common")), "node")
    return out.join(G.betweenness_sampled(edges, vertices), "node") if betweenness else out


def one_hot(types: DataFrame) -> DataFrame:
    """``(node, type)`` as long features ``type=...``; a node without a type has none."""
    return types.where("type IS NOT NULL").select("node", F.concat(F.lit("type="), "type").alias("f"), F.lit(1.0).alias("x")).distinct()


def long_form(wide: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).cast("double").alias("x")) for n in names])
    return wide.select("node", F.explode(pairs).alias("p")).select("node", "p.f", "p.x")


def embedding_features(embeddings: DataFrame, dim: int) -> DataFrame:
    """``(node, vector)`` padded or cut to ``dim`` features ``e0000``..."""
    return embeddings.select("node", F.posexplode(F.slice("vector", 1, dim)).alias("i", "x")).select("node", F.concat(F.lit("e"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("f"), F.col("x").cast("double").alias("x"))


def zscore(features: DataFrame, n: int) -> DataFrame:
    """Every feature centred and scaled over all ``n`` nodes, absent ones being 0; dense afterwards in the features given."""
    s = features.groupBy("f").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    s = s.select("f", (F.col("s") / n).alias("mean"), F.sqrt(F.greatest(F.col("ss") / n - F.pow(F.col("s") / n, 2), F.lit(0.0))).alias("std"))
    return features.join(s, "f").select("node", "f", ((F.col("x") - F.col("mean")) / (F.col("std") + 1e-8)).alias("x"))


def dense(features: DataFrame, vertices: DataFrame) -> DataFrame:
    """All (node, f): features of a graph are a few dozen, so this is nodes x features, not a product of tables that grow."""
    names = features.select("f").distinct()
    grid = vertices.select("node").join(F.broadcast(names))
    return grid.join(features, ["node", "f"], "left").select("node", "f", F.coalesce("x", F.lit(0.0)).alias("x"))


def adjust(edges: DataFrame, vertices: DataFrame, features: DataFrame, density_scaled: bool = True, loops: float = 0.0, n: int | None = None, m: int | None = None) -> DataFrame:
    """Network-adjusted covariates ``phi x + (1 - phi) neighbours``, from ``features(node, f, x)``.

    Neighbours are half the weighted sum and half the sum scaled by both ends'
    degrees; ``phi`` = d / (d + mean d (1 + density)). One join of edges with
    features, one partially aggregated group-by.
    """
    n = vertices.count() if n is None else n
    m = edges.count() if m is None else m
    e = G.with_self_loops(edges, vertices, loops) if loops else edges
    links = G.both_ways(e).groupBy("node", "nbr").agg(F.sum("weight").alias("w"))
    deg = vertices.select("node").join(links.groupBy("node").agg(F.sum("w").alias("d")), "node", "left").select("node", F.coalesce("d", F.lit(0.0)).alias("d"))
    density = m / (n * (n - 1) / 2) if n > 1 else 0.0
    mean = F.col("mean")
    phi = F.col("d") / (F.col("d") + F.when(mean > 0, mean).otherwise(1.0) * (1 + density if density_scaled else 1.0))
    deg = deg.join(F.broadcast(deg.agg(F.avg("d").alias("mean")))).select("node", "d", phi.alias("phi"))  # one row
    scaled = links.join(deg.select("node", F.col("d").alias("di")), "node").join(deg.select(F.col("node").alias("nbr"), F.col("d").alias("dj")), "nbr")
    scaled = scaled.select("node", "nbr", (0.5 * F.col("w") + 0.5 * F.col("w") / F.sqrt((F.col("di") + 1e-10) * (F.col("dj") + 1e-10))).alias("a"))
    near = scaled.join(features.withColumnRenamed("node", "nbr"), "nbr").groupBy("node", "f").agg(F.sum(F.col("a") * F.col("x")).alias("near"))
    out = features.join(near, ["node", "f"], "left").join(deg.select("node", "phi"), "node")
    return out.select("node", "f", (F.col("phi") * F.col("x") + (1 - F.col("phi")) * F.coalesce("near", F.lit(0.0))).alias("x"))


def vectors(features: DataFrame) -> DataFrame:
    """Long form to ``(node, vector array<double>)`` in order of feature names."""
    return features.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "x"))), lambda p: p["x"]).alias("vector"))

