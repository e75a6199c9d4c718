"""Graph measures over ``edges(src, dst, weight)``, undirected, ``src < dst``, and ``vertices(node)``.

No measure builds an adjacency matrix: each is joins, group-bys or passes on edges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.leiden import named, spread
from graphloom.operators.order import with_position
from graphloom.session import materialize


def both_ways(edges: DataFrame) -> DataFrame:
    """``(node, nbr, weight)``; a self loop appears once."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "weight"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(node, degree, strength)``; a self loop counts twice in the degree; isolates have 0."""
    d = both_ways(edges).groupBy("node").agg(F.sum(F.when(F.col("node") == F.col("nbr"), 2).otherwise(1)).alias("degree"), F.sum("weight").alias("strength"))
    return vertices.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def combined_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    d = degrees(edges, vertices).select("node", "degree")
    out = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    return out.select("src", "dst", (F.col("ds") + F.col("dd")).alias("combined_degree"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(node, component)`` of every vertex; the component is its smallest node."""
    ids, links = spread(edges, vertices, weighted=False)
    label = links.components()
    links.drop()
    found = materialize(named(ids, label, "low"), "components")
    return found.join(ids.select(F.col("id").alias("low"), F.col("node").alias("component")), "low").select("node", "component")


def largest_component(comps: DataFrame) -> DataFrame:
    """Its nodes; of components of one size the one with the smallest node."""
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    return comps.join(F.broadcast(top), "component").select("node", "component")  # one row is broadcast


def graph_stats(edges: DataFrame, vertices: DataFrame, comps: DataFrame) -> DataFrame:
    n = vertices.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = comps.agg(F.countDistinct("component").alias("components"))
    one = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k").drop("k")
    root = F.floor(F.sqrt("nodes")).cast("bigint")
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(0.0)
    return one.select("nodes", "edges", "components", density.alias("density"), F.greatest("components", root).alias("natural_k"), F.greatest(F.lit(2).cast("bigint"), root).alias("default_k"))


#: Classes that triangles are dealt by; more where a task would hold over ``CELL`` edges.
COLOURS, CELL = 12, 4_000_000

#: Pairs of neighbours that one step of numpy sees.
WEDGES = 1_000_000


def _cell_triangles(ab: np.ndarray, cell: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(node, triangles)`` of those whose three colours are the cell's, from edges ``a << 32 | b``."""
    colours = (cell // (k * k), cell // k % k, cell % k)
    worth = dict(zip(colours, (1, 4, 16), strict=True))  # no two threes of colours have one sum
    ab = np.sort(ab)
    nodes, at = np.unique(np.concatenate([ab >> 32, ab & 0xFFFFFFFF]), return_inverse=True)
    n, m = len(nodes), len(ab)
    a, b = at[:m], at[m:]
    key = a * n + b
    mine = np.array([worth[c] for c in (nodes % k).tolist()])
    later = np.searchsorted(a, a, side="right") - np.arange(m) - 1  # edges of the same first end that follow
    upto = np.cumsum(later)
    found = np.zeros(n, np.int64)
    lo = 0
    while lo < m:
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WEDGES, side="right")), lo + 1)
        x = np.repeat(np.arange(lo, hi), later[lo:hi])
        y = np.arange(len(x)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi]) + x + 1
        ok = mine[a[x]] + mine[b[x]] + mine[b[y]] == sum(worth[c] for c in colours)
        x, y = x[ok], y[ok]
        third = b[x] * n + b[y]
        where = np.searchsorted(key, third)
        hit = key[np.minimum(where, m - 1)] == third
        x, y = x[hit], y[hit]
        found += np.bincount(np.concatenate([a[x], b[x], b[y]]), minlength=n)
        lo = hi
    some = found > 0
    return nodes[some], found[some]


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(node, triangles, clustering)``.

    Nodes are numbered by degree and fall into ``COLOURS`` classes; the
    triangles of three classes are counted in one task, which gets the edges
    between these classes. So an edge is sent once for each class, whatever
    the number of wedges, and wedges exist a step at a time. Each starts at
    its end of least degree: there are O(m^1.5) of them at most.
    """
    simple = edges.where("src <> dst").select("src", "dst", "weight")
    deg = degrees(simple, vertices)
    ids = materialize(with_position(deg, ["degree", "node"], "id"), "triangle-ids")
    e = simple.join(ids.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst")
    e = materialize(e.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct(), "triangle-edges")
    k = max(COLOURS, math.ceil(math.sqrt(6 * e.count() / CELL)))
    ca, cb, x = F.col("a") % k, F.col("b") % k, F.col("x")
    lo, hi = F.least(ca, cb, x), F.greatest(ca, cb, x)
    cell = (lo * k + (ca + cb + x - lo - hi)) * k + hi
    dealt = e.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("x")).select(cell.cast("int").alias("cell"), (F.shiftleft("a", 32) + F.col("b")).alias("ab"))

    def run(table: pa.Table) -> pa.Table:
        node, n = _cell_triangles(table["ab"].to_numpy(), table["cell"][0].as_py(), k)
        return pa.table({"id": node, "n": n})

    spark = edges.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = dealt.repartition(parts, "cell").groupBy("cell").applyInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return ids.join(per, "id", "left").select("node", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"), F.when(pairs > 0, F.coalesce("triangles", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"))


def common_neighbors(edges: DataFrame, vertices: DataFrame, anchor: str) -> DataFrame:
    """Neighbours that each other node shares with ``anchor``."""
    nb = both_ways(edges).where("node <> nbr").select("node", "nbr")
    mine = nb.where(F.col("node") == anchor).select("nbr")
    n = nb.join(mine, "nbr").where(F.col("node") != anchor).groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    return vertices.select("node").join(n, "node", "left").select("node", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"))


def pagerank(edges: DataFrame, vertices: DataFrame, rounds: int = 10, alpha: float = 0.85, weighted: bool = True, cut_every: int = 4, tolerance: float | None = None) -> DataFrame:
    """Power iteration with the mass of isolates spread evenly: ``rounds`` of it, or fewer once ranks change by under ``tolerance`` a node in a round.

    One join and one partially aggregated group-by a round; lineage is cut in
    the shared folder every few rounds, where the change is looked at too.
    """
    links = both_ways(edges)
    links = links if weighted else links.withColumn("weight", F.lit(1.0))
    out = links.groupBy("node").agg(F.sum("weight").alias("total"))
    links = materialize(links.join(out, "node").select("node", "nbr", (F.col("weight") / F.col("total")).alias("share")), "pagerank-links")
    n = vertices.count()
    base = vertices.select("node").join(out.select("node", F.lit(1).alias("linked")), "node", "left")
    rank = materialize(base.select("node", F.col("linked").isNull().alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank")), "pagerank")
    for i in range(rounds):
        got = rank.join(links, "node").groupBy(F.col("nbr").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = rank.withColumnRenamed("rank", "old").join(got, "node", "left").join(F.broadcast(lost))  # one row
        rank = rank.select("node", "dangling", "old", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rank = materialize(rank, "pagerank")
            if tolerance is not None and (rank.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < n * tolerance:
                break
        rank = rank.drop("old")
    return rank.select("node", "rank")


def eigenvector_centrality(edges: DataFrame, vertices: DataFrame, rounds: int = 100, cut_every: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration on A + I, unweighted, scaled to unit length, until nodes change by under ``tolerance`` on average in a round, at most ``rounds``.

    Links stay in a table that each round reads; the vector, one number a node, is broadcast.
    """
    ids, links = spread(edges, vertices, weighted=False)
    x, before = np.ones(links.n), None
    for i in range(rounds):
        node, _, got = links.gather(x[:, None], weighted=True)
        x = x + np.bincount(node, weights=got, minlength=links.n)
        x /= np.sqrt((x * x).sum())
        if (i + 1) % cut_every == 0:
            if before is not None and np.abs(x - before).sum() < links.n * tolerance * cut_every:
                break
            before = x
    links.drop()
    return named(ids, x, "eigenvector")


def degree_zscore(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """What stands for eigenvector centrality in a graph that is not connected."""
    d = degrees(edges, vertices)
    whole = d.agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("std"))
    return d.join(F.broadcast(whole)).select("node", ((F.col("degree") - F.col("mean")) / (F.col("std") + 1e-8)).alias("zscore"))  # one row


def betweenness_sampled(edges: DataFrame, vertices: DataFrame, pivots: int = 10, max_depth: int = 50) -> DataFrame:
    """Betweenness from ``pivots`` sources chosen by hash: breadth-first levels forward, dependencies back.

    All pivots advance together: a level is one pass over the table of links,
    with a number for each node and pivot broadcast, and each node and pivot
    sent back once in each direction. Scaled as for undirected graphs, n / pivots.
    """
    ids, links = spread(edges, vertices, weighted=False)
    chosen = vertices.select("node").orderBy(F.md5("node"), "node").limit(pivots).join(ids, "node").select("id").collect()
    n, k = links.n, len(chosen)
    sources = np.array([r.id for r in chosen], int), np.arange(k)
    depth, sigma, delta = np.full((n, k), -1, np.int16), np.zeros((n, k)), np.zeros((n, k))
    depth[sources], sigma[sources] = 0, 1
    last = 0
    for level in range(1, max_depth + 1):
        node, s, x = links.gather(np.where(depth == level - 1, sigma, 0), depth < 0)
        if not len(node):
            break
        depth[node, s], sigma[node, s], last = level, x, level
    for level in range(last - 1, 0, -1):
        below = depth == level + 1
        node, s, x = links.gather(np.where(below, (1 + delta) / np.where(below, sigma, 1), 0), depth == level)
        delta[node, s] = sigma[node, s] * x
    links.drop()
    scale = (n / max(k, 1)) / max((n - 1) * (n - 2), 1)
    return named(ids, delta.sum(1) * scale, "betweenness")


def weak_bridges(comps: DataFrame, weight: float = 0.001) -> DataFrame:
    """Edges that chain the components in order of their smallest nodes."""
    roots = materialize(with_position(comps.select("component").distinct(), ["component"], "i"), "roots")
    nxt = roots.select((F.col("i") - 1).alias("i"), F.col("component").alias("dst"))
    return roots.join(nxt, "i").select(F.col("component").alias("src"), "dst", F.lit(weight).alias("weight"))


def with_self_loops(edges: DataFrame, vertices: DataFrame, weight: float = 1e-6) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(vertices.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(weight).alias("weight")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def sample_nodes(vertices: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` nodes with the lowest keyed hash: prefixes of one shuffled order, so samples nest."""
    return vertices.select("node").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "node")), "node").limit(n)


def fingerprint(edges: DataFrame) -> DataFrame:
    """``(n_edges, fingerprint)``: md5 over edge digests in two levels, so no task joins all edges into one string."""
    d = edges.select(F.md5(F.concat_ws("\t", "src", "dst")).alias("d"))
    part = d.groupBy(F.substring("d", 1, 2).alias("b")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("d")), "")).alias("p"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.sum("n").cast("bigint").alias("n_edges"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "p"))), lambda x: x["p"]), "")).alias("fingerprint"))
