"""Partitions ``membership(node, community)`` and how good they are: edges meet membership twice, never pairs of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import with_position

from graphloom.operators.components import connected_components
from graphloom.operators.graph import degrees


def labelled_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    m = membership.select("node", "community")
    return edges.join(m.select(F.col("node").alias("src"), F.col("community").alias("src_c")), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("dst_c")), "dst")


def groups(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.count(F.lit(1)).alias("size"))


def complete_singletons(membership: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices without a community become communities of their own, named by themselves."""
    left = vertices.select("node").join(membership.select("node"), "node", "left_anti")
    return membership.select("node", F.col("community").cast("string").alias("community")).unionByName(left.select("node", F.concat(F.lit("single:"), "node").alias("community")))


def complete_largest(membership: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices without a community join the largest one (ties: the smallest id)."""
    top = membership.groupBy("community").count().orderBy(F.desc("count"), "community").limit(1).select("community")
    left = vertices.select("node").join(membership.select("node"), "node", "left_anti")
    return membership.select("node", "community").unionByName(left.join(F.broadcast(top)).select("node", "community"))  # one row


def modularity(edges: DataFrame, membership: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sum over communities of L_c / m - (d_c / 2m)^2, by weight; uncovered vertices are singletons."""
    m = complete_singletons(membership, vertices)
    lab = labelled_edges(edges, m)
    ends = lab.select(F.explode(F.array("src_c", "dst_c")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("d"))
    inner = lab.where("src_c = dst_c").groupBy(F.col("src_c").alias("community")).agg(F.sum("weight").alias("l"))
    total = edges.agg(F.sum("weight").alias("m"))
    q = ends.join(inner, "community", "left").join(F.broadcast(total))  # one row
    return q.agg(F.coalesce(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("modularity"))


def edge_mix(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(community, size, internal, external, density, conductance)``."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    lab = labelled_edges(edges.where("src <> dst"), membership)
    sides = lab.select(F.explode(F.array(F.struct(F.col("src_c").alias("community"), (F.col("src_c") == F.col("dst_c")).alias("inside")), F.struct(F.col("dst_c").alias("community"), (F.col("src_c") == F.col("dst_c")).alias("inside")))).alias("x"))
    n = sides.groupBy(F.col("x.community").alias("community")).agg((F.sum(F.col("x.inside").cast("int")) / 2).cast("bigint").alias("internal"), F.sum((~F.col("x.inside")).cast("int")).cast("bigint").alias("external"))
    out = sizes.join(n, "community", "left").select("community", "size", F.coalesce("internal", F.lit(0)).cast("bigint").alias("internal"), F.coalesce("external", F.lit(0)).cast("bigint").alias("external"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    vol = 2 * F.col("internal") + F.col("external")
    return out.select("*", F.when(pairs > 0, F.col("internal") / pairs).otherwise(0.0).alias("density"), F.when(vol > 0, F.col("external") / vol).otherwise(0.0).alias("conductance"))


def conductance(edges: DataFrame, membership: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(community, cut, volume, conductance)``, unweighted: cut / min(volume, rest); clusters without a rest are left out."""
    m = complete_singletons(membership, vertices)
    deg = degrees(edges, vertices).select("node", "degree")
    vol = m.join(deg, "node").groupBy("community").agg(F.sum("degree").alias("volume"))
    lab = labelled_edges(edges, m).where("src_c <> dst_c")
    cut = lab.select(F.explode(F.array("src_c", "dst_c")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("cut"))
    total = deg.agg(F.sum("degree").alias("all"))
    out = vol.join(cut, "community", "left").join(F.broadcast(total))  # one row
    small = F.least(F.col("volume"), F.col("all") - F.col("volume"))
    return out.where(small > 0).select("community", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"), F.col("volume").cast("bigint").alias("volume"), (F.coalesce("cut", F.lit(0)) / small).alias("conductance"))


def size_stats(membership: DataFrame, k: int) -> DataFrame:
    s = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    n = F.count(F.lit(1))
    return s.agg(
        n.alias("communities"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.sum("size").alias("total"),
        (1 - F.abs(n - k) / F.greatest(F.lit(k), F.lit(1))).cast("double").alias("k_accuracy"),
    )


def min_size(membership: DataFrame, n: int = 3) -> DataFrame:
    keep = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= n)
    return membership.join(keep, "community", "left_semi")


def connected_cores(edges: DataFrame, membership: DataFrame, n: int = 3) -> DataFrame:
    """Of each community of at least ``n`` nodes the largest connected part (ties: smallest node), if that still has ``n``."""
    m = min_size(membership, n)
    inner = labelled_edges(edges, m).where("src_c = dst_c")
    key = lambda c, x: F.concat_ws("\x1f", c, x)
    pairs = inner.select(key(F.col("src_c").cast("string"), F.col("src")).alias("u"), key(F.col("dst_c").cast("string"), F.col("dst")).alias("v"))
    own = m.select(key(F.col("community").cast("string"), F.col("node")).alias("u")).withColumn("v", F.col("u"))
    comp = connected_components(pairs.unionByName(own))
    parts = m.withColumn("k", key(F.col("community").cast("string"), F.col("node"))).join(comp.withColumnRenamed("node", "k"), "k")
    sizes = parts.groupBy("community", "component").agg(F.count(F.lit(1)).alias("part"))
    best = sizes.groupBy("community").agg(F.min(F.struct((-F.col("part")).alias("neg"), "component")).alias("b"))
    best = best.where(-F.col("b.neg") >= n).select("community", F.col("b.component").alias("component"))
    return parts.join(best, ["community", "component"]).select("node", "community")


def top_communities(membership: DataFrame, k: int) -> DataFrame:
    """Ranks of the ``k`` largest: a top-k, kept small before anything is sorted globally."""
    return membership.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")))


def components_to_k(comps: DataFrame, k: int) -> DataFrame:
    """The k - 1 largest components keep to themselves, all others share group ``k``."""
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(k - 1).withColumn("community", F.row_number().over(Window.orderBy(F.desc("n"), "component")))
    return comps.join(F.broadcast(top.select("component", "community")), "component", "left").select("node", F.coalesce("community", F.lit(k)).cast("bigint").alias("community"))  # k - 1 rows


def level_stats(membership: DataFrame) -> DataFrame:
    """``membership(level, node, community)`` by level."""
    s = membership.groupBy("level", "community").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("communities"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"))


def closest_level(membership: DataFrame, k: int) -> DataFrame:
    c = membership.groupBy("level").agg(F.countDistinct("community").alias("communities"))
    return c.agg(F.min(F.struct(F.abs(F.col("communities") - k).alias("diff"), "level", "communities")).alias("b")).select("b.level", "b.communities", F.col("b.diff").alias("diff"))


def next_level_edges(edges: DataFrame, membership: DataFrame, max_size: int) -> DataFrame:
    """The graph to subdivide next: edges inside communities above ``max_size``."""
    big = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_size).select("community")
    return labelled_edges(edges, membership.join(big, "community", "left_semi")).where("src_c = dst_c").select("src", "dst", "weight", F.col("src_c").alias("community"))


def score_outliers(edges: DataFrame, membership: DataFrame, missing: int) -> DataFrame:
    """Nodes to make singletons of while short of k: of communities above 3, fewer than 2 neighbours inside and some outside, most outside first."""
    lab = labelled_edges(edges.where("src <> dst"), membership)
    side = lab.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_c").alias("c"), (F.col("src_c") == F.col("dst_c")).alias("inside")), F.struct(F.col("dst").alias("node"), F.col("dst_c").alias("c"), (F.col("src_c") == F.col("dst_c")).alias("inside")))).alias("x")).select("x.*")
    n = side.groupBy("node", F.col("c").alias("community")).agg(F.sum(F.col("inside").cast("int")).alias("internal"), F.sum((~F.col("inside")).cast("int")).alias("external"))
    big = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size > 3")
    return n.join(big, "community", "left_semi").where("internal < 2 AND external > 0").orderBy(F.desc("external"), "node").limit(missing).select("node", "community", F.col("internal").cast("bigint").alias("internal"), F.col("external").cast("bigint").alias("external"))


def slice_partition(vertices: DataFrame, k: int, n: int) -> DataFrame:
    """``k`` contiguous slices of the nodes in order: what stands in for a detector that ran out of time."""
    ordered = with_position(vertices.select("node"), ["node"], "i")
    return ordered.select("node", F.floor(((F.col("i") + 1) * k - 1) / n).cast("bigint").alias("community"))
