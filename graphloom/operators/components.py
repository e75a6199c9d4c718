"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(u, v)`` of any orderable type to ``(node, component)``.

    ``component`` is the smallest node reachable. Self loops keep a node that
    has no other edge; nulls are ignored; repeated and reversed edges are one.
    Each round is two shuffles on the edge list with partial minima before
    them, and its result is written to the shared folder, so neither a hub nor
    a lost executor costs more than that round.
    """
    clean = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    loops = clean.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    cur = materialize(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(cur)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        nxt = materialize(_small_star(_large_star(cur).distinct()).distinct(), "cc")
        new = _mark(nxt)
        forget(cur)
        cur, done, mark = nxt, new == mark, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return found.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
