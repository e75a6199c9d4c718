"""Entity resolution and edge construction as partial-aggregated group-bys and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(seq: str, value: str, sep: str = "; ") -> Column:
    """Values in order of ``seq``; order comes from the data, never from arrival."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value]), sep)


def merge_entities(raw: DataFrame) -> DataFrame:
    """``(seq, title, type, description, ...)`` by (lower title, type): first row kept, descriptions joined."""
    return raw.groupBy(F.lower("title").alias("key"), "type").agg(
        F.min_by("title", "seq").alias("title"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("frequency"), _joined("seq", "description").alias("description")
    ).select("key", "title", "type", "description", "frequency", "seq")


def merge_relationships(raw: DataFrame) -> DataFrame:
    """Directed, by lower-cased ends: first weight kept, not summed; descriptions joined."""
    return raw.groupBy(F.lower("source").alias("source_key"), F.lower("target").alias("target_key")).agg(
        F.min_by("source", "seq").alias("source"), F.min_by("target", "seq").alias("target"), F.min_by("weight", "seq").alias("weight"),
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), _joined("seq", "description").alias("description"),
    )


def resolve_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends that are titles become ids; others stay. Of entities with one title the last counts."""
    ids = entities.groupBy("title").agg(F.max_by("id", "seq").alias("id"))
    out = edges
    for end in ("source", "target"):
        look = ids.select(F.col("title").alias(f"__{end}"), F.col("id").alias(f"{end}_id"))
        out = out.join(look, F.col(end) == F.col(f"__{end}"), "left").withColumn(f"{end}_id", F.coalesce(f"{end}_id", end)).drop(f"__{end}")
    return out


def valid_edges(edges: DataFrame, vertices: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Edges both of whose ends are vertices."""
    v = vertices.select("node").distinct()
    return edges.join(v.withColumnRenamed("node", src), src, "left_semi").join(v.withColumnRenamed("node", dst), dst, "left_semi")


def canonical_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One undirected edge for each pair, ``src < dst`` (or a self loop); the last one's weight holds."""
    return edges.groupBy(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst")).agg(F.max_by("weight", seq).alias("weight"))


def sum_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge for each pair of different nodes, weights added."""
    return edges.where("source <> target").groupBy(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst")).agg(F.sum("weight").cast("double").alias("weight"))


def adjacent_mentions(mentions: DataFrame, unit: list[str], pos: str = "pos", name: str = "title") -> DataFrame:
    """``(unit..., source, target, pos)`` of neighbouring mentions in a unit."""
    nxt = F.lead(name).over(Window.partitionBy(*unit).orderBy(pos))
    return mentions.select(*unit, F.col(name).alias("source"), nxt.alias("target"), pos).where("target IS NOT NULL")


def neighbours(units: DataFrame, unit: list[str], names: str) -> DataFrame:
    """The same from one row a unit with its names in order: each array is paired with itself, and nothing is shuffled."""
    n = F.greatest(F.size(names) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(names, F.lit(1), n).alias("source"), F.slice(names, F.lit(2), n).alias("target"))
    out = units.select(*unit, F.posexplode(pairs).alias("pos", "x"))
    return out.select(*unit, F.col("x")["source"].alias("source"), F.col("x")["target"].alias("target"), F.col("pos").cast("bigint").alias("pos"))
