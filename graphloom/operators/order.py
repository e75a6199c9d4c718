"""Positions in a total order without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` with ``name``, counted from 0 in ``order`` (names or columns): ranges are sorted apart, and their sizes, one row each, added up by the driver."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(row.alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    parts = materialize(keyed.repartitionByRange(F.col("key")).select("row", "key", F.spark_partition_id().alias("part")), "ordered")
    sizes = sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect())
    ahead = [0, *accumulate(n for _, n in sizes)]
    starts = df.sparkSession.createDataFrame([(p, a) for (p, _), a in zip(sizes, ahead, strict=False)], "part int, ahead long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    out = parts.withColumn("rank", rank).join(F.broadcast(starts), "part")  # as many rows as partitions
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], (F.col("ahead") + F.col("rank")).alias(name))
