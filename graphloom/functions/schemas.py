"""Target schemas and the projection that makes any table conform to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.order import with_position

#: Fixed values: (column, type, default) of each table.
ENTITY = (
    ("id", "string", None), ("human_readable_id", "bigint", None), ("title", "string", None), ("type", "string", "UNKNOWN"), ("description", "string", ""),
    ("text_unit_ids", "array<string>", []), ("frequency", "bigint", 1), ("degree", "bigint", 0), ("x", "double", 0.0), ("y", "double", 0.0),
)
RELATIONSHIP = (
    ("id", "string", None), ("human_readable_id", "bigint", None), ("source", "string", ""), ("target", "string", ""), ("description", "string", ""),
    ("weight", "double", 1.0), ("combined_degree", "bigint", 0), ("text_unit_ids", "array<string>", []),
)
COMMUNITY = (
    ("id", "string", None), ("human_readable_id", "bigint", None), ("community", "bigint", 0), ("level", "bigint", 0), ("parent", "bigint", -1), ("children", "array<bigint>", []),
    ("title", "string", None), ("entity_ids", "array<string>", []), ("relationship_ids", "array<string>", []), ("text_unit_ids", "array<string>", []), ("period", "string", ""), ("size", "bigint", 1),
)


def _default(value, kind: str) -> Column:
    return F.array().cast(kind) if value == [] else F.lit(value).cast(kind)


def conform(df: DataFrame, schema: tuple, order: list[str], kind: str, natural_key: list[str]) -> DataFrame:
    """``df`` with exactly the columns of ``schema``.

    Missing columns get their default, others are cast where possible and
    null-filled. A missing id is a hash of ``natural_key``, so reruns agree.
    ``human_readable_id`` counts rows in ``order``; where it is there but null
    the null rows get a run of their own. A missing title is ``kind_{i}``.
    """
    number = F.col("human_readable_id").cast("string").try_cast("double").cast("bigint") if "human_readable_id" in df.columns else None
    if number is not None:  # rows without a number get a run of their own
        lacking = with_position(df.where(number.isNull()), order, "__fresh")
        df = lacking.unionByName(df.where(number.isNotNull()).withColumn("__fresh", F.lit(None).cast("bigint")))
    df = with_position(df, order, "__i")
    out = []
    for name, kind_, default in schema:
        have = name in df.columns
        if name == "id":
            made = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in natural_key if k in df.columns]), 256)
            c = F.coalesce(F.col("id").cast("string"), made) if have else made
        elif name == "human_readable_id":
            if have:
                c = F.coalesce(number, F.col("__fresh"))
            else:
                c = F.col("__i")
            c = c.cast("bigint")
        elif name == "title" and default is None:
            c = F.concat(F.lit(f"{kind}"), F.col("__i").cast("string"))
            c = F.coalesce(F.col("title"), c) if have else c
        elif kind_ in ("bigint", "double") and have:
            number = F.col(name).cast("string").try_cast("double")
            c = F.coalesce(number.cast(kind_), _default(default, kind_))
        else:
            c = F.coalesce(F.col(name).cast(kind_), _default(default, kind_)) if have else _default(default, kind_)
        out.append(c.alias(name))
    return df.select(*out)


def conform_entities(df: DataFrame, order: list[str]) -> DataFrame:
    return conform(df, ENTITY, order, "entity_", ["title", "type"])


def conform_relationships(df: DataFrame, order: list[str]) -> DataFrame:
    if "text_unit_ids" not in df.columns and "source_id" in df.columns:
        df = df.withColumn("text_unit_ids", F.when(F.col("source_id").isNotNull(), F.array("source_id")).otherwise(F.array().cast("array<string>")))
    return conform(df, RELATIONSHIP, order, "relationship_", ["source", "target"])


def conform_communities(df: DataFrame, order: list[str]) -> DataFrame:
    return conform(df, COMMUNITY, order, "Community ", ["level", "community"])
