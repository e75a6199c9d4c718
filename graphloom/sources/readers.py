"""Readers: every file format the engine takes in, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.order import with_position


def json_documents(spark: SparkSession, path: str, max_documents: int | None = None) -> DataFrame:
    """A folder of JSON files, one document each: ``id, title, text``.

    Text is ``text``, else ``content``, else the whole object; title is
    ``title``, else the file's stem. Blank and unreadable files are dropped.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    # A variant holds any object; what is no JSON gives none.
    rows = raw.select(F.col("value").alias("whole"), stem.alias("stem"), F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    field = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'string')")
    rows = rows.select(F.coalesce(field("title"), "stem").alias("title"), F.coalesce(field("text"), field("content"), "whole").alias("text")).where(strip(F.col("text")) != "")
    return limit_documents(documents_table(rows, ["title"]), max_documents) if max_documents else documents_table(rows, ["title"])


def documents_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """``id`` doc_{i} and a default title Document_{i}, numbered in ``order``."""
    rows, i = with_position(rows, order, "__i"), F.col("__i").cast("string")
    title = F.coalesce(F.col("title"), F.concat(F.lit("Document_"), i)) if "title" in rows.columns else F.concat(F.lit("Document_"), i)
    return rows.select(F.concat(F.lit("doc_"), i).alias("id"), title.alias("title"), "text")


def limit_documents(docs: DataFrame, n: int, order: str = "title") -> DataFrame:
    return docs.orderBy(order).limit(n)


def triple_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Benchmark items ``index, text, triple_list`` from a JSON array."""
    items = spark.read.schema("text string, triple_list array<array<string>>").option("multiLine", True).json(path)
    items = items.select(F.monotonically_increasing_id().alias("index"), "text", "triple_list")
    return items.orderBy("index").limit(limit) if limit else items


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """The verdict memo; missing fields are '' and a missing verdict is TIE."""
    raw = spark.read.schema("metric string, query string, ans_i string, ans_j string, decision string").option("multiLine", True).json(path)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("metric", "query", "ans_i", "ans_j")], F.coalesce("decision", F.lit("TIE")).alias("decision"))


def timings(spark: SparkSession, path: str) -> DataFrame:
    """``algorithm, N, seconds``; a blank is null, not an error."""
    return spark.read.schema("algorithm string, N bigint, seconds double").option("header", True).option("nullValue", "").csv(path)


def elo_files(spark: SparkSession, path: str) -> DataFrame:
    """Elo tables of several CSV files; for each k the last file in name order wins."""
    raw = spark.read.schema("k int, metric string, method string, elo double").option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    return latest_per_k(raw)


def latest_per_k(elo: DataFrame) -> DataFrame:
    newest = elo.groupBy("k").agg(F.max("file").alias("file"))
    return elo.join(newest, ["k", "file"], "left_semi")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)
