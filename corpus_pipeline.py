"""From raw documents to token ids: the operators of ``graphloom.llm`` in a row.

``STAGES`` are (name, function); each function takes ``(spark, docs, sf_dir)``,
works on all rows its predecessor kept, and returns a DataFrame that the caller
writes as Parquet and rereads as the next one's ``docs``. All but the last
return the columns of ``documents``; other columns of the input pass through
the first stages and are dropped where a stage makes a new table.

Each row is a document, whatever ids others have: rows that share an id but not
their text are told apart by a hash of it, and so are rows without an id. A null
text is kept as an empty one by the stages that rewrite texts. Of documents that
tie, the one with the smallest id stays, those without an id last; repeated rows
are copies. A text of any length stays whole. An empty table stays empty.

A stage deletes intermediate tables of the stage before it, whose result has
been written by then, and no others.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, pieces, queries, simhash, suffixes, toxicity
from graphloom.session import delete_path, materialize, release, shared_dir, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_left: set[str] = set()


def stage(f):
    """``f`` as a stage: it leaves its intermediate tables to its successor to delete."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, set(_left))
        _left.clear()
        before = written()
        out = f(spark, docs, sf_dir)
        _left.update(written() - before)
        return out

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``queries.TOXIC``; the model learns from ``labels`` as in op4."""
    model = queries.toxicity_model(spark, sf_dir, docs)
    scored = toxicity.score(docs.select(*COLUMNS, F.col("text").alias("__scored")), model, text_col="__scored", out_col="__score")
    return scored.where(F.col("__score") < queries.TOXIC).select(*COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest doc_id."""
    key = [F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("named"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body")]
    rows = docs.select(*COLUMNS, *key)
    kept = simhash.representatives(rows.select("nameless", F.col("named").alias("doc_id"), "body", "text"))
    kept = materialize(kept.withColumnRenamed("doc_id", "named"), "near-copies-kept")
    by = ["nameless", "named", "body"]
    return rows.join(kept, by).dropDuplicates(by).select(*COLUMNS)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a 400-byte repeat covers; a character cut in part goes."""
    out = suffixes.remove_repeats(docs.select(*COLUMNS), as_text=True)
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(mixing.mix(docs.select(*COLUMNS)), list(COLUMNS)).select(*COLUMNS)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids`` and whether decoding gave the text back."""
    coded = pieces.encode_checked(docs.select("doc_id", "lang", "source", "text"), queries.piece_model())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("piece_ids", encode),
]

#: Learned weights, XXH64 votes and piece merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next one has written."""
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = f"{home}/{name}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
