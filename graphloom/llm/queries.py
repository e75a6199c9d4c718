"""The queries of the ten operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import media, merkle, mixing, oracles, pieces, sharding, simhash, substrings, suffixes, tokenfile, toxicity
from graphloom.llm.common import documents
from graphloom.session import materialize


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    taken = F.col("size") * F.size("draws")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.concat_ws(",", F.col("draws").cast("array<string>")).alias("shards"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def held_out():
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(documents(spark, sf_dir) if docs is None else docs, labels, ~held_out())


#: A score from which a document counts as toxic.
TOXIC = 0.7


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    out = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir).select("doc_id", "text"), piece_model())


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.length("text").alias("n"), merkle.tree(F.col("text")).alias("tree"))
    docs = docs.select("doc_id", "text", "n", F.col("tree.root").alias("root"), merkle.branches(F.col("tree")).alias("branches"))
    rows = merkle.with_next(docs, ["text", "branches"], tie_col="root")
    edited = F.concat(F.expr("left(text, n - floor(n / 2))"), F.expr("left(next_text, floor(n / 2))"))
    rows = rows.withColumn("edited", edited).withColumn("edited_tree", merkle.tree(F.col("edited")))
    rows = rows.withColumn("edited_branches", merkle.branches(F.col("edited_tree"))).withColumn("edits", merkle.differing(F.col("branches"), F.col("edited_branches")))
    first = F.concat_ws(":", F.try_element_at("edits", F.lit(1))["section"], F.try_element_at("edits", F.lit(1))["paragraph"])
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        merkle.likeness(F.col("branches"), F.col("edited_branches")).alias("near_edited"),
        merkle.likeness(F.col("branches"), F.col("next_branches")).alias("near_next"),
        F.size("edits").cast("long").alias("edited_paragraphs"),
        F.when(F.size("edits") > 0, first).alias("first_edit"),
    )


def word_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = tokenfile.token_segments(documents(spark, sf_dir), word_model(), end_id=1)
    return tokenfile.read_documents(materialize(segments, "tokens"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = media.write_wav(documents(spark, sf_dir).select("doc_id", "text"))
    out = media.read_wav(materialize(table, "media"))
    marks = F.col("landmarks")
    feature = F.concat_ws(":", F.size(marks), F.sha2(F.concat_ws(",", marks.cast("array<string>")), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_pieces": op5_pieces,
    "op6_merkle": op6_merkle,
    "op7_tokenfile": op7_tokenfile,
    "op8_suffixes": op8_suffixes,
    "op9_media": op9_media,
    "op10_substrings": op10_substrings,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": oracles.MIXING,
    "op6_merkle": oracles.MERKLE,
    "op8_suffixes": oracles.SUFFIXES,
    "op10_substrings": oracles.SUBSTRINGS,
}
