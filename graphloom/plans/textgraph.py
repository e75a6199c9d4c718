"""A knowledge graph of ``documents`` that needs no model: capitalised mentions, and neighbours in a chunk."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import chunk_array, mentions
from graphloom.operators import merge
from graphloom.operators.graph import degrees
from graphloom.session import materialize

#: Entities of at least so many documents are nodes of the graph.
MIN_DOCS = 5


def chunk_table(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """``(doc_id, lang, chunk_no, chunk_id, chunk, n_tokens)``; documents without text have no chunks."""
    cut = docs.where("text IS NOT NULL").select("doc_id", "lang", F.posexplode(chunk_array(F.col("text"), size, overlap)).alias("chunk_no", "chunk"))
    return cut.select("doc_id", "lang", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_no").cast("string")).alias("chunk_id"), "chunk", F.floor(F.length("chunk") / 4).cast("bigint").alias("n_tokens"))


@dataclass
class TextGraph:
    """Lazily built tables of one corpus; what several plans share is written once."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def chunks(self) -> DataFrame:
        return chunk_table(self.documents)

    @cached_property
    def chunk_mentions(self) -> DataFrame:
        """``(doc_id, lang, chunk_no, ms)``: each chunk's mentions in order."""
        return self.chunks.select("doc_id", "lang", "chunk_no", mentions(F.col("chunk")).alias("ms"))

    @cached_property
    def written_mentions(self) -> DataFrame:
        """The same, written once for nodes and edges."""
        return materialize(self.chunk_mentions, "mentions")

    @cached_property
    def mentions(self) -> DataFrame:
        """``(doc_id, lang, chunk_no, pos, mention, seq)``; ``seq`` orders all mentions."""
        m = self.chunk_mentions.select("doc_id", "lang", "chunk_no", F.posexplode("ms").alias("pos", "mention"))
        seq = F.struct("doc_id", "chunk_no", F.col("pos").cast("bigint").alias("pos"))
        return m.select("doc_id", "lang", "chunk_no", F.col("pos").cast("bigint").alias("pos"), "mention", seq.alias("seq"))

    @cached_property
    def raw_entities(self) -> DataFrame:
        described = F.concat(F.lit("in "), F.col("doc_id").cast("string"))
        return self.mentions.select("seq", F.col("mention").alias("title"), F.col("lang").alias("type"), described.alias("description"), "doc_id")

    @cached_property
    def raw_relationships(self) -> DataFrame:
        m = merge.neighbours(self.chunk_mentions, ["doc_id", "chunk_no"], "ms")
        seq = F.struct("doc_id", "chunk_no", "pos")
        return m.select(seq.alias("seq"), "source", "target", F.concat(F.lit("in "), F.col("doc_id").cast("string")).alias("description"), F.lit(1.0).alias("weight"))

    @cached_property
    def vertices(self) -> DataFrame:
        """``(node, type, docs, description)``: lower-cased titles; the type is the smallest of their documents' languages."""
        m = self.written_mentions.select("doc_id", "lang", F.explode("ms").alias("mention"))
        e = m.groupBy(F.lower("mention").alias("node")).agg(F.countDistinct("doc_id").alias("docs"), F.min("lang").alias("type"))
        e = e.where(F.col("docs") >= MIN_DOCS)
        return materialize(e.select("node", "type", "docs", F.concat(F.lit("in "), F.col("docs").cast("string"), F.lit(" documents")).alias("description")), "vertices")

    @cached_property
    def edges(self) -> DataFrame:
        """Undirected ``(src, dst, weight)``: how often two nodes are neighbours."""
        m = merge.neighbours(self.written_mentions, ["doc_id", "chunk_no"], "ms")
        r = m.select(F.lower("source").alias("source"), F.lower("target").alias("target"), F.lit(1.0).alias("weight"))
        return materialize(merge.sum_edges(merge.valid_edges(r, self.vertices)), "edges")

    @cached_property
    def ranked_vertices(self) -> DataFrame:
        return self.vertices.join(degrees(self.edges, self.vertices), "node")

    @cached_property
    def membership(self) -> DataFrame:
        """A partition any engine can make: by length of the title."""
        return self.vertices.select("node", (F.length("node") % 7).cast("bigint").alias("community"))

    @cached_property
    def levels(self) -> DataFrame:
        two = [(0, 7), (1, 3)]
        parts = [self.vertices.select(F.lit(level).cast("bigint").alias("level"), "node", (F.length("node") % k).cast("bigint").alias("community")) for level, k in two]
        return parts[0].unionByName(parts[1])

    @cached_property
    def answers(self) -> DataFrame:
        """Assistant turns as answers of five methods: ``(method, ord, query, answer)``."""
        from pyspark.sql import Window

        a = self.table("conversations").where("role = 'assistant'").select((F.col("conv_id") % 5).alias("ord"), "conv_id", "turn", F.col("text").alias("answer"))
        q = F.row_number().over(Window.partitionBy("ord").orderBy("conv_id", "turn")) - 1
        return a.select(F.concat(F.lit("m"), F.col("ord").cast("string")).alias("method"), "ord", F.concat(F.lit("q"), q.cast("string")).alias("query"), "answer")

    @cached_property
    def metrics(self) -> DataFrame:
        return self.spark.createDataFrame([("Comprehensiveness",), ("Directness",)], "metric string")

    @cached_property
    def triple_items(self) -> DataFrame:
        """Gold and predicted triples of each chunk: two of three neighbours, and all of them, every fourth with another relation."""
        r = merge.neighbours(self.chunk_mentions, ["doc_id", "chunk_no"], "ms")
        t = lambda rel: F.struct(F.lower("source").alias("h"), rel.alias("r"), F.lower("target").alias("t"))
        rel = F.when(F.col("pos") % 4 == 1, F.lit("near")).otherwise(F.lit("next"))
        index = F.concat_ws("_chunk_", "doc_id", "chunk_no").alias("index")
        return r.groupBy(index).agg(F.array_sort(F.collect_set(F.when(F.col("pos") % 3 != 2, t(F.lit("next"))))).alias("gold"), F.array_sort(F.collect_set(t(rel))).alias("pred"))
