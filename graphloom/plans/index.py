"""The indexing pipeline and search on it, from documents to answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.schemas import conform_entities, conform_relationships
from graphloom.operators import detectors, reports
from graphloom.plans.textgraph import TextGraph


@dataclass
class Index:
    """Lazy tables of an indexed corpus."""

    entities: DataFrame
    relationships: DataFrame
    membership: DataFrame
    communities: DataFrame
    reports: DataFrame

    def search(self, question: str, level: int = 0) -> DataFrame:
        """Map-reduce over the reports of ``level``, or of the nearest level there is."""
        at = reports.resolve_level(self.communities, level).first()[0]
        return reports.global_search(self.reports.where(F.col("level") == at), question)


def build_index(spark: SparkSession, sf_dir: str, detector=None, k: int | None = None) -> Index:
    """Chunks, mentions, merged entities, edges, communities and extractive reports of ``documents``."""
    g = TextGraph(spark, sf_dir)
    m = detectors.leiden(g.edges, g.vertices) if detector is None else detector(g.edges, g.vertices, k)
    levelled = m.select(F.lit(0).cast("bigint").alias("level"), "node", "community")
    entities = conform_entities(g.ranked_vertices.select(F.col("node").alias("title"), "type", "description", F.col("docs").alias("frequency"), "degree"), ["title"])
    relationships = conform_relationships(g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"), ["source", "target"])
    return Index(entities, relationships, m, reports.communities_table(levelled), reports.extractive_report(m, g.ranked_vertices))
