"""Community tables, report contexts, report tables and map-reduce search. Each lookup is an equi-join, each cap a row_number."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip, to_int_id
from graphloom.operators.quality import labelled_edges


class TextModel(Protocol):
    """Any per-row language-model call: a batch of prompts to a batch of completions, order kept."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def map_model(df: DataFrame, model: TextModel, prompt: str, out: str = "completion", retries: int = 3) -> DataFrame:
    """``df`` with ``completion`` and ``error``: batches go through ``model`` in the partition; a failing row is retried alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, errors = [], []
            try:
                texts = list(model(pdf[prompt].tolist()))
                errors = [None] * len(texts)
            except Exception:
                for p in pdf[prompt]:
                    text, error = None, None
                    for _ in range(retries):
                        try:
                            text, error = model([p])[0], None
                            break
                        except Exception as e:
                            error = str(e)
                    texts.append(text)
                    errors.append(error)
            yield pdf.assign(**{out: texts, "error": errors})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` string", "error string"])
    return df.mapInPandas(run, schema)


# --- community tables ---------------------------------------------------------


def communities_table(membership: DataFrame) -> DataFrame:
    """``(level, community, title, size, entity_ids, parent)`` from ``membership(level, node, community)``."""
    g = membership.groupBy("level", "community").agg(F.array_sort(F.collect_list("node")).alias("entity_ids"), F.count(F.lit(1)).alias("size"))
    return g.select("level", "community", F.concat(F.lit("Community "), F.col("community").cast("string")).alias("title"), "size", "entity_ids", F.lit(-1).cast("bigint").alias("parent"))


def entity_communities(vertices: DataFrame, membership: DataFrame) -> DataFrame:
    lists = membership.groupBy("node").agg(F.array_sort(F.collect_set("community")).alias("community_ids"))
    return vertices.join(lists, "node", "left").withColumn("community_ids", F.coalesce("community_ids", F.array().cast("array<bigint>")))


def community_relationships(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(community, rel_id, src, dst, weight)`` of edges inside one community; an edge without an id is rel_{u}_{v}."""
    e = edges if "id" in edges.columns else edges.withColumn("id", F.lit(None).cast("string"))
    inner = labelled_edges(e, membership).where("src_c = dst_c")
    return inner.select(F.col("src_c").alias("community"), F.coalesce("id", F.concat(F.lit("rel_"), "src", F.lit("_"), "dst")).alias("rel_id"), "src", "dst", "weight")


def community_rel_ids(edges: DataFrame, membership: DataFrame) -> DataFrame:
    r = community_relationships(edges, membership)
    return r.groupBy("community").agg(F.array_sort(F.collect_set("rel_id")).alias("rel_ids"), F.countDistinct("rel_id").alias("n"))


def valid_members(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Members that are nodes, or ids of nodes: ``members(community, member)``, ``vertices(node, id)``."""
    by_title = vertices.select(F.col("node").alias("t"))
    by_id = vertices.select(F.col("id").alias("i"), F.col("node").alias("of"))
    x = members.join(by_title, F.col("member") == F.col("t"), "left").join(by_id, F.col("member") == F.col("i"), "left")
    return x.select("community", F.coalesce("t", "of").alias("node")).where("node IS NOT NULL").distinct()


def minimal_communities(reports: DataFrame) -> DataFrame:
    d = reports.select("level", "community").distinct()
    return d.select("level", "community", F.lit(-1).cast("bigint").alias("parent"), F.lit(1).cast("bigint").alias("size"), F.concat(F.lit("Community "), F.col("community").cast("string")).alias("title"))


def is_flat(communities: DataFrame) -> DataFrame:
    """No parents, no children, at most one level: nothing to select dynamically."""
    kids = F.col("children") if "children" in communities.columns else F.array().cast("array<bigint>")
    return communities.agg((F.bool_and(F.col("parent") == -1) & F.bool_and(F.size(kids) == 0) & (F.countDistinct("level") <= 1)).alias("flat"), F.countDistinct("level").alias("levels"))


def resolve_level(communities: DataFrame, wanted: int) -> DataFrame:
    """The level asked for if it is there, else 0, else the smallest."""
    has = lambda v: F.max(F.when(F.col("level") == v, F.col("level")))
    return communities.agg(F.coalesce(has(wanted), has(0), F.min("level")).alias("level"))


# --- report contexts ----------------------------------------------------------


def entity_line(title: Column, kind: Column, description: Column, degree: Column) -> Column:
    tail = F.when(degree > 1, F.concat(F.lit(" [Connected to "), degree.cast("string"), F.lit(" other entities]"))).otherwise("")
    return F.concat(F.lit("- **"), title, F.lit("** ("), kind, F.lit("): "), description, tail)


def relation_line(src: Column, dst: Column, description: Column) -> Column:
    return F.concat(F.lit("- "), src, F.lit(" → "), dst, F.lit(": "), description)


def report_context(membership: DataFrame, vertices: DataFrame, edges: DataFrame, max_entities: int = 50, max_relations: int = 20) -> DataFrame:
    """``(community, entities, relations, context)``: lines of the best-connected entities and heaviest relations inside."""
    ents = membership.join(vertices, "node")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    ents = ents.withColumn("r", rank).where(F.col("r") <= max_entities)
    ents = ents.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", entity_line(F.col("node"), F.col("type"), F.col("description"), F.col("degree")).alias("line")))), lambda x: x["line"]).alias("lines"))
    rels = community_relationships(edges, membership)
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "src", "dst"))
    rels = rels.withColumn("r", rank).where(F.col("r") <= max_relations)
    line = relation_line(F.col("src"), F.col("dst"), F.concat(F.lit("weight "), F.col("weight").cast("bigint").cast("string")))
    rels = rels.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]).alias("rel_lines"))
    out = ents.join(rels, "community", "left").withColumn("rel_lines", F.coalesce("rel_lines", F.array().cast("array<string>")))
    text = F.concat(F.lit("Entities:\n"), F.array_join("lines", "\n"), F.lit("\nRelationships:\n"), F.array_join("rel_lines", "\n"))
    return out.select("community", F.size("lines").cast("bigint").alias("entities"), F.size("rel_lines").cast("bigint").alias("relations"), text.alias("context"))


def report_prompt(context: Column) -> Column:
    return F.concat(F.lit("Write a report on this community as JSON with title, summary, rating (0-5), rating_explanation and findings.\n\n"), context)


def extractive_report(membership: DataFrame, vertices: DataFrame, level: int = 0, top: int = 5) -> DataFrame:
    """The offline report: a community's best-connected entities. ``(level, community, title, summary, full_content, rank)``."""
    m = membership.join(vertices.select("node", "degree"), "node").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node")))
    size = F.count(F.lit(1))
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "node")))), lambda x: x["node"])
    g = m.groupBy("community").agg(best.alias("best"), size.alias("size"), F.sum("degree").alias("links"))
    summary = F.concat(F.col("size").cast("string"), F.lit(" entities, led by "), F.array_join("best", ", "))
    title = F.concat(F.lit("Community of "), F.col("best")[0])
    full = F.concat(F.lit("# "), title, F.lit("\n"), summary, F.lit(". They have "), F.col("links").cast("string"), F.lit(" links."))
    return g.select(F.lit(level).cast("bigint").alias("level"), "community", title.alias("title"), summary.alias("summary"), full.alias("full_content"), F.col("size").cast("double").alias("rank"))


def reports_table(raw: DataFrame) -> DataFrame:
    """``raw(seq, community, level, title, summary, full_content, rank)`` of any types; blank contents all over become summaries."""
    i = F.row_number().over(Window.orderBy("seq")) - 1
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    blank = F.bool_and(strip(text("full_content")) == "").over(Window.partitionBy())
    out = raw.select("seq", i.cast("bigint").alias("i"), "community", "level", "title", "summary", "full_content", "rank", blank.alias("blank"))
    return out.select(
        "seq", to_int_id(F.col("community"), F.col("i")).alias("community"), F.coalesce(F.col("level").cast("string").try_cast("bigint"), F.lit(0).cast("bigint")).alias("level"),
        text("title").alias("title"), text("summary").alias("summary"), F.when(F.col("blank"), text("summary")).otherwise(text("full_content")).alias("full_content"),
        F.coalesce(F.col("rank").cast("string").try_cast("double"), F.lit(0.0)).alias("rank"),
    )


# --- search -------------------------------------------------------------------


def search_scope(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """Communities that have a report at their level."""
    return communities.join(reports.select("level", "community").distinct(), ["level", "community"])


def reports_at(reports: DataFrame, membership: DataFrame, level: int) -> DataFrame:
    at = membership.where(F.col("level") == level).select("community").distinct()
    return reports.where(F.col("level") == level).join(at, "community", "left_semi")


def search_context(reports: DataFrame, per_level: int = 20, lines: int = 15) -> DataFrame:
    """One text: the first summaries of each level (or 200 characters of the report), ``lines`` of them in all."""
    r = F.row_number().over(Window.partitionBy("level").orderBy("community"))
    line = F.when(F.col("summary") != "", F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(": "), F.col("summary"))).when(
        F.col("full_content") != "", F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(": "), F.substring("full_content", 1, 200), F.lit("..."))
    )
    kept = reports.withColumn("r", r).where(F.col("r") <= per_level).withColumn("line", line).where("line IS NOT NULL").orderBy("level", "community").limit(lines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "community", "line"))), lambda x: x["line"]), "\n")
    return kept.agg(F.count(F.lit(1)).alias("lines"), text.alias("context"))


def usable_reports(reports: DataFrame, per_level: int = 20) -> DataFrame:
    """What the map phase asks: the first reports of each level with at least 10 characters, cut to 2000."""
    content = F.when(F.col("full_content") != "", F.col("full_content")).otherwise(F.col("summary"))
    r = F.row_number().over(Window.partitionBy("level").orderBy("community"))
    return reports.withColumn("r", r).where(F.col("r") <= per_level).withColumn("content", F.substring(content, 1, 2000)).where(F.length(strip(content)) >= 10).drop("r")


def relevant(answer: Column) -> Column:
    return (F.length(strip(answer)) > 0) & ~F.lower(answer).contains("no relevant information")


def keyword_answer(question: str) -> Callable[[Column], Column]:
    """The offline answerer: a report's first line that shares a word with the question."""
    words = sorted({w for w in question.lower().split() if len(w) > 3})

    def answer(content: Column) -> Column:
        hits = F.filter(F.split(content, "\n"), lambda x: F.lit(False) if not words else F.lower(x).rlike("|".join(w.replace("|", "") for w in map(_plain, words))))
        return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("No relevant information"))

    return answer


def _plain(word: str) -> str:
    return "".join(c for c in word if c.isalnum()) or "\x00"


def global_search(reports: DataFrame, question: str, answer: Callable[[Column], Column] | None = None, responses: int = 15) -> DataFrame:
    """Map each usable report to an answer, drop irrelevant ones, reduce the first ``responses`` to one text."""
    mapped = usable_reports(reports).withColumn("answer", (answer or keyword_answer(question))(F.col("content"))).where(relevant(F.col("answer")))
    kept = mapped.orderBy("level", F.desc("rank"), "community").limit(responses)
    line = F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(": "), F.col("answer"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", (-F.col("rank")).alias("r"), "community", line.alias("line")))), lambda x: x["line"]), "\n")
    return kept.agg(F.count(F.lit(1)).alias("responses"), F.when(F.count(F.lit(1)) > 0, text).otherwise("No relevant information found in community reports.").alias("answer"))


def corpus_description(docs: DataFrame, chars: int = 400) -> DataFrame:
    """One line for each document, joined in order: a prompt for a corpus small enough to describe that way."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.substring("text", 1, chars), F.lit("..."))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("description"))


def entity_text(title: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(title, F.lit(": "), description)).otherwise(title)


def few_shot_prompt(schema: Column, examples: Column, text: Column, instruction: Column) -> Column:
    return F.concat_ws("\n\n", schema, examples, F.concat(F.lit('"'), text, F.lit('"')), instruction)
