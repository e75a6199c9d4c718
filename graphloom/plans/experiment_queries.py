"""Queries of the experiment operators and model connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import experiment as X
from graphloom.operators import quality as Q
from graphloom.plans.registry import COMPONENTS_SQL, GRAPH_SQL, query
from graphloom.sources import models

_GRID_SQL = " UNION ALL ".join(
    "SELECT '{}' AS algorithm, {} AS setting, {}".format(name, i, ", ".join(f"{p.get(c, 'NULL')}::{t} AS {c}" for c, t in (("k", "INT"), ("alpha", "DOUBLE"), ("resolution", "DOUBLE"), ("tight_threshold", "DOUBLE"))))
    for name, grid in X.GRIDS.items()
    for i, p in enumerate(grid)
)


@query("parameter_grid", _GRID_SQL)
def parameter_grid(g):
    return X.parameter_grid(g.spark)


@query("metric_columns", """SELECT h AS header, CASE WHEN lower(trim(h)) LIKE 'comprehensiv%' THEN 'Comprehensiveness' WHEN lower(trim(h)) LIKE 'divers%' THEN 'Diversity' WHEN lower(trim(h)) LIKE 'empower%' THEN 'Empowerment' WHEN lower(trim(h)) LIKE 'direct%' THEN 'Directness' ELSE '' END AS metric
FROM (SELECT DISTINCT ['Comprehensiveness ', ' diversity', 'EMPOWER', 'Directn.', 'Method'][doc_id % 5 + 1] AS h FROM documents)""")
def metric_columns(g):
    names = F.array(*map(F.lit, ["Comprehensiveness ", " diversity", "EMPOWER", "Directn.", "Method"]))
    h = g.documents.select(names[(F.col("doc_id") % 5).cast("int")].alias("header")).distinct()
    return h.select("header", X.metric_of(F.col("header")).alias("metric"))


@query("entity_aliases", GRAPH_SQL + ", e AS (SELECT CASE WHEN docs % 2 = 0 THEN node ELSE 'id_' || node END AS id, node AS title FROM vertices) SELECT id, title FROM e UNION ALL SELECT title, title FROM e WHERE title NOT IN (SELECT id FROM e)")
def entity_aliases(g):
    name = F.when(F.col("docs") % 2 == 0, F.col("node")).otherwise(F.concat(F.lit("id_"), "node"))
    return X.with_title_ids(g.vertices.select(name.alias("id"), F.col("node").alias("title")))


@query("unit_previews", GRAPH_SQL + """, c AS (SELECT (doc_id % 100)::BIGINT AS community, chunk_id AS unit, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id, chunk_no) AS r FROM chunks)
SELECT community, string_agg('- Text unit ' || unit || ': ' || substr(chunk, 1, 200) || '...', chr(10) ORDER BY r) AS previews FROM c JOIN chunks ON unit = chunk_id WHERE r <= 3 GROUP BY 1""")
def unit_previews(g):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("community").orderBy("doc_id", "chunk_no"))
    first = g.chunks.select((F.col("doc_id") % 100).cast("bigint").alias("community"), "doc_id", "chunk_no", "chunk_id").withColumn("r", rank).where("r <= 5")
    units = F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x["chunk_id"])
    return X.unit_previews(first.groupBy("community").agg(units.alias("text_unit_ids")), g.chunks.select(F.col("chunk_id").alias("id"), F.col("chunk").alias("text")))


_SPLIT_SQL = GRAPH_SQL + """, s AS (SELECT community, count(*) AS size FROM mem GROUP BY 1), i AS (SELECT src_c AS community, count(*) AS internal FROM lab WHERE src_c = dst_c GROUP BY 1),
x AS (SELECT c AS community, count(*) AS external FROM (SELECT src_c AS c FROM lab WHERE src_c <> dst_c UNION ALL SELECT dst_c FROM lab WHERE src_c <> dst_c) GROUP BY 1),
a AS (SELECT s.community, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external FROM s LEFT JOIN i USING (community) LEFT JOIN x USING (community))
SELECT community, size, internal, external, round(size * (1 - 2.0 * internal / greatest(1, size * (size - 1))) * (1 + CASE WHEN internal + external > 0 THEN external / (2.0 * internal + external) ELSE 0 END), 6) AS score FROM a ORDER BY score DESC, size DESC, community LIMIT 1"""


@query("best_split", _SPLIT_SQL)
def best_split(g):
    lab = Q.labelled_edges(g.edges, g.membership)
    inside = lab.where("src_c = dst_c").groupBy(F.col("src_c").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    out = lab.where("src_c <> dst_c").select(F.explode(F.array("src_c", "dst_c")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("external"))
    sizes = g.membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    c = sizes.join(inside, "community", "left").join(out, "community", "left").na.fill(0, ["internal", "external"])
    density = 2.0 * F.col("internal") / F.greatest(F.lit(1), F.col("size") * (F.col("size") - 1))
    return X.best_split(c.withColumn("density", density), 0.0).select("community", "size", "internal", "external", F.round("score", 6).alias("score"))


@query("adapted_components", COMPONENTS_SQL + "SELECT node, dense_rank() OVER (ORDER BY n DESC, component) - 1 AS community FROM comps JOIN (SELECT component, count(*) AS n FROM comps GROUP BY 1) USING (component)")
def adapted_components(g):
    """What an experiment gets where the detector fails."""

    def fails(edges, vertices, k):
        raise ValueError("no communities")

    return X.adapt(fails)(g.edges, g.vertices, 5)


@query("size_targeted", GRAPH_SQL + ", n AS (SELECT count(*) AS n, greatest(1, count(*) // 20) AS k FROM vertices) SELECT node, (row_number() OVER (ORDER BY node) * k - 1) // n AS community FROM vertices, n")
def size_targeted(g):
    n = g.vertices.count()
    return X.size_targeted(lambda e, v, k: Q.slice_partition(v, k, n), g.edges, g.vertices, 20)


@query("late_detector", GRAPH_SQL + ", n AS (SELECT count(*) AS n, greatest(1, floor(sqrt(count(*)))::BIGINT) AS k FROM vertices) SELECT node, (row_number() OVER (ORDER BY node) * k - 1) // n AS community FROM vertices, n")
def late_detector(g):
    """A detector that outlasts its limit is replaced by slices."""

    def slow(edges, vertices, k):
        import time

        time.sleep(3)
        return vertices.limit(0).select("node", F.lit(0).cast("bigint").alias("community"))

    return X.detect_within(g.spark, 0.2, slow, g.edges, g.vertices, 5)


@query("zip_by_index", "SELECT item_id AS index, text, CASE WHEN item_id % 3 > 0 THEN 'answer ' || item_id END AS response FROM benchmark")
def zip_by_index(g):
    items = g.table("benchmark").select(F.col("item_id").alias("index"), "text")
    return X.zip_by_index(items, items.where("index % 3 > 0").select("index", F.concat(F.lit("answer "), "index").alias("response")))


def _first_words(texts):
    """An extractor for tests of the plumbing: the first three words of a text as one triple."""
    return [[tuple(w[:3])] if len(w := t.split(" ")) >= 3 else [] for t in texts]


@query("extract_chunks", GRAPH_SQL + ", w AS (SELECT chunk_id, string_split(chunk, ' ') AS w, string_split_regex(chunk, ' ') AS v FROM chunks) SELECT chunk_id, w[1] AS h, w[2] AS r, w[3] AS t FROM w WHERE len(w) >= 3")
def extract_chunks(g):
    got = models.extract(g.chunks.select("chunk_id", "chunk"), _first_words)
    return got.select("chunk_id", F.explode("triples").alias("x")).select("chunk_id", "x.h", "x.r", "x.t")


@query("entity_vectors", GRAPH_SQL + "SELECT node, 64 AS dim, true AS unit FROM vertices")
def entity_vectors(g):
    text = F.concat_ws(": ", "node", "description")
    v = models.embed(g.vertices.select("node", text.alias("text")), models.hashing_embedder(64))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("node", F.size("vector").alias("dim"), (F.abs(norm - 1) < 1e-9).alias("unit"))


def _echo(prompts):
    """A model for tests of the plumbing: numbered lines that name what was asked for."""
    word = lambda p: "User" if p.startswith("Name ") else "Task" if p.startswith("Give ") else "Question"
    return ["\n".join(f"{word(p)} {i}: {word(p).lower()} {i}" for i in range(1, 6)) for p in prompts]


@query("question_fan_out", """SELECT u.i::INT AS "user", t.i::INT AS task, q.i::INT AS question, 'user ' || (u.i + 1) AS persona, 'task ' || (t.i + 1) AS task_text, 'question ' || (q.i + 1) AS question_text
FROM range(3) u(i), range(4) t(i), range(5) q(i)""")
def question_fan_out(g):
    corpus = g.spark.createDataFrame([("three documents",)], "description string")
    return X.questions(corpus, _echo, 3, 4, 5)
