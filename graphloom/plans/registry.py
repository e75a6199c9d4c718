"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.textgraph import TextGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The text graph in SQL.
GRAPH_SQL = r"""WITH RECURSIVE chunks AS (
  SELECT doc_id, lang, i AS chunk_no, doc_id || '_chunk_' || i AS chunk_id, substr(text, i * 4000 + 1, 4800) AS chunk, length(substr(text, i * 4000 + 1, 4800)) // 4 AS n_tokens
  FROM (SELECT doc_id, lang, text, unnest(range(greatest(1, ceil((length(text) - 4800) / 4000.0) + 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0)),
m0 AS (SELECT doc_id, lang, chunk_no, regexp_extract_all(chunk, '(?:^|[^\p{L}])(\p{Lu}\p{L}{3,})', 1) AS ms FROM chunks),
mentions AS MATERIALIZED (SELECT doc_id, lang, chunk_no, unnest(ms) AS mention, generate_subscripts(ms, 1) - 1 AS pos FROM m0),
rel AS MATERIALIZED (SELECT * FROM (SELECT doc_id, chunk_no, pos, mention AS source, lead(mention) OVER (PARTITION BY doc_id, chunk_no ORDER BY pos) AS target FROM mentions) WHERE target IS NOT NULL),
vertices AS MATERIALIZED (SELECT lower(mention) AS node, min(lang) AS type, count(DISTINCT doc_id) AS docs, 'in ' || count(DISTINCT doc_id) || ' documents' AS description FROM mentions GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
edges AS MATERIALIZED (SELECT least(s, t) AS src, greatest(s, t) AS dst, count(*)::DOUBLE AS weight FROM (SELECT lower(source) AS s, lower(target) AS t FROM rel) WHERE s <> t AND s IN (SELECT node FROM vertices) AND t IN (SELECT node FROM vertices) GROUP BY 1, 2),
both_ AS MATERIALIZED (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS MATERIALIZED (SELECT v.node, count(nbr) AS degree, coalesce(sum(weight), 0) AS strength FROM vertices v LEFT JOIN both_ b ON v.node = b.node GROUP BY 1),
mem AS (SELECT node, (length(node) % 7)::BIGINT AS community FROM vertices),
levels AS (SELECT 0::BIGINT AS level, node, (length(node) % 7)::BIGINT AS community FROM vertices UNION ALL SELECT 1, node, (length(node) % 3)::BIGINT FROM vertices),
lab AS (SELECT e.*, a.community AS src_c, b.community AS dst_c FROM edges e JOIN mem a ON e.src = a.node JOIN mem b ON e.dst = b.node),
answers AS (SELECT 'm' || ord AS method, ord, 'q' || (row_number() OVER (PARTITION BY ord ORDER BY conv_id, turn) - 1) AS query, answer FROM (SELECT conv_id % 5 AS ord, conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'))
"""

#: Components on top of it, by reachability.
COMPONENTS_SQL = GRAPH_SQL + """, reach AS (SELECT node, node AS r FROM vertices UNION SELECT b.nbr, reach.r FROM reach JOIN both_ b ON b.node = reach.node),
comps AS MATERIALIZED (SELECT node, min(r) AS component FROM reach GROUP BY 1)
"""


def query(name: str, sql: str | None = None):
    """Registers ``f(graph)``; ``sql`` is left out where SQL can't express it."""

    def add(f: Callable[[TextGraph], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(TextGraph(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
