"""Features, similarity and community detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import detectors as D
from graphloom.operators import features as X
from graphloom.operators import pairs as P
from graphloom.plans.index import build_index
from graphloom.plans.registry import GRAPH_SQL, query
from graphloom.session import materialize

_FEATURES_SQL = GRAPH_SQL + """, f AS (SELECT node, 'degree' AS f, degree::DOUBLE AS x FROM deg UNION ALL SELECT node, 'docs', docs FROM vertices UNION ALL SELECT v.node, 'type=' || t.type, (v.type = t.type)::INT FROM vertices v, (SELECT DISTINCT type FROM vertices) t),
z AS MATERIALIZED (SELECT node, f, (x - avg(x) OVER (PARTITION BY f)) / (stddev_pop(x) OVER (PARTITION BY f) + 1e-8) AS x FROM f)
"""


def _features(g):
    d = X.long_form(g.ranked_vertices, ["degree", "docs"]).unionByName(X.one_hot(g.vertices))
    return X.zscore(X.dense(d, g.vertices), g.vertices.count())


@query("node_features", _FEATURES_SQL + "SELECT node, f, round(x, 6) + 0.0 AS x FROM z")
def node_features(g):
    return _features(g).select("node", "f", (F.round("x", 6) + 0.0).alias("x"))


@query("nac1_features", _FEATURES_SQL + """, n AS (SELECT count(*)::DOUBLE AS n FROM vertices), m AS (SELECT count(*)::DOUBLE AS m FROM edges),
links AS (SELECT node, nbr, weight AS w FROM both_ UNION ALL SELECT node, node, 1e-6 FROM vertices), d AS (SELECT node, sum(w) AS d FROM links GROUP BY 1),
phi AS (SELECT node, d / (d + (SELECT avg(d) FROM d) * (1 + m / (n * (n - 1) / 2))) AS phi FROM d, n, m),
near AS (SELECT l.node, z.f, sum((0.5 * w + 0.5 * w / sqrt((a.d + 1e-10) * (b.d + 1e-10))) * z.x) AS near FROM links l JOIN d a ON l.node = a.node JOIN d b ON l.nbr = b.node JOIN z ON z.node = l.nbr GROUP BY 1, 2)
SELECT z.node, z.f, round(phi * z.x + (1 - phi) * near, 5) + 0.0 AS x FROM z JOIN phi ON z.node = phi.node JOIN near ON near.node = z.node AND near.f = z.f""")
def nac1_features(g):
    return X.adjust(g.edges, g.vertices, _features(g), loops=1e-6).select("node", "f", (F.round("x", 5) + 0.0).alias("x"))


def _vectors(g):
    v = F.col("embedding").cast("array<double>")
    return g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), v.alias("vector"))


_VECTORS_SQL = "WITH v AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.grp, a.id AS a, b.id AS b, a.x AS xa, b.x AS xb FROM v a JOIN v b ON a.grp = b.grp AND a.id < b.id)"


@query("cosine_pairs", _VECTORS_SQL + " SELECT a, b, round(list_cosine_similarity(xa, xb), 5) AS cosine FROM p WHERE list_cosine_similarity(xa, xb) >= 0.3")
def cosine_pairs(g):
    return P.cosine_pairs(_vectors(g), "id", "grp", 0.3, 5)


@query("rbf_pairs", _VECTORS_SQL + """, d AS (SELECT grp, a, b, list_distance(xa, xb) AS d FROM p), m AS (SELECT grp, median(d) AS m FROM d WHERE d > 0 GROUP BY 1)
SELECT a, b, round(exp(-d * d / (2 * (m * m + 1e-8))), 5) AS rbf FROM d JOIN m USING (grp)""")
def rbf_pairs(g):
    return P.rbf_pairs(_vectors(g), "id", "grp", 5)


@query("nac2_similarity", _VECTORS_SQL + """, d AS (SELECT grp, a, b, xa, xb, list_distance(xa, xb) AS d FROM p), m AS (SELECT grp, median(d) AS m FROM d WHERE d > 0 GROUP BY 1)
SELECT a, b, round(greatest(0, 0.5 * (0.7 * list_cosine_similarity(xa, xb) + 0.3 * exp(-d * d / (2 * (m * m + 1e-8))))), 5) + 0.0 AS w FROM d JOIN m USING (grp)""")
def nac2_similarity(g):
    """Feature similarity as NAC2 blends it, alpha 0.5, for pairs without an edge."""
    return P.similarity_pairs(_vectors(g), "id", "grp", 5)


@query("kmeans_embeddings")
def kmeans_embeddings(g):
    return D.kmeans_embeddings(_vectors(g).select(F.col("id").cast("string").alias("node"), "vector"), 10)


@query("k_allocation")
def k_allocation(g):
    from graphloom.operators.graph import components

    return D.k_allocation(materialize(components(g.edges, g.vertices), "components"), 10)


@query("leiden")
def leiden(g):
    return D.leiden(g.edges, g.vertices)


@query("leiden_hierarchy")
def leiden_hierarchy(g):
    return D.leiden_hierarchy(g.edges, g.vertices, 10)[0]


@query("hierarchy_levels")
def hierarchy_levels(g):
    h, parents = D.leiden_hierarchy(g.edges, g.vertices, 10)
    return h.join(parents, "community").groupBy("level", "parent").agg(F.count(F.lit(1)).alias("nodes"))


@query("leiden_k")
def leiden_k(g):
    return D.leiden_k(g.edges, g.vertices, 30)


@query("label_propagation")
def label_propagation(g):
    return D.label_propagation(g.edges, g.vertices)


@query("spectral")
def spectral(g):
    return D.spectral(g.edges, g.vertices, 10)


@query("score")
def score(g):
    return D.score(g.edges, g.vertices, 10)


def _plain(g):
    return materialize(_features(g), "features")


@query("nac1")
def nac1(g):
    return D.nac1(g.edges, g.vertices, 10, _plain(g))


@query("nac2")
def nac2(g):
    return D.nac2(g.edges, g.vertices, 10, _plain(g))


@query("index_search")
def index_search(g):
    return build_index(g.spark, g.sf_dir).search("Which entities lead a community?")
