"""Graph measures, partitions and their quality, community tables and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import quality as Q
from graphloom.operators import reports as R
from graphloom.plans.registry import COMPONENTS_SQL, GRAPH_SQL, query


def _level(g, n):
    return g.levels.where(F.col("level") == n)


@query("degree", GRAPH_SQL + "SELECT node, degree FROM deg")
def degree(g):
    return G.degrees(g.edges, g.vertices).select("node", "degree")


@query("weighted_degree", GRAPH_SQL + "SELECT node, strength FROM deg")
def weighted_degree(g):
    return G.degrees(g.edges, g.vertices).select("node", "strength")


@query("combined_degree", GRAPH_SQL + "SELECT src, dst, a.degree + b.degree AS combined_degree FROM edges JOIN deg a ON src = a.node JOIN deg b ON dst = b.node")
def combined_degree(g):
    return G.combined_degree(g.edges, g.vertices)


@query("degree_zscore", GRAPH_SQL + "SELECT node, round((degree - avg(degree) OVER ()) / (stddev_pop(degree) OVER () + 1e-8), 6) AS zscore FROM deg")
def degree_zscore(g):
    return G.degree_zscore(g.edges, g.vertices).select("node", F.round("zscore", 6).alias("zscore"))


@query("connected_components", COMPONENTS_SQL + "SELECT node, component FROM comps")
def connected_components(g):
    return G.components(g.edges, g.vertices)


@query("largest_component", COMPONENTS_SQL + "SELECT node, component FROM comps WHERE component = (SELECT component FROM comps GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def largest_component(g):
    return G.largest_component(G.components(g.edges, g.vertices))


@query("graph_stats", COMPONENTS_SQL + """SELECT n AS nodes, m AS edges, c AS components, round(m / (n * (n - 1) / 2.0), 9) AS density, greatest(c, floor(sqrt(n))::BIGINT) AS natural_k, greatest(2, floor(sqrt(n))::BIGINT) AS default_k
FROM (SELECT (SELECT count(*) FROM vertices) AS n, (SELECT count(*) FROM edges) AS m, (SELECT count(DISTINCT component) FROM comps) AS c)""")
def graph_stats(g):
    s = G.graph_stats(g.edges, g.vertices, G.components(g.edges, g.vertices))
    return s.withColumn("density", F.round("density", 9))


@query("graph_fingerprint", GRAPH_SQL + """, d AS (SELECT md5(src || chr(9) || dst) AS d FROM edges), p AS (SELECT substr(d, 1, 2) AS b, md5(string_agg(d, '' ORDER BY d)) AS p, count(*) AS n FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS n_edges, md5(string_agg(p, '' ORDER BY b)) AS fingerprint FROM p""")
def graph_fingerprint(g):
    return G.fingerprint(g.edges)


@query("clustering_coefficient", GRAPH_SQL + """, tri AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst),
per AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY 1)
SELECT deg.node, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN round(coalesce(t, 0) / (degree * (degree - 1) / 2.0), 6) ELSE 0.0 END AS clustering FROM deg LEFT JOIN per ON deg.node = per.node""")
def clustering_coefficient(g):
    return G.clustering(g.edges, g.vertices).withColumn("clustering", F.round("clustering", 6))


@query("common_neighbors", GRAPH_SQL + """, first AS (SELECT min(node) AS f FROM vertices), mine AS (SELECT nbr FROM both_, first WHERE node = f)
SELECT v.node, count(m.nbr) AS common FROM vertices v LEFT JOIN both_ b ON v.node = b.node AND v.node <> (SELECT f FROM first) LEFT JOIN mine m ON b.nbr = m.nbr GROUP BY 1""")
def common_neighbors(g):
    return G.common_neighbors(g.edges, g.vertices, g.vertices.agg(F.min("node")).first()[0])


def _pagerank_sql(rounds: int) -> str:
    sql = GRAPH_SQL + ", n AS (SELECT count(*)::DOUBLE AS n FROM vertices), share AS MATERIALIZED (SELECT b.node, nbr, weight / strength AS share FROM both_ b JOIN deg ON b.node = deg.node), r0 AS MATERIALIZED (SELECT node, degree = 0 AS dangling, 1 / n.n AS rank FROM deg, n)"
    for i in range(1, rounds + 1):
        sql += f""", r{i} AS MATERIALIZED (SELECT p.node, p.dangling, 0.15 / n.n + 0.85 * (coalesce(q.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE dangling) / n.n) AS rank
FROM r{i - 1} p CROSS JOIN n LEFT JOIN (SELECT nbr, sum(rank * share) AS got FROM r{i - 1} JOIN share USING (node) GROUP BY 1) q ON p.node = q.nbr)"""
    return sql + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _pagerank_sql(10))
def pagerank(g):
    return G.pagerank(g.edges, g.vertices, 10).select("node", F.round("rank", 9).alias("rank"))


@query("eigenvector_centrality")
def eigenvector_centrality(g):
    return G.eigenvector_centrality(g.edges, g.vertices)


@query("betweenness_sampled")
def betweenness_sampled(g):
    return G.betweenness_sampled(g.edges, g.vertices)


@query("weak_bridges", COMPONENTS_SQL + "SELECT * FROM (SELECT component AS src, lead(component) OVER (ORDER BY component) AS dst, 0.001::DOUBLE AS weight FROM (SELECT DISTINCT component FROM comps)) WHERE dst IS NOT NULL")
def weak_bridges(g):
    return G.weak_bridges(G.components(g.edges, g.vertices))


@query("preprocess_edges", GRAPH_SQL + "SELECT src, dst, weight FROM edges UNION ALL SELECT node, node, 1e-6::DOUBLE FROM vertices")
def preprocess_edges(g):
    return G.with_self_loops(g.edges, g.vertices)


@query("next_level_edges", GRAPH_SQL + "SELECT src, dst, weight, src_c AS community FROM lab WHERE src_c = dst_c AND src_c IN (SELECT community FROM mem GROUP BY 1 HAVING count(*) > 10)")
def next_level_edges(g):
    return Q.next_level_edges(g.edges, g.membership, 10)


@query("membership_groups", GRAPH_SQL + "SELECT community, array_to_string(list_sort(list(node)), ',') AS nodes, count(*) AS size FROM mem GROUP BY 1")
def membership_groups(g):
    return Q.groups(g.membership).select("community", F.array_join("nodes", ",").alias("nodes"), "size")


@query("community_min_size", GRAPH_SQL + "SELECT node, community FROM mem WHERE community IN (SELECT community FROM mem GROUP BY 1 HAVING count(*) >= 8)")
def community_min_size(g):
    return Q.min_size(g.membership, 8)


@query("community_lcc", GRAPH_SQL + """, r AS (SELECT node, community, node AS t FROM mem UNION SELECT b.nbr, r.community, r.t FROM r JOIN both_ b ON b.node = r.node JOIN mem m ON m.node = b.nbr AND m.community = r.community),
part AS (SELECT node, community, min(t) AS c FROM r GROUP BY 1, 2), s AS (SELECT community, c, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, c) AS k FROM part GROUP BY 1, 2)
SELECT part.node, part.community FROM part JOIN s ON part.community = s.community AND part.c = s.c WHERE k = 1 AND n >= 3 AND part.community IN (SELECT community FROM mem GROUP BY 1 HAVING count(*) >= 3)""")
def community_lcc(g):
    return Q.connected_cores(g.edges, g.membership, 3)


@query("partition_complete", GRAPH_SQL + """, half AS (SELECT * FROM mem WHERE length(node) % 2 = 0), top AS (SELECT community FROM half GROUP BY 1 ORDER BY count(*) DESC, community LIMIT 1)
SELECT v.node, coalesce(s.community, (SELECT community FROM top)) AS community FROM vertices v LEFT JOIN half s ON v.node = s.node""")
def partition_complete(g):
    return Q.complete_largest(g.membership.where(F.length("node") % 2 == 0), g.vertices)


@query("modularity", GRAPH_SQL + """, c AS (SELECT community, sum(weight) AS d FROM (SELECT src_c AS community, weight FROM lab UNION ALL SELECT dst_c, weight FROM lab) GROUP BY 1), l AS (SELECT src_c AS community, sum(weight) AS l FROM lab WHERE src_c = dst_c GROUP BY 1), m AS (SELECT sum(weight) AS m FROM edges)
SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM c LEFT JOIN l USING (community), m""")
def modularity(g):
    return Q.modularity(g.edges, g.membership, g.vertices).select(F.round("modularity", 6).alias("modularity"))


@query("conductance", GRAPH_SQL + """, v AS (SELECT community, sum(degree)::BIGINT AS volume FROM mem JOIN deg USING (node) GROUP BY 1), x AS (SELECT community, count(*) AS cut FROM (SELECT src_c AS community FROM lab WHERE src_c <> dst_c UNION ALL SELECT dst_c FROM lab WHERE src_c <> dst_c) GROUP BY 1), t AS (SELECT sum(degree) AS t FROM deg)
SELECT community, coalesce(cut, 0) AS cut, volume, round(coalesce(cut, 0) / least(volume, t - volume), 6) AS conductance FROM v LEFT JOIN x USING (community), t WHERE least(volume, t - volume) > 0""")
def conductance(g):
    return Q.conductance(g.edges, g.membership, g.vertices).withColumn("conductance", F.round("conductance", 6))


@query("community_edge_mix", GRAPH_SQL + """, s AS (SELECT community, count(*) AS size FROM mem GROUP BY 1), x AS (SELECT s.community, size, (SELECT count(*) FROM lab WHERE src_c = s.community AND dst_c = s.community) AS internal, (SELECT count(*) FROM lab WHERE (src_c = s.community) <> (dst_c = s.community)) AS external FROM s)
SELECT community, size, internal, external, CASE WHEN size > 1 THEN round(internal / (size * (size - 1) / 2.0), 6) ELSE 0.0 END AS density, CASE WHEN 2 * internal + external > 0 THEN round(external / (2 * internal + external), 6) ELSE 0.0 END AS conductance FROM x""")
def community_edge_mix(g):
    return Q.edge_mix(g.edges, g.membership).withColumns({c: F.round(c, 6) for c in ("density", "conductance")})


@query("size_stats", GRAPH_SQL + "SELECT count(*) AS communities, round(avg(size), 6) AS mean_size, median(size)::DOUBLE AS median_size, min(size) AS min_size, max(size) AS max_size, sum(size)::BIGINT AS total, round(1 - abs(count(*) - 10) / 10.0, 6)::DOUBLE AS k_accuracy FROM (SELECT count(*) AS size FROM mem GROUP BY community)")
def size_stats(g):
    return Q.size_stats(g.membership, 10).withColumns({c: F.round(c, 6) for c in ("mean_size", "k_accuracy")})


@query("level_stats", GRAPH_SQL + "SELECT level, count(*) AS communities, round(avg(size), 6) AS avg_size, max(size) AS max_size FROM (SELECT level, community, count(*) AS size FROM levels GROUP BY 1, 2) GROUP BY 1")
def level_stats(g):
    return Q.level_stats(g.levels).withColumn("avg_size", F.round("avg_size", 6))


@query("closest_level", GRAPH_SQL + "SELECT level, communities, abs(communities - 4) AS diff FROM (SELECT level, count(DISTINCT community) AS communities FROM levels GROUP BY 1) ORDER BY diff, level LIMIT 1")
def closest_level(g):
    return Q.closest_level(g.levels, 4)


@query("topk_communities", GRAPH_SQL + "SELECT community, size, rank::INTEGER AS rank FROM (SELECT community, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, community) AS rank FROM mem GROUP BY 1) WHERE rank <= 3")
def topk_communities(g):
    return Q.top_communities(g.membership, 3)


@query("components_to_k", COMPONENTS_SQL + ", s AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS r FROM comps GROUP BY 1) SELECT node, least(r, 5)::BIGINT AS community FROM comps JOIN s USING (component)")
def components_to_k(g):
    return Q.components_to_k(G.components(g.edges, g.vertices), 5)


@query("score_outliers", GRAPH_SQL + """, side AS (SELECT src AS node, src_c AS c, src_c = dst_c AS i FROM lab UNION ALL SELECT dst, dst_c, src_c = dst_c FROM lab)
SELECT node, c AS community, count(*) FILTER (i) AS internal, count(*) FILTER (NOT i) AS external FROM side WHERE c IN (SELECT community FROM mem GROUP BY 1 HAVING count(*) > 3) GROUP BY 1, 2 HAVING count(*) FILTER (i) < 2 AND count(*) FILTER (NOT i) > 0 ORDER BY external DESC, node LIMIT 10""")
def score_outliers(g):
    return Q.score_outliers(g.edges, g.membership, 10)


@query("slice_partition", GRAPH_SQL + ", n AS (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS k FROM vertices) SELECT node, (row_number() OVER (ORDER BY node) * k - 1) // n AS community FROM vertices, n")
def slice_partition(g):
    n = g.vertices.count()
    return Q.slice_partition(g.vertices, int(n**0.5), n)


@query("communities_table", GRAPH_SQL + "SELECT level, community, 'Community ' || community AS title, count(*) AS size, array_to_string(list_sort(list(node)), ',') AS entity_ids, -1::BIGINT AS parent FROM levels GROUP BY 1, 2")
def communities_table(g):
    return R.communities_table(g.levels).withColumn("entity_ids", F.array_join("entity_ids", ","))


@query("entity_communities", GRAPH_SQL + "SELECT v.node, coalesce(array_to_string(list_sort(list_distinct(list(community))), ','), '') AS community_ids FROM vertices v LEFT JOIN (SELECT * FROM levels WHERE community > 0) l ON v.node = l.node GROUP BY 1")
def entity_communities(g):
    e = R.entity_communities(g.vertices.select("node"), g.levels.where("community > 0"))
    return e.select("node", F.array_join(F.col("community_ids").cast("array<string>"), ",").alias("community_ids"))


@query("communities_minimal", GRAPH_SQL + "SELECT DISTINCT level, community, -1::BIGINT AS parent, 1::BIGINT AS size, 'Community ' || community AS title FROM levels")
def communities_minimal(g):
    return R.minimal_communities(g.levels)


@query("community_relationships", GRAPH_SQL + "SELECT src_c AS community, 'rel_' || src || '_' || dst AS rel_id, src, dst, weight FROM lab WHERE src_c = dst_c")
def community_relationships(g):
    return R.community_relationships(g.edges, g.membership)


@query("community_rel_ids", GRAPH_SQL + "SELECT src_c AS community, array_to_string(list_sort(list_distinct(list('rel_' || src || '_' || dst))), ',') AS rel_ids, count(*) AS n FROM lab WHERE src_c = dst_c GROUP BY 1")
def community_rel_ids(g):
    return R.community_rel_ids(g.edges, g.membership).withColumn("rel_ids", F.array_join("rel_ids", ","))


@query("community_members_valid", GRAPH_SQL + "SELECT DISTINCT community, node FROM mem")
def community_members_valid(g):
    v = g.vertices.select("node", F.concat(F.lit("id:"), "node").alias("id"))
    named = F.when(F.length("node") % 2 == 0, F.col("node")).otherwise(F.concat(F.lit("id:"), "node"))
    m = g.membership.select("community", named.alias("member")).unionByName(g.membership.select("community", F.lit("stranger").alias("member")))
    return R.valid_members(m, v)


@query("hierarchy_flat", GRAPH_SQL + "SELECT false AS flat, count(DISTINCT level) AS levels FROM levels")
def hierarchy_flat(g):
    return R.is_flat(R.communities_table(g.levels))


@query("level_resolve", GRAPH_SQL + "SELECT coalesce(max(CASE WHEN level = 5 THEN level END), max(CASE WHEN level = 0 THEN level END), min(level)) AS level FROM levels")
def level_resolve(g):
    return R.resolve_level(R.communities_table(g.levels), 5)


_REPORTS_SQL = GRAPH_SQL + """, top AS (SELECT level, community, count(*) AS size, sum(degree)::BIGINT AS links, array_to_string(list(node ORDER BY degree DESC, node)[1:5], ', ') AS best, list(node ORDER BY degree DESC, node)[1] AS first FROM levels JOIN deg USING (node) GROUP BY 1, 2),
reports AS (SELECT level, community, 'Community of ' || first AS title, size || ' entities, led by ' || best AS summary, '# Community of ' || first || chr(10) || size || ' entities, led by ' || best || '. They have ' || links || ' links.' AS full_content, size::DOUBLE AS rank FROM top)
"""


def _reports(g):
    v = g.ranked_vertices
    parts = [R.extractive_report(_level(g, n).select("node", "community"), v, n) for n in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("community_reports", _REPORTS_SQL + "SELECT * FROM reports")
def community_reports(g):
    return _reports(g)


@query("report_context", GRAPH_SQL + """, e AS (SELECT community, '- **' || m.node || '** (' || type || '): ' || description || CASE WHEN degree > 1 THEN ' [Connected to ' || degree || ' other entities]' ELSE '' END AS line, row_number() OVER (PARTITION BY community ORDER BY degree DESC, m.node) AS r FROM mem m JOIN vertices v ON m.node = v.node JOIN deg d ON d.node = m.node),
q AS (SELECT src_c AS community, '- ' || src || ' → ' || dst || ': weight ' || weight::BIGINT AS line, row_number() OVER (PARTITION BY src_c ORDER BY weight DESC, src, dst) AS r FROM lab WHERE src_c = dst_c),
el AS (SELECT community, count(*) AS n, string_agg(line, chr(10) ORDER BY r) AS t FROM e WHERE r <= 50 GROUP BY 1), ql AS (SELECT community, count(*) AS n, string_agg(line, chr(10) ORDER BY r) AS t FROM q WHERE r <= 20 GROUP BY 1)
SELECT el.community, el.n AS entities, coalesce(ql.n, 0) AS relations, md5('Entities:' || chr(10) || el.t || chr(10) || 'Relationships:' || chr(10) || coalesce(ql.t, '')) AS context_md5 FROM el LEFT JOIN ql ON el.community = ql.community""")
def report_context(g):
    c = R.report_context(g.membership, g.ranked_vertices, g.edges)
    return c.select("community", "entities", "relations", F.md5("context").alias("context_md5"))


@query("reports_table", _REPORTS_SQL + "SELECT row_number() OVER (ORDER BY level, community) - 1 AS seq, CASE WHEN level = 0 THEN community ELSE row_number() OVER (ORDER BY level, community) - 1 END AS community, level, title, summary, summary AS full_content, CASE WHEN level = 0 THEN rank ELSE 0.0 END AS rank FROM reports")
def reports_table(g):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.orderBy("level", "community")) - 1
    name = F.when(F.col("level") == 0, F.concat(F.lit("community_"), F.col("community").cast("string"))).otherwise("none")
    raw = _reports(g).select(seq.cast("bigint").alias("seq"), name.alias("community"), F.col("level").cast("string").alias("level"), "title", "summary", F.lit("  ").alias("full_content"), F.when(F.col("level") == 0, F.col("rank").cast("string")).otherwise("high").alias("rank"))
    return R.reports_table(raw)


@query("search_scope", _REPORTS_SQL + "SELECT level, community, count(*) AS size FROM levels WHERE (level, community) IN (SELECT level, community FROM reports WHERE rank > 10) GROUP BY 1, 2")
def search_scope(g):
    return R.search_scope(R.communities_table(g.levels), _reports(g).where("rank > 10")).select("level", "community", "size")


@query("reports_by_level", _REPORTS_SQL + "SELECT community, title FROM reports WHERE level = 1 AND community IN (SELECT community FROM levels WHERE level = 1)")
def reports_by_level(g):
    return R.reports_at(_reports(g), g.levels, 1).select("community", "title")


@query("search_context", _REPORTS_SQL + "SELECT count(*) AS lines, md5(string_agg('Level ' || level || ': ' || summary, chr(10) ORDER BY level, community)) AS context_md5 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY community) AS r FROM reports) WHERE r <= 20 ORDER BY level, community LIMIT 15)")
def search_context(g):
    return R.search_context(_reports(g)).select("lines", F.md5("context").alias("context_md5"))


@query("map_filter", _REPORTS_SQL + "SELECT level, community, length(full_content) AS n FROM reports WHERE length(trim(full_content)) >= 10 AND NOT contains(lower(summary), 'no relevant information')")
def map_filter(g):
    return R.usable_reports(_reports(g)).where(R.relevant(F.col("summary"))).select("level", "community", F.length("content").cast("bigint").alias("n"))


@query("global_search")
def global_search(g):
    return R.global_search(_reports(g), "Which entities have links?")
