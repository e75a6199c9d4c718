"""Scans, projections, parsing, merging and schema conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import schemas, text, vocabulary
from graphloom.operators import merge, reports
from graphloom.plans.registry import GRAPH_SQL, query
from graphloom.sources import readers


@query("doc_scan", r"SELECT doc_id, 'doc-' || doc_id AS title, length(text) AS n FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def doc_scan(g):
    d = g.documents.where(text.strip(F.col("text")) != "")
    return d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.length("text").cast("bigint").alias("n"))


@query("doc_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40")
def doc_limit(g):
    return readers.limit_documents(g.documents.select("doc_id", "lang"), 40, "doc_id")


@query("doc_table", "SELECT 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, 'Document_' || (row_number() OVER (ORDER BY doc_id) - 1) AS title, md5(text) AS text_md5 FROM documents")
def doc_table(g):
    return readers.documents_table(g.documents, ["doc_id"]).select("id", "title", F.md5("text").alias("text_md5"))


@query("chunks", GRAPH_SQL + "SELECT chunk_id, chunk_no, n_tokens::BIGINT AS n_tokens, md5(chunk) AS chunk_md5 FROM chunks")
def chunks(g):
    return g.chunks.select("chunk_id", "chunk_no", "n_tokens", F.md5("chunk").alias("chunk_md5"))


@query("chunks_fixed_step", """SELECT doc_id, i AS chunk_no, md5(substr(text, i * 4000 + 1, CASE WHEN length(text) // 4 <= 1200 THEN length(text) ELSE 4800 END)) AS chunk_md5
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) // 4 <= 1200 THEN 1 ELSE ceil(length(text) / 4000.0)::BIGINT END)) AS i FROM documents)""")
def chunks_fixed_step(g):
    return g.documents.select("doc_id", F.posexplode(text.fixed_step_chunks(F.col("text"))).alias("chunk_no", "c")).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("c").alias("chunk_md5"))


@query("chunk_notnull", GRAPH_SQL + "SELECT chunk_id, length(chunk) AS n FROM chunks WHERE chunk IS NOT NULL")
def chunk_notnull(g):
    return g.chunks.select("chunk_id", "chunk").na.drop(subset=["chunk"]).select("chunk_id", F.length("chunk").cast("bigint").alias("n"))


@query("chunk_coverage", GRAPH_SQL + "SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY 1")
def chunk_coverage(g):
    ids = g.chunks.select("lang", F.explode(F.array("doc_id")).alias("doc_id"))
    return ids.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs"))


def _responses(g):
    d = F.col("doc_id").cast("string")
    ent = F.concat(F.lit('("entity"<|>Name '), d, F.lit("<|>"), F.upper("lang"), F.lit("<|>First (of "), F.col("source"), F.lit("))"))
    rel = F.concat(F.lit('("relationship"<|>Name '), d, F.lit("<|>"), F.col("source"), F.lit("<|>seen in<|>"), (F.col("doc_id") % 10).cast("string"), F.lit(")"))
    bad = F.lit('("relationship"<|>a<|>b<|>c<|>strong)##("entity"<|>x<|>y)')
    return g.documents.select("doc_id", F.concat_ws("\n", ent, rel, F.lit("noise"), bad).alias("response"))


@query("extract_parse", """SELECT doc_id, kind, a, b, description, weight, ord FROM (
SELECT doc_id, 'entity' AS kind, 'Name ' || doc_id AS a, upper(lang) AS b, 'First (of ' || source AS description, NULL::DOUBLE AS weight, 0::BIGINT AS ord FROM documents
UNION ALL SELECT doc_id, 'relationship', 'Name ' || doc_id, source, 'seen in', (doc_id % 10)::DOUBLE, 0 FROM documents
UNION ALL SELECT doc_id, 'relationship', 'a', 'b', 'c', 1.0, 1 FROM documents)""")
def extract_parse(g):
    r = _responses(g).select("doc_id", F.explode(text.extraction_records(F.col("response"))).alias("x"))
    return r.select("doc_id", "x.kind", "x.a", "x.b", "x.description", "x.weight", F.col("x.ord").cast("bigint").alias("ord"))


@query("questions_parse", """SELECT doc_id, i AS pos, CASE i WHEN 0 THEN 'about ' || lang ELSE 'of ' || source || ': more' END AS question FROM documents, (VALUES (0::BIGINT), (1)) t(i)""")
def questions_parse(g):
    raw = F.concat(F.lit("Intro\nUser 1: about "), F.col("lang"), F.lit("\nno colon\n  2. of that: of "), F.col("source"), F.lit(": more\nTask 3: third\n4: \nother: x"))
    q = g.documents.select("doc_id", F.posexplode(text.numbered_lines(raw, 2)).alias("pos", "question"))
    return q.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "question")


@query("triples_normalized", """SELECT doc_id, array_to_string(list_sort(list_distinct([h || '|' || r || '|' || t, lower(source) || '|rel-b|x'])), ';') AS triples FROM (
SELECT doc_id, source, lang || ' lang' AS h, 'has-' || lower(source) AS r, source AS t FROM documents)""")
def triples_normalized(g):
    s = lambda *c: F.array(*c)
    t = F.array(
        s(F.concat(F.lit(" The "), F.upper("lang"), F.lit(' Lang .')), F.concat(F.lit("Has "), F.col("source")), F.concat(F.lit("'"), F.col("source"), F.lit("'"))),
        s(F.concat(F.lit("an "), F.upper("source")), F.lit(" REL B "), F.lit('"X"')),
        s(F.col("source"), F.lit("rel b"), F.lit("x")),
        s(F.lit("only"), F.lit("two")),
        s(F.lit("the "), F.lit("r"), F.lit("''")),
    )
    n = g.documents.select("doc_id", text.normalize_triples(t).alias("n"))
    return n.select("doc_id", F.array_join(F.array_sort(F.transform("n", lambda x: F.concat_ws("|", x["h"], x["r"], x["t"]))), ";").alias("triples"))


@query("triple_text", GRAPH_SQL + "SELECT doc_id, chunk_no, pos, source || ' next ' || target AS triple FROM rel")
def triple_text(g):
    r = merge.adjacent_mentions(g.mentions, ["doc_id", "chunk_no"], name="mention")
    return r.select("doc_id", "chunk_no", "pos", F.concat_ws(" ", "source", F.lit("next"), "target").alias("triple"))


@query("codekg_parse", """SELECT doc_id, 'person ' || doc_id AS head, 'live_in' AS relation, 'Person' AS head_type, lower(source) AS tail, 'Location' AS tail_type FROM documents""")
def codekg_parse(g):
    body = F.concat(F.lit("text\nextract = Extract([Triple(person('Person "), F.col("doc_id").cast("string"), F.lit("'), Born_in(), Location(\""), F.col("source"), F.lit("\")), Triple(Person('x'), Unknown(), Other('y'))])"))
    t = g.documents.select("doc_id", F.explode(text.constructor_triples(body)).alias("x")).select("doc_id", "x.*")
    rel = F.broadcast(vocabulary.relations(g.spark).where("dataset = 'conll04'"))
    kinds = vocabulary.entity_types(g.spark).where("dataset = 'conll04'")
    out = t.join(rel, F.col("alias") == t["relation"]).select("doc_id", "head", "head_type", "tail", "tail_type", rel["relation"].alias("rel"))
    for end in ("head", "tail"):
        look = F.broadcast(kinds.select(F.col("alias").alias("a"), F.col("entity_type").alias(f"{end}_kind")))
        out = out.join(look, F.col(f"{end}_type") == F.col("a")).drop("a")
    return out.select("doc_id", text.normalize_entity(F.col("head")).alias("head"), text.normalize_relation(F.col("rel"), "_").alias("relation"), F.col("head_kind").alias("head_type"), text.normalize_entity(F.col("tail")).alias("tail"), F.col("tail_kind").alias("tail_type"))


@query("report_parse", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T ' || source ELSE 'Plain ' || lang END AS title, CASE WHEN doc_id % 2 = 0 THEN 'S' ELSE 'body ' || source END AS summary,
CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5)::DOUBLE ELSE 0.0 END AS rating,
md5(CASE WHEN doc_id % 2 = 0 THEN '# T ' || source || E'\n\n**Summary:** S\n\n**Rating:** ' || (doc_id % 5) || E'.0/5.0\n**Rating Explanation:** why\n\n## Key Findings:\n\n1. **f1**\n   - e1\n\n2. **f2**' ELSE '# Plain ' || lang || E'\nbody ' || source || E'\nmore' END) AS content_md5 FROM documents""")
def report_parse(g):
    js = F.concat(F.lit('Here:\n```json\n{"title": "T '), F.col("source"), F.lit('", "summary": "S", "rating": '), (F.col("doc_id") % 5).cast("string"), F.lit(', "rating_explanation": "why", "findings": [{"summary": "f1", "explanation": "e1"}, {"summary": "f2"}]}\n```'))
    plain = F.concat(F.lit("# Plain "), F.col("lang"), F.lit("\nbody "), F.col("source"), F.lit("\nmore"))
    r = g.documents.select("doc_id", text.report_struct(F.when(F.col("doc_id") % 2 == 0, js).otherwise(plain)).alias("r"))
    return r.select("doc_id", "r.title", "r.summary", "r.rating", F.md5("r.full_content").alias("content_md5"))


@query("answer_truncate", r"""SELECT doc_id, CASE WHEN length(text) <= 1400 THEN md5(text) WHEN e > 1120 THEN md5(substr(h, 1, e + 1)) ELSE md5(h || '...') END AS answer_md5 FROM (
SELECT doc_id, text, h, greatest(CASE WHEN instr(reverse(h), '.') > 0 THEN 1400 - instr(reverse(h), '.') ELSE -1 END, CASE WHEN instr(reverse(h), '?') > 0 THEN 1400 - instr(reverse(h), '?') ELSE -1 END, CASE WHEN instr(reverse(h), '!') > 0 THEN 1400 - instr(reverse(h), '!') ELSE -1 END) AS e
FROM (SELECT doc_id, text, substr(text, 1, 1400) AS h FROM documents))""")
def answer_truncate(g):
    return g.documents.select("doc_id", F.md5(text.truncate_answer(F.col("text"))).alias("answer_md5"))


@query("valid_answers", r"""SELECT conv_id, turn, coalesce(length(text) > 0 AND NOT regexp_matches(lower(text), 'no communities found|failed|error|not available|unable to|cannot|empty|null'), false) AS valid FROM conversations""")
def valid_answers(g):
    return g.table("conversations").select("conv_id", "turn", text.valid_answer(F.col("text")).alias("valid"))


@query("entity_text", GRAPH_SQL + "SELECT node, CASE WHEN docs % 2 = 0 THEN node || ': ' || description ELSE node END AS entity_text FROM vertices")
def entity_text(g):
    return g.vertices.select("node", reports.entity_text(F.col("node"), F.when(F.col("docs") % 2 == 0, F.col("description")).otherwise("")).alias("entity_text"))


@query("prompt_build", """SELECT doc_id, md5('schema ' || lang || E'\n\nexample\n\n"' || text || E'"\n\nGive triples.') AS prompt_md5 FROM documents""")
def prompt_build(g):
    p = reports.few_shot_prompt(F.concat(F.lit("schema "), F.col("lang")), F.lit("example"), F.col("text"), F.lit("Give triples."))
    return g.documents.select("doc_id", F.md5(p).alias("prompt_md5"))


@query("corpus_description", """SELECT count(*) AS documents, md5(string_agg('- d' || doc_id || ': ' || substr(text, 1, 400) || '...', E'\n' ORDER BY doc_id)) AS description_md5 FROM documents""")
def corpus_description(g):
    d = g.documents.select(F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), "text")
    return reports.corpus_description(d).select("documents", F.md5("description").alias("description_md5"))


@query("entities_merged", GRAPH_SQL + """SELECT lower(mention) AS key, lang AS type, arg_min(mention, (doc_id, chunk_no, pos)) AS title, count(*) AS frequency, md5(string_agg('in ' || doc_id, '; ' ORDER BY doc_id, chunk_no, pos)) AS description_md5 FROM mentions GROUP BY 1, 2""")
def entities_merged(g):
    return merge.merge_entities(g.raw_entities).select("key", "type", "title", "frequency", F.md5("description").alias("description_md5"))


@query("relationships_merged", GRAPH_SQL + """SELECT lower(source) AS source_key, lower(target) AS target_key, arg_min(source, (doc_id, chunk_no, pos)) AS source, 1.0::DOUBLE AS weight, count(*) AS n, md5(string_agg('in ' || doc_id, '; ' ORDER BY doc_id, chunk_no, pos)) AS description_md5 FROM rel GROUP BY 1, 2""")
def relationships_merged(g):
    return merge.merge_relationships(g.raw_relationships).select("source_key", "target_key", "source", "weight", "n", F.md5("description").alias("description_md5"))


@query("edge_resolve", GRAPH_SQL + """, ids AS (SELECT title, arg_max('e' || doc_id, (doc_id, chunk_no, pos)) AS id FROM (SELECT mention AS title, doc_id, chunk_no, pos FROM mentions WHERE doc_id % 2 = 0) GROUP BY 1)
SELECT r.doc_id, r.chunk_no, r.pos, coalesce(a.id, r.source) AS source_id, coalesce(b.id, r.target) AS target_id FROM rel r LEFT JOIN ids a ON r.source = a.title LEFT JOIN ids b ON r.target = b.title""")
def edge_resolve(g):
    ents = g.raw_entities.where(F.col("doc_id") % 2 == 0).select("title", F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), "seq")
    return merge.resolve_ends(g.raw_relationships, ents).select("seq.doc_id", "seq.chunk_no", "seq.pos", "source_id", "target_id")


@query("edges_valid", GRAPH_SQL + "SELECT doc_id, chunk_no, pos, lower(source) AS source, lower(target) AS target FROM rel WHERE lower(source) IN (SELECT node FROM vertices) AND lower(target) IN (SELECT node FROM vertices)")
def edges_valid(g):
    r = g.raw_relationships.select("seq", F.lower("source").alias("source"), F.lower("target").alias("target"))
    return merge.valid_edges(r, g.vertices).select("seq.doc_id", "seq.chunk_no", "seq.pos", "source", "target")


@query("edges_canonical", GRAPH_SQL + "SELECT least(lower(source), lower(target)) AS src, greatest(lower(source), lower(target)) AS dst, arg_max(pos::DOUBLE, (doc_id, chunk_no, pos)) AS weight FROM rel GROUP BY 1, 2")
def edges_canonical(g):
    r = g.raw_relationships.select("seq", F.lower("source").alias("source"), F.lower("target").alias("target"), F.col("seq.pos").cast("double").alias("weight"))
    return merge.canonical_edges(r)


@query("vertices", GRAPH_SQL + "SELECT n.node, coalesce(v.type, 'UNKNOWN') AS type, coalesce(v.docs, 0) AS docs FROM (SELECT DISTINCT lower(mention) AS node FROM mentions) n LEFT JOIN vertices v ON n.node = v.node")
def vertices(g):
    nodes = g.mentions.select(F.lower("mention").alias("node")).distinct()
    return nodes.join(g.vertices, "node", "left").select("node", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("docs", F.lit(0)).cast("bigint").alias("docs"))


@query("node_projection", GRAPH_SQL + "SELECT DISTINCT mention AS title, lang AS type FROM mentions")
def node_projection(g):
    return g.raw_entities.select("title", "type").distinct()


@query("conform_entities", GRAPH_SQL + """SELECT row_number() OVER (ORDER BY node) - 1 AS human_readable_id, node AS title, CASE WHEN docs % 2 = 0 THEN type ELSE 'UNKNOWN' END AS type, '' AS description, docs AS frequency, 0::BIGINT AS degree, 0.0::DOUBLE AS x, 0::BIGINT AS units FROM vertices""")
def conform_entities(g):
    raw = g.vertices.select(F.col("node").alias("title"), F.when(F.col("docs") % 2 == 0, F.col("type")).alias("type"), F.col("docs").cast("string").alias("frequency"))
    return schemas.conform_entities(raw, ["title"]).select(F.col("human_readable_id"), "title", "type", "description", "frequency", "degree", "x", F.size("text_unit_ids").cast("bigint").alias("units"))


@query("conform_relationships", GRAPH_SQL + """SELECT row_number() OVER (ORDER BY src, dst) - 1 AS human_readable_id, src AS source, dst AS target, '' AS description, CASE WHEN weight > 1 THEN weight ELSE 1.0 END AS weight, 0::BIGINT AS combined_degree, 1::BIGINT AS units FROM edges""")
def conform_relationships(g):
    raw = g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.when(F.col("weight") > 1, F.col("weight").cast("string")).otherwise("n/a").alias("weight"), F.lit("u").alias("source_id"))
    out = schemas.conform_relationships(raw, ["source", "target"])
    return out.select("human_readable_id", "source", "target", "description", "weight", "combined_degree", F.size("text_unit_ids").cast("bigint").alias("units"))


@query("conform_communities", GRAPH_SQL + """SELECT community, 0::BIGINT AS level, -1::BIGINT AS parent, 'Community ' || (row_number() OVER (ORDER BY community) - 1) AS title, count(*) AS size, '' AS period, 0::BIGINT AS children FROM mem GROUP BY community""")
def conform_communities(g):
    raw = g.membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return schemas.conform_communities(raw, ["community"]).select("community", "level", "parent", "title", "size", "period", F.size("children").cast("bigint").alias("children"))


@query("subgraph_sample", GRAPH_SQL + "SELECT node FROM vertices ORDER BY md5('42:' || node), node LIMIT 50")
def subgraph_sample(g):
    from graphloom.operators.graph import sample_nodes

    return sample_nodes(g.vertices, 50)


@query("flagship", GRAPH_SQL + "SELECT node, degree, strength FROM deg ORDER BY strength DESC, node LIMIT 20")
def flagship(g):
    """The 20 best-connected entities: scan, chunk, mention, merge, join, aggregate, top-k."""
    return g.ranked_vertices.select("node", "degree", "strength").orderBy(F.desc("strength"), "node").limit(20)


