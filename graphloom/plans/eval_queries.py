"""Judging, rating, scoring and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import evaluate as E
from graphloom.plans.registry import GRAPH_SQL, query
from graphloom.sources import readers

_INVALID = "no communities found|failed|error|not available|unable to|cannot|empty|null"


def _cut(c: str, cap: str) -> str:
    h = f"substr({c}, 1, {cap})"
    e = "greatest(" + ", ".join(f"CASE WHEN instr(reverse({h}), '{m}') > 0 THEN length({h}) - instr(reverse({h}), '{m}') ELSE -1 END" for m in ".?!") + ")"
    return f"CASE WHEN length({c}) <= {cap} THEN {c} WHEN {e} > {cap} * 0.8 THEN substr({c}, 1, {e} + 1) ELSE {h} || '...' END"


_PAIRS_SQL = GRAPH_SQL + f""", good AS (SELECT * FROM answers WHERE length(answer) > 0 AND NOT regexp_matches(lower(answer), '{_INVALID}')),
metrics AS (SELECT unnest(['Comprehensiveness', 'Directness']) AS metric),
raw AS (SELECT a.query, a.method AS method_i, b.method AS method_j, a.answer AS ai, b.answer AS aj, least(length(a.answer), length(b.answer), 1400) AS cap FROM good a JOIN good b ON a.query = b.query AND a.ord < b.ord),
pairs AS (SELECT metric, query, method_i, method_j, {_cut("ai", "cap")} AS ans_i, {_cut("aj", "cap")} AS ans_j FROM raw, metrics),
judged AS (SELECT *, CASE WHEN d > 0 THEN 'A' WHEN d < 0 THEN 'B' ELSE 'TIE' END AS decision FROM (SELECT *, CASE WHEN metric = 'Directness' THEN length(ans_j) - length(ans_i) ELSE length(ans_i) - length(ans_j) END AS d FROM pairs)),
up AS (SELECT metric, method_i, method_j, avg(CASE decision WHEN 'A' THEN 1.0 WHEN 'TIE' THEN 0.5 ELSE 0.0 END) AS rate FROM judged GROUP BY 1, 2, 3),
methods AS (SELECT DISTINCT method FROM answers),
rates AS MATERIALIZED (SELECT g.metric, a.method AS method_i, b.method AS method_j, coalesce(u.rate, 1 - d.rate, 0.5) AS rate FROM metrics g CROSS JOIN methods a CROSS JOIN methods b
  LEFT JOIN up u ON u.metric = g.metric AND u.method_i = a.method AND u.method_j = b.method LEFT JOIN up d ON d.metric = g.metric AND d.method_i = b.method AND d.method_j = a.method)
"""


def _pairs(g):
    return E.judge_pairs(g.answers, g.metrics)


def _rates(g):
    return E.winrates(E.judge_by_length(_pairs(g)), E.ordered_methods(g.answers), g.metrics)


@query("judge_pairs", _PAIRS_SQL + "SELECT metric, query, method_i, method_j, md5(ans_i) AS ans_i, md5(ans_j) AS ans_j FROM pairs")
def judge_pairs(g):
    return _pairs(g).select("metric", "query", "method_i", "method_j", F.md5("ans_i").alias("ans_i"), F.md5("ans_j").alias("ans_j"))


@query("judge_memo", _PAIRS_SQL + "SELECT metric, query, method_i, method_j, CASE WHEN method_i = 'm0' THEN 'TIE' ELSE decision END AS decision, method_i <> 'm0' AS judged FROM judged")
def judge_memo(g):
    p = _pairs(g)
    memo = p.where("method_i = 'm0'").select("metric", "query", "ans_i", "ans_j", F.lit(" maybe ").alias("decision"))
    return E.judge_with_memo(p, memo).select("metric", "query", "method_i", "method_j", "decision", "judged")


@query("winrate_matrix", _PAIRS_SQL + "SELECT metric, method_i, method_j, round(rate, 6) AS rate FROM rates")
def winrate_matrix(g):
    return _rates(g).withColumn("rate", F.round("rate", 6))


@query("winrate_cells", _PAIRS_SQL + """, c AS (SELECT *, round_even(rate * 100, 0)::BIGINT AS p FROM rates)
SELECT a.metric, a.method_i, a.method_j, CASE WHEN a.method_i <= a.method_j THEN a.p ELSE 100 - b.p END AS percent FROM c a JOIN c b ON a.metric = b.metric AND a.method_i = b.method_j AND a.method_j = b.method_i""")
def winrate_cells(g):
    r = _rates(g)
    named = r.select("metric", F.concat("method_i", F.lit(" (k=10)")).alias("method_i"), F.concat("method_j", F.lit(" (k=10)")).alias("method_j"), "rate")
    return E.winrate_cells(named)


_ELO_SQL = _PAIRS_SQL + """, games AS MATERIALIZED (SELECT metric, list({'i': i, 'j': j, 'w': rate} ORDER BY i, j) AS games FROM (SELECT r.*, substr(method_i, 2)::INT + 1 AS i, substr(method_j, 2)::INT + 1 AS j FROM rates r WHERE method_i <> method_j) GROUP BY 1),
fold AS (SELECT metric, games, 0 AS step, [1500.0::DOUBLE, 1500, 1500, 1500, 1500] AS r FROM games
  UNION ALL SELECT metric, games, step + 1, list_transform(r, lambda x, n: CASE WHEN n = g.i THEN x + gain WHEN n = g.j THEN x - gain ELSE x END) FROM (
    SELECT metric, games, step, r, g, 32 * (g.w - 1 / (1 + 10 ** ((r[g.j] - r[g.i]) / 400))) AS gain FROM (SELECT *, games[step % 20 + 1] AS g FROM fold WHERE step < 2000))),
done AS (SELECT metric, r, 1500 - list_avg(r) AS shift FROM fold WHERE step = 2000),
elo AS MATERIALIZED (SELECT metric, 'm' || (i - 1) AS method, r[i] + shift AS elo FROM done, (SELECT unnest(range(1, 6)) AS i))
"""


@query("elo_ratings", _ELO_SQL + "SELECT metric, method, round(elo, 4) AS elo FROM elo")
def elo_ratings(g):
    return E.elo(_rates(g)).withColumn("elo", F.round("elo", 4))


def _ratings(g):
    """Ratings of two k: the second one's are those of the first, halved in their distance from the mean."""
    r = E.elo(_rates(g))
    return r.select(F.lit(10).alias("k"), "metric", "method", "elo").unionByName(r.select(F.lit(30).alias("k"), "metric", "method", ((F.col("elo") + 1500) / 2).alias("elo")))


_RATINGS_SQL = _ELO_SQL + ", ratings AS (SELECT 10 AS k, * FROM elo UNION ALL SELECT 30, metric, method, (elo + 1500) / 2 FROM elo)"


@query("elo_avg_by_k", _RATINGS_SQL + "SELECT k, method, round(avg(elo), 4) AS elo, count(*) AS metrics FROM ratings GROUP BY 1, 2")
def elo_avg_by_k(g):
    return E.elo_average(_ratings(g)).withColumn("elo", F.round("elo", 4))


@query("elo_delta", _RATINGS_SQL + "SELECT r.k, r.metric, r.method, round(r.elo - b.elo, 4) AS delta FROM ratings r JOIN ratings b ON r.k = b.k AND r.metric = b.metric AND b.method = 'm0'")
def elo_delta(g):
    return E.elo_delta(_ratings(g), "m0").withColumn("delta", F.round("delta", 4))


@query("elo_merge_latest", _RATINGS_SQL + "SELECT k, metric, method, round(CASE WHEN k = 10 THEN elo + 1 ELSE elo END, 4) AS elo FROM ratings")
def elo_merge_latest(g):
    r = _ratings(g)
    old, new = r.withColumn("file", F.lit("run_1.csv")), r.where("k = 10").withColumn("elo", F.col("elo") + 1).withColumn("file", F.lit("run_2.csv"))
    return readers.latest_per_k(old.unionByName(new)).select("k", "metric", "method", F.round("elo", 4).alias("elo"))


_ITEMS_SQL = GRAPH_SQL + """, t AS (SELECT doc_id || '_chunk_' || chunk_no AS doc_id, pos, lower(source) AS h, lower(target) AS t FROM rel),
gold AS (SELECT DISTINCT doc_id, h, 'next' AS r, t FROM t WHERE pos % 3 <> 2), pred AS (SELECT DISTINCT doc_id, h, CASE WHEN pos % 4 = 1 THEN 'near' ELSE 'next' END AS r, t FROM t),
items AS (SELECT DISTINCT doc_id FROM t)
"""


@query("strict_f1", _ITEMS_SQL + """, c AS (SELECT i.doc_id, (SELECT count(*) FROM gold g WHERE g.doc_id = i.doc_id) AS ng, (SELECT count(*) FROM pred p WHERE p.doc_id = i.doc_id) AS np, (SELECT count(*) FROM gold g JOIN pred p USING (doc_id, h, r, t) WHERE doc_id = i.doc_id) AS tp FROM items i)
SELECT round(2.0 * sum(tp) / (sum(ng) + sum(np)), 6) AS strict_micro_f1, round(avg(CASE WHEN ng = 0 AND np = 0 THEN 1.0 ELSE 2.0 * tp / (ng + np) END), 6) AS strict_macro_f1, count(*) AS n_items FROM c""")
def strict_f1(g):
    return E.strict_f1(g.triple_items).withColumns({c: F.round(c, 6) for c in ("strict_micro_f1", "strict_macro_f1")})


def _strings(c):
    return F.transform(c, lambda x: F.concat_ws(" ", x["h"], x["r"], x["t"]))


@query("soft_f1")
def soft_f1(g):
    return E.soft_f1(g.triple_items.select("index", _strings("gold").alias("gold"), _strings("pred").alias("pred")))


@query("triple_pairs", _ITEMS_SQL + "SELECT doc_id AS index, concat_ws(' ', g.h, g.r, g.t) AS gold, concat_ws(' ', p.h, p.r, p.t) AS pred FROM gold g JOIN pred p USING (doc_id)")
def triple_pairs(g):
    return E.triple_pairs(g.triple_items.select("index", _strings("gold").alias("gold"), _strings("pred").alias("pred")))


_RUNS_SQL = GRAPH_SQL + ", runs AS (SELECT method AS algorithm, query, k, k + ord AS actual_k, CASE WHEN k = 10 THEN answer ELSE substr(answer, 1, length(answer) // 2) END AS answer FROM answers, (SELECT unnest([10, 30]) AS k))"


def _runs(g):
    a = g.answers.select(F.col("method").alias("algorithm"), "query", "ord", "answer", F.explode(F.array(F.lit(10), F.lit(30))).alias("k"))
    half = F.when(F.col("k") == 10, F.col("answer")).otherwise(F.substring("answer", F.lit(1), F.floor(F.length("answer") / 2).cast("int")))
    return a.select("algorithm", "query", "k", (F.col("k") + F.col("ord")).alias("actual_k"), half.alias("answer"))


@query("k_adherence", _RUNS_SQL + "SELECT algorithm, round(avg(1 - abs(actual_k - k) / k::DOUBLE), 6) AS avg_adherence FROM runs GROUP BY 1")
def k_adherence(g):
    return E.k_adherence(_runs(g)).withColumn("avg_adherence", F.round("avg_adherence", 6))


@query("coverage_efficiency", _RUNS_SQL + "SELECT algorithm, round(avg(e), 6) AS avg_efficiency FROM (SELECT algorithm, k, avg(length(answer)) / max(actual_k) AS e FROM runs GROUP BY 1, 2) GROUP BY 1")
def coverage_efficiency(g):
    return E.coverage_efficiency(_runs(g).withColumn("answer_length", F.length("answer"))).withColumn("avg_efficiency", F.round("avg_efficiency", 6))


@query("answer_consistency", _RUNS_SQL + r""", w AS (SELECT algorithm, query, k, list_distinct(list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '')) AS w FROM runs),
p AS (SELECT a.algorithm, a.query, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS j FROM w a JOIN w b ON a.algorithm = b.algorithm AND a.query = b.query AND a.k < b.k WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT algorithm, round(avg(j), 6) AS avg_consistency, count(*) AS queries FROM p GROUP BY 1""")
def answer_consistency(g):
    return E.answer_consistency(_runs(g)).withColumn("avg_consistency", F.round("avg_consistency", 6))


@query("best_algorithm", GRAPH_SQL + "SELECT method AS algorithm, count(*) AS total FROM answers GROUP BY 1 ORDER BY total DESC, algorithm LIMIT 1")
def best_algorithm(g):
    return E.best_algorithm(g.answers.groupBy(F.col("method").alias("algorithm")).agg(F.count(F.lit(1)).alias("total")))


_TIMES_SQL = """WITH t AS (SELECT 'a' || (l_linenumber % 3) AS algorithm, l_orderkey AS n, CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 5 THEN 0.0 ELSE l_quantity * l_orderkey END AS s FROM lineitem)"""


@query("scaling_exponent", _TIMES_SQL + " SELECT algorithm, round(regr_slope(ln(s), ln(n)), 6) AS exponent, count(*) AS points FROM t WHERE s > 0 GROUP BY 1")
def scaling_exponent(g):
    s = F.when(F.col("l_linenumber") == 6, None).when(F.col("l_linenumber") == 5, 0.0).otherwise(F.col("l_quantity") * F.col("l_orderkey"))
    t = g.table("lineitem").select(F.concat(F.lit("a"), (F.col("l_linenumber") % 3).cast("string")).alias("algorithm"), F.col("l_orderkey").alias("N"), s.alias("seconds"))
    return E.scaling_exponent(t).withColumn("exponent", F.round("exponent", 6))


@query("size_ladder", GRAPH_SQL + ", n AS (SELECT count(*) AS n FROM vertices) SELECT DISTINCT s AS n FROM (SELECT unnest([50, 100, 200, 350, 500, 750, 1000, 1500]) AS s, n FROM n) WHERE s <= n UNION SELECT n FROM n")
def size_ladder(g):
    return g.spark.createDataFrame([(x,) for x in E.size_ladder(g.vertices.count())], "n bigint")


