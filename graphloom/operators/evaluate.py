"""Comparing methods: judgements, win-rates, Elo, F1 and scaling fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clean_verdict, jaccard, truncate_answer, valid_answer, word_set

#: Fixed values of the rating.
ELO_START, ELO_K, ELO_ROUNDS = 1500.0, 32.0, 100


def judge_pairs(answers: DataFrame, metrics: DataFrame) -> DataFrame:
    """``answers(method, ord, query, answer)``: valid pairs of methods i < j on each query, for every metric, cut to fair lengths."""
    a = answers.where(valid_answer(F.col("answer")))
    left = a.select("query", F.col("method").alias("method_i"), F.col("ord").alias("oi"), F.col("answer").alias("ai"))
    right = a.select("query", F.col("method").alias("method_j"), F.col("ord").alias("oj"), F.col("answer").alias("aj"))
    cap = F.least(F.length("ai"), F.length("aj"), F.lit(1400))
    pairs = left.join(right, "query").where("oi < oj")
    pairs = pairs.select("query", "method_i", "method_j", "oi", "oj", truncate_answer(F.col("ai"), cap).alias("ans_i"), truncate_answer(F.col("aj"), cap).alias("ans_j"))
    return pairs.join(F.broadcast(metrics))  # a handful of metric names


def judge_by_length(pairs: DataFrame) -> DataFrame:
    """The offline judge: longer text wins, for ``Directness`` the shorter one; equal is a tie."""
    d = F.length("ans_i") - F.length("ans_j")
    d = F.when(F.col("metric") == "Directness", -d).otherwise(d)
    return pairs.withColumn("decision", F.when(d > 0, "A").when(d < 0, "B").otherwise("TIE"))


def judge_with_memo(pairs: DataFrame, memo: DataFrame, judge=judge_by_length) -> DataFrame:
    """Known verdicts from ``memo``; only pairs it lacks are judged. The key is direction-sensitive."""
    key = ["metric", "query", "ans_i", "ans_j"]
    known = memo.groupBy(*key).agg(clean_verdict(F.max("decision")).alias("decision"))
    old = pairs.join(known, key).withColumn("judged", F.lit(False))
    new = judge(pairs.join(known, key, "left_anti")).withColumn("judged", F.lit(True))
    return old.select(*pairs.columns, "decision", "judged").unionByName(new.select(*pairs.columns, "decision", "judged"))


def winrates(judged: DataFrame, methods: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(metric, method_i, method_j, rate)`` of every ordered pair; without a comparison, and against itself, 0.5."""
    won = F.sum(F.when(F.col("decision") == "A", 1.0).when(F.col("decision") == "TIE", 0.5).otherwise(0.0))
    up = judged.groupBy("metric", "method_i", "method_j").agg((won / F.count(F.lit(1))).alias("rate"))
    down = up.select("metric", F.col("method_j").alias("method_i"), F.col("method_i").alias("method_j"), (1 - F.col("rate")).alias("rate"))
    m = methods.select("method")  # a handful of names, so their pairs are too
    grid = F.broadcast(metrics).join(F.broadcast(m.select(F.col("method").alias("method_i")))).join(F.broadcast(m.select(F.col("method").alias("method_j"))))
    return grid.join(up.unionByName(down), ["metric", "method_i", "method_j"], "left").select("metric", "method_i", "method_j", F.coalesce("rate", F.lit(0.5)).alias("rate"))


def winrate_cells(rates: DataFrame) -> DataFrame:
    """Per cent of a heat map: the upper triangle rounded half to even, the lower as its complement. Labels lose `` (k=...)``."""
    a = rates.select("metric", "method_i", "method_j", F.bround(F.col("rate") * 100).cast("bigint").alias("up"))
    b = a.select("metric", F.col("method_i").alias("method_j"), F.col("method_j").alias("method_i"), F.col("up").alias("other"))
    label = lambda c: F.split_part(F.col(c), F.lit(" (k="), F.lit(1))
    cell = F.when(F.col("method_i") <= F.col("method_j"), F.col("up")).otherwise(100 - F.col("other"))
    return a.join(b, ["metric", "method_i", "method_j"]).select("metric", label("method_i").alias("method_i"), label("method_j").alias("method_j"), cell.alias("percent"))


def elo(rates: DataFrame, k: float = ELO_K, rounds: int = ELO_ROUNDS) -> DataFrame:
    """Ratings by an ordered fold over all pairs, round after round; the state of a metric is one map of a few methods."""
    rows = rates.where("method_i <> method_j").groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("method_i", "method_j", "rate"))).alias("games"), F.array_sort(F.collect_set("method_i")).alias("methods"))
    idx = lambda m: F.array_position(F.col("methods"), m).cast("int")
    games = F.transform("games", lambda g: F.struct(idx(g["method_i"]).alias("i"), idx(g["method_j"]).alias("j"), g["rate"].alias("w")))
    start = F.transform("methods", lambda _: F.lit(ELO_START))

    def play(r, g):
        i, j = g["i"], g["j"]
        gain = k * (g["w"] - 1 / (1 + F.pow(F.lit(10.0), (F.element_at(r, j) - F.element_at(r, i)) / 400)))
        return F.transform(r, lambda x, n: F.when(n + 1 == i, x + gain).when(n + 1 == j, x - gain).otherwise(x))

    # One round on a time: the fold's list stays as short as a round.
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda r, _: F.aggregate(F.col("games"), r, play))
    rows = rows.withColumn("games", games).withColumn("r", fold)
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r")
    rows = rows.withColumn("shift", ELO_START - mean)
    return rows.select("metric", F.explode(F.arrays_zip("methods", "r")).alias("x"), "shift").select("metric", F.col("x.methods").alias("method"), (F.col("x.r") + F.col("shift")).alias("elo"))


def elo_average(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("k", "method").agg(F.avg("elo").alias("elo"), F.count(F.lit(1)).alias("metrics"))


def elo_delta(ratings: DataFrame, baseline: str) -> DataFrame:
    """Rating minus the baseline method's, for the same k and metric, and the padded range of a plot."""
    base = ratings.where(F.col("method") == baseline).select("k", "metric", F.col("elo").alias("base"))
    return ratings.join(base, ["k", "metric"]).select("k", "metric", "method", (F.col("elo") - F.col("base")).alias("delta"))


def delta_range(deltas: DataFrame) -> DataFrame:
    span = F.max("delta") - F.min("delta")
    pad = F.greatest(F.lit(20.0), 0.08 * span)
    return deltas.agg((F.min("delta") - pad).alias("low"), (F.max("delta") + pad).alias("high"))


def strict_f1(items: DataFrame) -> DataFrame:
    """``items(gold, pred)`` arrays of triples: exact-match F1 over all (micro) and by item (macro)."""
    g, p = F.array_distinct("gold"), F.array_distinct("pred")
    both = F.size(F.array_intersect(g, p))
    none = (F.size(g) == 0) & (F.size(p) == 0)
    x = items.select(both.alias("tp"), (F.size(p) - both).alias("fp"), (F.size(g) - both).alias("fn"), none.alias("none"))
    f = lambda tp, fp, fn: F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    x = x.withColumn("f1", F.when(F.col("none"), 1.0).otherwise(f(F.col("tp"), F.col("fp"), F.col("fn"))))
    s = x.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro"), F.count(F.lit(1)).alias("n"))
    return s.select(F.coalesce(f(F.col("tp"), F.col("fp"), F.col("fn")), F.lit(0.0)).alias("strict_micro_f1"), F.coalesce("macro", F.lit(0.0)).alias("strict_macro_f1"), F.col("n").alias("n_items"))


def assignment(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of greatest total score: shortest augmenting paths with potentials."""
    turned = score.shape[0] > score.shape[1]
    cost = -(score.T if turned else score)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        best, prev, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[j]:
            used[j] = True
            slack = np.where(used[1:], np.inf, cost[owner[j] - 1] - u[owner[j]] - v[1:])
            better = slack < best[1:]
            best[1:][better], prev[1:][better] = slack[better], j
            free = np.where(used, np.inf, best)
            free[0] = np.inf
            nxt = int(free.argmin())
            step = free[nxt]
            u[owner[used]] += step
            v[used] -= step
            best[~used] -= step
            j = nxt
        while j:
            owner[j] = owner[prev[j]]
            j = prev[j]
    cols = np.flatnonzero(owner[1:])
    rows = owner[1:][cols] - 1
    return (cols, rows) if turned else (rows, cols)


def token_similarity(gold: str, pred: str) -> float:
    """The offline soft match of two triples as text: F1 of their word multisets."""
    a, b = gold.lower().split(), pred.lower().split()
    if not a or not b:
        return float(a == b)
    rest, hit = list(b), 0
    for w in a:
        if w in rest:
            rest.remove(w)
            hit += 1
    return 2 * hit / (len(a) + len(b))


def soft_f1(items: DataFrame, similarity=token_similarity) -> DataFrame:
    """``items(gold array<string>, pred array<string>)``: F1 under the best one-to-one match of each item.

    Items are independent rows, so the matching is a row-wise Arrow pass; micro
    precision and recall both weigh an item's precision by its predictions.
    Other columns, such as an index of any type, are not read.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for g, p in zip(pdf["gold"], pdf["pred"], strict=True):
                g, p = list(g), list(p)
                if not g or not p:
                    out.append((1.0 if not p else 0.0, 1.0 if not g else 0.0, float(not g and not p), len(g), len(p)))
                    continue
                s = np.array([[similarity(x, y) for y in p] for x in g])
                rows, cols = assignment(s)
                hit = s[rows, cols].sum()
                a, b = hit / len(p), hit / len(g)
                out.append((a, b, 2 * a * b / (a + b) if a + b else 0.0, len(g), len(p)))
            yield pd.DataFrame(out, columns=["p", "r", "f1", "ng", "np"])

    x = items.select("gold", "pred").mapInPandas(run, "p double, r double, f1 double, ng bigint, np bigint")
    s = x.agg(F.sum(F.col("p") * F.col("np")).alias("hit"), F.sum("np").alias("np"), F.sum("ng").alias("ng"), F.avg("f1").alias("macro"), F.count(F.lit(1)).alias("n"), F.max(F.least("ng", "np")).alias("any"))
    mp, mr = F.coalesce(F.col("hit") / F.when(F.col("np") > 0, F.col("np")), F.lit(0.0)), F.coalesce(F.col("hit") / F.when(F.col("ng") > 0, F.col("ng")), F.lit(0.0))
    ok = F.col("any") > 0  # without any pair at all every item scores 0
    return s.select(
        F.when(ok & (mp + mr > 0), 2 * mp * mr / (mp + mr)).otherwise(0.0).alias("soft_micro_f1"), F.when(ok, F.col("macro")).otherwise(0.0).alias("soft_macro_f1"),
        F.col("n").alias("n_items"), F.col("np").alias("pred_total"), F.col("ng").alias("gold_total"),
    )


def triple_pairs(items: DataFrame) -> DataFrame:
    """Gold x predicted triples within an item."""
    return items.select("index", F.explode("gold").alias("gold"), "pred").select("index", "gold", F.explode("pred").alias("pred"))


def k_adherence(runs: DataFrame) -> DataFrame:
    return runs.groupBy("algorithm").agg(F.avg(1 - F.abs(F.col("actual_k") - F.col("k")) / F.greatest("k", F.lit(1))).alias("avg_adherence"))


def coverage_efficiency(runs: DataFrame) -> DataFrame:
    """``runs(algorithm, k, actual_k, answer_length)``, a row for each answer."""
    per = runs.groupBy("algorithm", "k").agg((F.avg("answer_length") / F.greatest(F.max("actual_k"), F.lit(1))).alias("e"))
    return per.groupBy("algorithm").agg(F.avg("e").alias("avg_efficiency"))


def answer_consistency(answers: DataFrame) -> DataFrame:
    """``answers(algorithm, query, k, answer)``: mean word-set Jaccard of pairs of k, by query, then by algorithm."""
    w = answers.select("algorithm", "query", "k", word_set(F.col("answer")).alias("w")).where(F.size("w") > 0)
    pairs = w.alias("a").join(w.alias("b"), ["algorithm", "query"]).where("a.k < b.k")
    per = pairs.select("algorithm", "query", jaccard(F.col("a.w"), F.col("b.w")).alias("j")).groupBy("algorithm", "query").agg(F.avg("j").alias("j"))
    return per.groupBy("algorithm").agg(F.avg("j").alias("avg_consistency"), F.count(F.lit(1)).alias("queries"))


def best_algorithm(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min(F.struct((-F.col("total")).alias("neg"), "algorithm")).alias("b")).select("b.algorithm", (-F.col("b.neg")).alias("total"))


def scaling_exponent(timings: DataFrame) -> DataFrame:
    """Slope of ln t on ln N for each algorithm; times that are missing or not positive don't count, one point is no slope."""
    ok = timings.where("seconds IS NOT NULL AND NOT isnan(seconds) AND seconds > 0 AND N > 0")
    return ok.groupBy("algorithm").agg(F.when(F.count(F.lit(1)) >= 2, F.regr_slope(F.log("seconds"), F.log("N"))).alias("exponent"), F.count(F.lit(1)).alias("points"))


def size_ladder(n: int, ladder=(50, 100, 200, 350, 500, 750, 1000, 1500)) -> list[int]:
    return sorted({s for s in ladder if s <= n} | {n})


def ordered_methods(answers: DataFrame) -> DataFrame:
    m = answers.select("method").distinct()
    return m.withColumn("ord", F.row_number().over(Window.orderBy("method")))
