import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate as E
from graphloom.operators import reports as R
from graphloom.sources import models, readers, writers
from graphloom.streaming import events


def loop_elo(methods, rate):
    r = dict.fromkeys(methods, 1500.0)
    for _ in range(100):
        for i in methods:
            for j in methods:
                if i != j:
                    gain = 32 * (rate[i, j] - 1 / (1 + 10 ** ((r[j] - r[i]) / 400)))
                    r[i] += gain
                    r[j] -= gain
    mean = sum(r.values()) / len(r)
    return {m: x + 1500 - mean for m, x in r.items()}


def rates(spark, rate):
    return spark.createDataFrame([("q", i, j, float(w)) for (i, j), w in rate.items()], "metric string, method_i string, method_j string, rate double")


def test_elo(spark):
    methods = ["a", "b", "c"]
    even = {(i, j): 0.5 for i in methods for j in methods}
    assert all(abs(r.elo - 1500) < 1e-9 for r in E.elo(rates(spark, even)).collect())
    some = even | {("a", "b"): 0.7, ("b", "a"): 0.3, ("a", "c"): 0.9, ("c", "a"): 0.1}
    got = {r.method: r.elo for r in E.elo(rates(spark, some)).collect()}
    want = loop_elo(methods, some)
    assert all(abs(got[m] - want[m]) < 1e-6 for m in methods) and abs(sum(got.values()) / 3 - 1500) < 1e-9


def test_winrates_mirror(spark):
    judged = spark.createDataFrame([("q", "a", "b", "A"), ("q", "a", "b", "TIE"), ("q", "a", "b", "B"), ("q", "a", "b", "A")], "metric string, method_i string, method_j string, decision string")
    methods = spark.createDataFrame([("a",), ("b",), ("c",)], "method string")
    got = {(r.method_i, r.method_j): r.rate for r in E.winrates(judged, methods, spark.createDataFrame([("q",)], "metric string")).collect()}
    assert got["a", "b"] == 0.625 and got["a", "c"] == 0.5 and got["a", "a"] == 0.5
    assert all(abs(got[i, j] + got[j, i] - 1) < 1e-12 for i, j in got)


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 2), (5, 5)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        s = rng.random(shape)
        rows, cols = E.assignment(s)
        short = min(shape)
        best = max(sum(s[i, j] for i, j in zip(r, c, strict=True)) for r in itertools.combinations(range(shape[0]), short) for c in itertools.permutations(range(shape[1]), short))
        assert len(set(rows)) == len(set(cols)) == short and abs(s[rows, cols].sum() - best) < 1e-9


def test_f1_of_empty_sides(spark):
    items = [(0, [], []), (1, [("a", "r", "b")], []), (2, [], [("a", "r", "b")]), (3, [("a", "r", "b"), ("c", "r", "d")], [("a", "r", "b")])]
    df = spark.createDataFrame(items, "index bigint, gold array<struct<h:string,r:string,t:string>>, pred array<struct<h:string,r:string,t:string>>")
    s = E.strict_f1(df).first()
    assert abs(s.strict_micro_f1 - 2 / (2 + 1 + 2)) < 1e-9 and abs(s.strict_macro_f1 - (1 + 0 + 0 + 2 / 3) / 4) < 1e-9
    text = lambda c: F.transform(c, lambda x: F.concat_ws(" ", x["h"], x["r"], x["t"]))
    soft = E.soft_f1(df.select("index", text("gold").alias("gold"), text("pred").alias("pred"))).first()
    # Item precisions 1, 1, 0, 1 weighed by 0, 0, 1, 1 predictions.
    p, r = 1 / 2, 1 / 3
    assert abs(soft.soft_micro_f1 - 2 * p * r / (p + r)) < 1e-9
    none = E.soft_f1(df.where("index < 2").select("index", text("gold").alias("gold"), text("pred").alias("pred"))).first()
    assert none.soft_macro_f1 == 0.0


def test_soft_f1_with_any_index(spark):
    """The text graph's items are named by chunk, as ``12_chunk_0``."""
    items = [("12_chunk_0", ["a r b", "c r d"], ["c r d", "a r x"]), (None, ["a r b"], ["a r b"])]
    got = E.soft_f1(spark.createDataFrame(items, "index string, gold array<string>, pred array<string>")).first()
    assert abs(got.soft_macro_f1 - (5 / 6 + 1) / 2) < 1e-9 and abs(got.soft_micro_f1 - (5 / 3 + 1) / 3) < 1e-9
    assert (got.n_items, got.pred_total, got.gold_total) == (2, 3, 3)


def test_scaling(spark):
    rows = [("x", n, 2.0 * n**1.5) for n in (10, 100, 1000)] + [("x", 50, None), ("x", 60, float("nan")), ("y", 10, 1.0)]
    got = {r.algorithm: r.exponent for r in E.scaling_exponent(spark.createDataFrame(rows, "algorithm string, N bigint, seconds double")).collect()}
    assert abs(got["x"] - 1.5) < 1e-9 and got["y"] is None
    assert E.size_ladder(120) == [50, 100, 120] and E.size_ladder(30) == [30]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, value in {"a": {"text": "one", "title": "T"}, "b": {"content": "two"}, "c": {"text": "  "}}.items():
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "d" / "bad.json").write_text("{not json")
    got = [(r.id, r.title, r.text) for r in readers.json_documents(spark, str(tmp_path / "d")).orderBy("id").collect()]
    assert got == [("doc_0", "T", "one"), ("doc_1", "b", "two")]
    times = spark.createDataFrame([("x", 10, 1.5), ("x", 20, float("nan"))], "algorithm string, N bigint, seconds double")
    writers.write_timings(times, str(tmp_path / "t"))
    assert {(r.N, r.seconds) for r in readers.timings(spark, str(tmp_path / "t")).collect()} == {(10, 1.5), (20, None)}
    (tmp_path / "items.json").write_text(json.dumps([{"text": "t", "triple_list": [["a", "r", "b"]]}]))
    assert readers.triple_items(spark, str(tmp_path / "items.json"), 5).first().triple_list == [["a", "r", "b"]]
    (tmp_path / "memo.json").write_text(json.dumps([{"metric": "m", "ans_i": "x"}]))
    r = readers.judgements(spark, str(tmp_path / "memo.json")).first()
    assert (r.query, r.decision) == ("", "TIE")
    writers.write_summary(spark.createDataFrame([(0.5, 3)], "f1 double, n int"), str(tmp_path / "s"))
    assert {r.value for r in spark.read.text(str(tmp_path / "s")).collect()} == {"f1: 0.5000", "n: 3"}


def test_model_calls_keep_order_and_errors(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "i int, p string").coalesce(1)
    got = {r.i: (r.completion, r.error) for r in R.map_model(df, model, "p").collect()}
    assert got == {1: ("A", None), 2: (None, "no"), 3: ("C", None)}
    calls = []
    flaky = models.chat(lambda p: calls.append(p) or (_ for _ in ()).throw(OSError()) if len(calls) < 2 else "ok", wait=lambda s: None)
    assert flaky(["x"]) == ["ok"]
    assert abs(np.linalg.norm(models.hashing_embedder(8)(["a b"])[0]) - 1) < 1e-9


def test_search(spark):
    rows = [(0, 1, "t", "s", "alpha entities here", 2.0), (0, 2, "t", "s", "no match at all", 1.0), (0, 3, "t", "", "short", 1.0)]
    reports = spark.createDataFrame(rows, "level bigint, community bigint, title string, summary string, full_content string, rank double")
    r = R.global_search(reports, "What entities?").first()
    assert (r.responses, r.answer) == (1, "Level 0: alpha entities here")
    assert R.global_search(reports, "zzzz?").first().responses == 0


def test_event_windows_stream(spark):
    q = events.tumbling_counts(events.read_events(spark, "/root/testdata/sf0.001", "events.parquet")).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_words_whose_signs_cancel_out_have_a_unit_vector():
    """'esue: in 109 documents' has only two buckets besides the first word's: with a word that cancels 'in', as here, all is 0 by signs."""
    from zlib import crc32

    sign = lambda w: (crc32(w.encode()) % 64, 1 if crc32(w.encode()) >> 16 & 1 else -1)
    bucket, s = sign("in" if sign("109") == (sign("documents")[0], -sign("documents")[1]) else "documents")
    word = next(w for w in (f"w{i}:" for i in range(10_000)) if sign(w) == (bucket, -s))
    assert abs(np.linalg.norm(models.hashing_embedder(64)([f"{word} in 109 documents"])[0]) - 1) < 1e-9
    assert not models.hashing_embedder(64)([""])[0].any()
