import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import mixing, sharding
from graphloom.llm.common import WORD


def test_shards_are_balanced_and_gapless(docs, corpus):
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert len(rows) == len(corpus)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    mean = sum(size.values()) / 5
    biggest = max(r["size"] for r in rows)
    assert max(size.values()) <= max(1.05 * mean, biggest + 1)
    for r in rows:
        text = next(t for i, t, *_ in corpus if i == r.doc_id)
        assert r["size"] == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode())


def test_small_groups_stay_together_and_reruns_agree(spark):
    rows = [(i, f"text {i // 2} " + "x" * (i % 7)) for i in range(0, 400)] + [(1000 + i, "same") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: {r.doc_id: r.shard for r in sharding.shard_documents(df, shards=8, heavy_share=4, cell_groups=50).collect()}
    a = run()
    assert a == run()
    assert len({a[1000 + i] for i in range(900)}) > 1, "a hot text is spread"
    count = np.bincount(list(a.values()), minlength=8)
    assert count.max() - count.min() <= 0.2 * count.mean()


def plain_pack(demand, shards):
    """The rule told anew: largest share first; highest dot product with what is left among shards with room."""
    total = demand.sum(axis=0)
    left, got = [[1 / shards] * 3 for _ in range(shards)], [0] * len(demand)
    share = [[x / max(t, 1e-9) for x, t in zip(d, total)] for d in demand.tolist()]
    for i in sorted(range(len(demand)), key=lambda i: -max(share[i])):
        d = share[i]
        rest = [min(left[s][k] - d[k] + (sharding.SLACK / shards if k else 0) for k in range(3)) for s in range(shards)]
        fits = [s for s in range(shards) if rest[s] >= 0]
        best = max(fits, key=lambda s: sum(w * x * y for w, x, y in zip(sharding.WEIGHT, left[s], d))) if fits else max((s for s in range(shards) if left[s][0] > -sharding.SLACK / shards), key=lambda s: rest[s])
        got[i] = best
        left[best] = [x - y for x, y in zip(left[best], d)]
    return got


def test_placement_equals_brute_force():
    rng = np.random.default_rng(5)
    demand = np.column_stack([rng.integers(20, 4000, 300), rng.integers(1, 700, 300), rng.integers(1, 9, 300)]).astype(float)
    assert sharding.pack(demand, np.tile(demand.sum(axis=0) / 7, (7, 1))).tolist() == plain_pack(demand, 7)


def test_bytes_tokens_and_rows_are_balanced_jointly(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "x" * int(rng.integers(1, 9)) if i % 3 == 0 else "word " * int(rng.lognormal(4, 1))) for i in range(4000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, cell_groups=1000)
    got = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("rows")).toPandas()
    for c in ("bytes", "tokens", "rows"):
        assert got[c].max() / got[c].mean() < 1.06 and got[c].min() / got[c].mean() > 0.94, c


def test_one_text_without_ids_or_under_one_id_is_spread(spark):
    for own in (None, 7):
        rows = [(own, "hot text " * 20)] * 2000 + [(i, f"{i} " * 30) for i in range(1000)]
        out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=10)
        size = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
        assert len(size) == 10 and max(size) < 1.1 * sum(size) / 10
        slots = out.groupBy("shard").agg(F.max("slot").alias("m"), F.count_distinct("slot").alias("n"), F.count("*").alias("c")).collect()
        assert all(r.m + 1 == r.n == r.c for r in slots)


def test_pack_takes_the_shard_with_the_highest_dot_product():
    cap = np.array([[10.0, 1.0, 5.0], [10.0, 9.0, 5.0]])
    assert sharding.pack(np.array([[1.0, 5.0, 1.0]]), cap).tolist() == [1]


def test_shard_extra_columns_and_empty(spark, docs, empty):
    assert sharding.shard_documents(empty).count() == 0
    clash = docs.withColumn("shard", F.lit("x")).withColumn("size", F.lit(1))
    assert sharding.shard_documents(clash, shards=3).count() == docs.count()


def _targets(sizes):
    """Water filling as told: share out, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    got, left, active = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and active:
        w = sum(weight[s] for s in active)
        extra = 0.0
        for s in sorted(active, key=str):
            got[s] += left * weight[s] / w
        for s in list(active):
            if got[s] >= 2 * sizes[s]:
                extra += got[s] - 2 * sizes[s]
                got[s] = 2 * sizes[s]
                active.discard(s)
        left = extra
    return got


def test_mix_hits_targets(docs, corpus):
    import re

    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(WORD, r.text or ""))
        assert len(r.draws) == r.taken_times <= 2
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.taken_times
    want = _targets(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 10), s


def test_mix_reruns_agree_and_mixed_repeats(docs):
    one = {(r.doc_id, r.text): list(r.draws) for r in mixing.mix(docs).collect()}
    assert one == {(r.doc_id, r.text): list(r.draws) for r in mixing.mix(docs.repartition(3)).collect()}
    table = mixing.mix(docs)
    assert mixing.mixed(table, ["doc_id"]).count() == table.agg(F.sum("taken_times")).first()[0]


def test_quotas_add_up(spark):
    per = spark.createDataFrame([("a", 40, 1, 0.0, None), ("b", 25, 0, 3.0, 9), (None, 3, 2, 0.0, None)], "source string, n_blocks long, full int, rest double, edge long")
    drawn = mixing.draw_blocks(per, shards=7).collect()
    want = {("a", b, 1) for b in range(40)} | {("b", b, 1) for b in range(10)} | {(None, b, p) for b in range(3) for p in (1, 2)}
    assert len(drawn) == len(want) and {(r.source, r.block, r["pass"]) for r in drawn} == want
    quotas = spark.createDataFrame([("a", 40), ("b", 10), (None, 6)], "source string, blocks long")
    tree = {(r.level, r.node): r for r in mixing.splitting_tree(quotas, 7).collect()}
    assert [tuple(q) for q in tree[0, 0].quotas] == [("a", 40), ("b", 10), (None, 6)]
    for (level, node), r in tree.items():
        assert r.n == sum(q.blocks for q in r.quotas)
        if r.hi - r.lo > 1:
            a, b = tree[level + 1, 2 * node], tree[level + 1, 2 * node + 1]
            assert a.lo == r.lo and a.hi == b.lo and b.hi == r.hi and a.n == r.n * (a.hi - a.lo) // (r.hi - r.lo)
            assert [x.blocks + y.blocks for x, y in zip(a.quotas, b.quotas)] == [q.blocks for q in r.quotas]
    shards = {r.lo: {q.source: q.blocks for q in r.quotas if q.blocks} for r in tree.values() if r.hi - r.lo == 1}
    got = defaultdict(lambda: defaultdict(int))
    for r in drawn:
        got[r.shard][r.source] += 1
    assert {k: dict(v) for k, v in got.items()} == shards


def test_draws_are_hypergeometric(spark):
    """Quantiles of a grid of u, and the mean and spread over seeds, against exact probabilities."""
    from math import comb

    for total, special, drawn in [(10, 4, 5), (60, 33, 20), (7, 7, 3), (9, 0, 4), (3000, 1000, 1500)]:
        low, high = max(0, drawn - total + special), min(special, drawn)
        cum, acc = [], 0
        for k in range(low, high + 1):
            acc += comb(special, k) * comb(total - special, drawn - k)
            cum.append(acc / comb(total, drawn))
        us = [(i + 0.5) / 200 for i in range(200)]
        df = spark.createDataFrame([(u, total, special, drawn) for u in us], "u double, n long, k long, d long")
        got = [r[0] for r in df.select(mixing.hypergeometric(F.col("u"), F.col("n"), F.col("k"), F.col("d"))).collect()]
        assert got == [low + int(np.searchsorted(cum, u)) for u in us]
    quotas = spark.createDataFrame([("a", 30), ("b", 20), ("c", 10)], "source string, blocks long")
    firsts = np.array([[q.blocks for q in mixing.splitting_tree(quotas, 2, f"s{i}").where("level = 1 AND node = 0").first().quotas] for i in range(40)])
    assert np.abs(firsts.mean(axis=0) - [15, 10, 5]).max() < 1.5 and firsts.std(axis=0).min() > 0.5 and (firsts.sum(axis=1) == 30).all()


def test_a_large_boundary_block_is_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    rows = [(i, "w " * (i % 23), f"s{i % 3}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.taken_times
    for s, t in _targets(sizes).items():
        assert abs(taken[s] - t) <= 25, s


def test_mix_with_columns_of_any_name(docs):
    odd = docs.select("*", *[F.lit(7).alias(c) for c in ("block", "rest", "star", "ps", "full", "n_blocks", "pass", "shard", "a.b", "x`y", "row", "is")])
    out = mixing.mix(odd)
    assert out.count() == docs.count() and {"a.b", "x`y", "block"} <= set(out.columns)
    assert mixing.mixed(out, ["doc_id", "pass", "a.b"]).columns == ["doc_id", "pass", "a.b", "shard"]


def test_mix_empty_and_zero_sources(spark, empty):
    assert mixing.mix(empty).count() == 0
    df = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (3, "a b c", "y")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert got[1].target == 0 and got[3]["size"] == 3
