import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import multikey, repeats, substrings, suffixes
from graphloom.llm.windows import Hashes, anchors, sliding_min


def plain_bytes(rows, width):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + width] for p in range(len(b) - width + 1))
    out = []
    for i, b in data:
        m = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                m[p : p + width] = True
        out.append((i, len(b), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), np.frombuffer(b, np.uint8)[~m].tobytes()))
    return out


def plain_words(rows, width):
    first, data = {}, [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, w in data:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, w in data:
        m = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < order(i):
                m[p : p + width] = [True] * width
        kept = b" ".join(x for x, y in zip(w, m, strict=True) if not y)
        out.append((i, len(w), sum(m), kept))
    return out


def key(x):
    return tuple(str(y) for y in x)


@pytest.mark.parametrize("tuning", [{}, {"range_bytes": 4000, "run_bytes": 3000, "chunk": 50}, {"range_bytes": 30000, "chunk": 1000}])
@pytest.mark.parametrize("width", [400, 60])
def test_suffixes_equal_brute_force(docs, corpus, width, tuning):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs.select("doc_id", "text"), width, **tuning).collect()]
    assert sorted(got, key=key) == sorted(plain_bytes([(i, t) for i, t, *_ in corpus], width), key=key)
    assert sum(x[2] for x in got) > 0


@pytest.mark.parametrize("tuning", [{}, {"hot": 2, "run_anchors": 30}])
@pytest.mark.parametrize("width", [13, 4])
def test_substrings_equal_brute_force(docs, corpus, width, tuning):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(docs.select("doc_id", "text"), width, **tuning).collect()]
    assert sorted(got, key=key) == sorted(plain_words([(i, t) for i, t, *_ in corpus], width), key=key)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_any_number_of_batches(docs, corpus, batches):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(docs.select("doc_id", "text"), batches=batches).collect()]
    assert sorted(got, key=key) == sorted(plain_words([(i, t) for i, t, *_ in corpus], 13), key=key)


def test_batches_give_what_one_table_gives(spark, tmp_path, corpus):
    rows = [(i, t) for i, t, *_ in corpus if i is not None]
    rows = list(dict(rows).items())
    random.Random(1).shuffle(rows)
    index = substrings.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=4, max_runs=2)
    history, got = [], []
    cuts = [sorted(rows)[:25], sorted(rows)[25:50], sorted(rows)[50:70], sorted(rows)[70:]]
    for batch in cuts:
        df = spark.createDataFrame(batch, "doc_id long, text string")
        old = spark.createDataFrame(history, "doc_id long, text string") if history else None
        got += [(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in index.add(df, old).collect()]
        history += batch
        index = substrings.FingerprintIndex(spark, index.path, max_runs=2)  # as after a restart
    assert 1 <= len(index.names) <= 3 and index.buckets == 4
    assert sorted(got, key=key) == sorted(plain_words(rows, 13), key=key)


def test_a_batch_reads_only_the_ranges_it_has(spark, tmp_path, corpus):
    """Runs of other ranges may even be unreadable."""
    rows = [(i, t) for i, t, *_ in corpus if i is not None and t]
    index = substrings.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=64)
    index.add(spark.createDataFrame(rows[:40], "doc_id long, text string")).count()
    late = spark.createDataFrame([(1000, rows[0][1])], "doc_id long, text string")
    mine = {r.bucket for r in repeats.runs(substrings._keyed(late, "doc_id", "text", []), index.rule, 64).collect()}
    old = index._read(index.names).collect()
    path = f"file://{tmp_path}/other"
    spoiled = [(r.bucket, bytes(r.payload) if r.bucket in mine else b"") for r in old]
    assert any(not p for _, p in spoiled)
    spark.createDataFrame(spoiled, "bucket int, payload binary").write.parquet(f"{path}/run-64-spoiled")
    out = substrings.FingerprintIndex(spark, path).add(late, spark.createDataFrame(rows[:40], "doc_id long, text string"))
    n = len(rows[0][1].split())
    assert out.first().n_removed == (n if n >= 13 else 0) and n >= 13


def test_periodic_and_many_contexts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = " ".join(word() for _ in range(110))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40))) + " " + passage + " " + " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(100, "xy" * 900), (101, "z" * 399), (102, "w" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for tuning in ({}, {"range_bytes": 2000, "run_bytes": 2000, "chunk": 100}, {"range_bytes": 20000}):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, **tuning).collect()]
        assert sorted(got, key=key) == sorted(plain_bytes(rows, 400), key=key)


def test_empty_and_extra_columns(spark, docs, empty):
    assert suffixes.remove_repeats(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0
    out = suffixes.remove_repeats(docs.withColumn("kept", F.lit(1)).withColumn("doc", F.lit("clash")))
    assert out.count() == docs.count() and "lang" in out.columns


def test_anchor_of_a_window_is_its_leftmost_lowest_gram():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = Hashes(tokens)
    g, c, first, last = anchors(h, 20, 5)
    assert first[0] == 0 and last[-1] == 480 and (first[1:] == last[:-1] + 1).all()
    assert sliding_min(np.array([5, 3, 4, 1, 2], np.uint64), 2).tolist() == [3, 3, 1, 1]
    same = {}
    for p in range(481):
        k = int(np.searchsorted(last, p))
        same.setdefault(tokens[p : p + 20].tobytes(), set()).add(int(g[k]))
    assert all(len(x) == 1 for x in same.values())


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    e = np.zeros(1000, repeats._ENTRY)
    e["g"] = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    e["c"], e["doc"], e["ord"], e["flag"] = rng.integers(0, 1 << 32, 1000), rng.integers(-(1 << 62), 1 << 62, 1000), rng.integers(0, 1 << 20, 1000), 5
    assert (repeats._unpack(repeats._pack(e)) == e).all()
    e["doc"] = rng.integers(7, 9000, 1000)
    assert (repeats._unpack(repeats._pack(e)) == e).all()


def test_contexts_that_agree_in_half_their_bits_are_not_settled(spark):
    class Made(repeats.Rule):
        """Each text is one anchor of the same gram; contexts differ in their low 32 bits only."""

        def of(self, text):
            one = np.zeros(1, np.int64)
            return np.full(1, 7, np.uint64), np.array([0xABCDEF << 32 | int(text)], np.uint64), one, one

    rule = Made(substrings.word_tokens, 13, 6)
    docs = spark.createDataFrame([(i, i, str(i)) for i in range(6)] + [(9, 0, "0")], "doc long, body long, text string").repartition(3)
    for hot in (2, 256):
        told = repeats.merge(repeats.runs(docs, rule, 4, hot).withColumn("fresh", F.lit(True))).collect()
        hot_rows = spark.createDataFrame([tuple(r) for r in told if r.g is not None], repeats._OUT_SCHEMA)
        told = [r for r in told if r.g is None] + repeats.settle_hot(hot_rows).collect()
        assert {r.doc for r in told if r.verdict & repeats.REPEATED} == {9}


@pytest.mark.parametrize("tuning", [{}, {"hot": 2, "run_anchors": 30}])
def test_many_texts_of_one_or_no_id_keep_their_own_words(spark, tuning):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(80), text(80)
    rows = [(None, text(40) + (" " + passage if i % 3 == 0 else "") + " " + text(40)) for i in range(300)]
    rows += [(7, text(30) + " " + (other if i % 2 else passage)) for i in range(40)]
    rows += [(5, other + " " + text(50)), (9, text(60) + " " + passage)]
    rows += [(None, rows[0][1])] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(df, **tuning).collect()]
    assert sorted(got, key=key) == sorted(plain_words(rows, 13), key=key)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, **({"range_bytes": 5000, "chunk": 500} if tuning else {})).collect()]
    assert sorted(got, key=key) == sorted(plain_bytes(rows, 400), key=key)


def test_multikey_quicksort_sorts_and_finds_classes():
    rng = random.Random(8)
    strings = ["".join(rng.choice("ab") for _ in range(rng.choice([24, 24, 24]))).encode() for _ in range(300)]
    strings += strings[:50] + [b"a" * 24] * 40
    words = np.frombuffer(b"".join(strings), ">u8").reshape(-1, 3)
    order, starts = multikey.multikey_quicksort(lambda i, d: words[i, d], len(strings), 3)
    assert [strings[i] for i in order] == sorted(strings) and len(starts) == len(set(strings))
    group = np.array([rng.randrange(4) for _ in strings])
    order, starts = multikey.multikey_quicksort(lambda i, d: words[i, d], len(strings), 3, group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings, strict=True)) and len(starts) == len(set(zip(group, strings, strict=True)))
    assert len(multikey.multikey_quicksort(lambda i, d: words[i, d], 0, 3)[0]) == 0


def test_texts_lose_whole_characters_only(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("äöü漢字") for _ in range(300))
    rows = [(1, "\ufffd" + shared[:200] + "ende"), (2, "x" + shared[:199] + "e"), (3, None), (4, "kurz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in suffixes.remove_repeats(df, as_text=True).collect()}
    assert out[1].kept[0] == "\ufffd" and out[1].kept.endswith("ende") and out[1].n_removed > 400 and out[3].kept == "" and out[4].kept == "kurz"


def test_kept_digest(spark):
    df = spark.createDataFrame([(1, "k" * 10), (2, None)], "doc_id long, text string")
    assert {bytes(r.kept) for r in suffixes.remove_repeats(df).collect()} == {b"k" * 10, b""}
    assert suffixes.sha256_hex(b"") == hashlib.sha256(b"").hexdigest()
