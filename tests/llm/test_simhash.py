import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(ids, fps, radius):
    p = {i: i for i in ids}

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for i, a in enumerate(ids):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                x, y = sorted((find(a), find(ids[j])))
                p[y] = x
    return [find(i) for i in ids]


def test_documents(docs, corpus):
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fp & (2**64 - 1), r.component_id))
    ids = sorted({i for i, *_ in corpus if i is not None})
    text = {i: t for i, t, *_ in corpus}
    fps = [plain_fingerprint(text[i]) for i in ids]
    comp = components(ids, fps, 4)
    for i, f, c in zip(ids, fps, comp, strict=True):
        assert got[i] == {(f, c)}
    assert len(got[None]) == 1


def test_every_pair_within_the_radius_meets_in_a_table():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(20000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not d & m for m in masks)


@pytest.mark.parametrize("bucket", [2, 5, 4096])
def test_links_keep_components_whatever_the_bucket_limit(spark, bucket):
    rng = random.Random(7)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(150):
        f = centre
        for i in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << i
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    ids = list(range(len(fps)))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for f, i in zip(fps, ids, strict=True)]
    edges = simhash.link(spark.createDataFrame(rows, "fp long, doc long"), 4, bucket).collect()
    p = dict(zip(ids, ids, strict=True))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for e in edges:
        assert (fps[e.u] ^ fps[e.v]).bit_count() <= 4
        x, y = sorted((find(e.u), find(e.v)))
        p[y] = x
    assert [find(i) for i in ids] == components(ids, fps, 4)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_one_id_with_two_texts_is_one_document(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "q r s t u v w"), (9, "q r s t u v w")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {5}


def test_search_reaches_all():
    fp = np.array([0, 0b11, 0b1111, 1 << 40], dtype=np.uint64)
    assert len(simhash._search(fp, np.arange(4), 4)) == 3
