import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import media, merkle, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


SPACE = " \t\n\x0b\f\r"
BR = re.compile(r"[ \t\n\x0b\f\r]*")


def plain_leaves(p):
    """Words with the space after them, cut after a word that ends a leaf or after 32; space at the start joins the first."""
    words = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", p)
    if not words:
        return [p] if p else []
    words[0] = BR.match(p)[0] + words[0]
    out, run = [], []
    for w in words:
        run.append(w)
        last = ord(w.strip(SPACE)[-1])
        ends = last % 12 == 0 and 0x24 <= last < 0x100 and not 0x7F <= last < 0xA1
        if ends or len(run) == 32:
            out.append("".join(run))
            run = []
    return out + (["".join(run)] if run else [])


def plain_nodes(text):
    """``[(hash, leaves, [(hash, leaves)])]`` of the sections."""
    out = []
    for s in (text or "").split("\n\n"):
        paragraphs = []
        for p in s.split("\n"):
            leaves = [sha(x)[:32] for x in plain_leaves(p)]
            paragraphs.append((sha("p" + "".join(leaves)), leaves))
        out.append((sha("s" + "".join(h for h, _ in paragraphs)), [x for _, ls in paragraphs for x in ls], paragraphs))
    return out


def plain_tree(text):
    sections = plain_nodes(text)
    return sha("r" + "".join(s[0] for s in sections)), {x for s in sections for x in s[1]}


def plain_likeness(a, b):
    a, b, shared = plain_nodes(a), plain_nodes(b), 0
    both = {s[0] for s in a} & {s[0] for s in b}
    shared += sum(len(s) for s in {s[0]: s[1] for s in a if s[0] in both}.values())
    a, b = ([p for s in x if s[0] not in both for p in s[2]] for x in (a, b))
    both = {p[0] for p in a} & {p[0] for p in b}
    shared += sum(len(p) for p in {p[0]: p[1] for p in a if p[0] in both}.values())
    a, b = ({x for p in y if p[0] not in both for x in p[1]} for y in (a, b))
    total = 2 * shared + len(a) + len(b)
    return 2 * (shared + len(a & b)) / total if total else 0.0


def test_trees(docs, corpus):
    got = docs.select("doc_id", "n_chars", merkle.tree(F.col("text")).alias("t")).select("doc_id", "n_chars", "t.root", merkle.branches(F.col("t")).alias("b")).collect()
    text = {(i, n): t for i, t, _, _, n in corpus}
    for r in got:
        root, leaves = plain_tree(text[r.doc_id, r.n_chars])
        mine = {x & (2**64 - 1) for s in r.b for p in s.paragraphs for x in p.leaves}
        assert (r.root, mine) == (root, {xxhash.xxh64_intdigest(x, 42) for x in leaves})


def test_leaves_joined_are_the_text():
    for t in ["a b\tc ", "  x", " \t ", "", "word " * 100, "four six hex fix"]:
        assert "".join(plain_leaves(t)) == t and plain_leaves(t) == [m for m in re.findall(merkle.LEAF.replace(r"\x20\x09-\x0D", r"\x20\x09-\x0d"), t) if m]


def both(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    return df.select("i", merkle.branches(merkle.tree(F.col("a"))).alias("a"), merkle.branches(merkle.tree(F.col("b"))).alias("b"))


def test_differing_branches(spark):
    a = "one two\nthree four\n\nfive six\nseven"
    rows = [(a, a, []), (a, a.replace("six", "SIX"), [(1, 0)]), (a, "one two\nthree four", [(1, 0), (1, 1)]), ("", "x", [(0, 0)])]
    got = both(spark, [r[:2] for r in rows]).select("i", merkle.differing(F.col("a"), F.col("b")).alias("d")).collect()
    assert [[(x.section, x.paragraph) for x in r.d] for r in sorted(got)] == [d for *_, d in rows]


def test_likeness(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["for", "all", "the", "box", "red", "in"]) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))
    long = some(400)
    parts = [some(rng.randrange(30)) for _ in range(12)]
    mixed = ["\n\n".join("\n".join(rng.sample(parts, 3)) for _ in range(4)) for _ in range(12)]
    pairs = [(t, t), (t, t[: len(t) // 2] + " z" * 60), (t, "other words"), ("", "x"), ("", ""), (long, "new " + long), *zip(mixed, mixed[1:], strict=False)]
    got = [r[1] for r in sorted(both(spark, pairs).select("i", merkle.likeness(F.col("a"), F.col("b"))).collect())]
    assert np.allclose(got, [plain_likeness(*p) for p in pairs])
    assert got[0] == 1.0 and 0.2 < got[1] < 0.8 and got[2] == got[3] == 0.0 and got[5] > 0.9


def test_next_with_columns_of_any_name_and_far_ids(spark):
    rows = [(i, f"t{i}", 1, 2) for i in range(50)] + [(1 << 60, "far", 1, 2), (-(1 << 60), "low", 1, 2)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "head", "a.b"]).withColumn("to_bucket", F.lit(1)).withColumn("next_text", F.lit("old"))
    got = {r.doc_id: r.next_text for r in merkle.with_next(df, ["text"], bucket_rows=3).collect()}
    ids = sorted(got, reverse=True)
    text = {r[0]: r[1] for r in rows}
    assert got == {i: text[j] for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_next_documents(spark, docs, corpus, empty):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    for bucket_rows in (1, 7, 1000):
        got = merkle.with_next(docs.select("doc_id", "text"), ["doc_id"], bucket_rows=bucket_rows).collect()
        assert len(got) == len(corpus)
        order = sorted({r[0] for r in corpus if r[0] is not None}, reverse=True) + [None]
        after = dict(zip(order, [*order[1:], order[0]], strict=True))
        for r in got:
            assert r.next_doc_id in (after[r.doc_id], r.doc_id)
            assert r.next_doc_id == after[r.doc_id] or sum(x[0] == r.doc_id for x in rows) > 1
    assert merkle.with_next(empty.select("doc_id", "text"), ["text"]).count() == 0
    lone = spark.createDataFrame([(4, "x")], "doc_id long, text string")
    assert merkle.with_next(lone, ["text"]).first().next_text == "x"


def test_query_edits(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(text, reverse=True)
    for r in queries.op6_merkle(spark, sf).collect():
        x, y = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        n = len(x)
        edited = x[: n - n // 2] + y[: n // 2]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha(edited), plain_tree(x)[0], plain_tree(edited)[0])
        assert abs(r.near_edited - plain_likeness(x, edited)) < 1e-9 and abs(r.near_next - plain_likeness(x, y)) < 1e-9
        assert (r.edited_paragraphs > 0) == (x != edited) == (r.first_edit is not None)


def test_wav_round_trip(docs, corpus, empty):
    table = media.write_wav(docs)
    got = media.read_wav(table.select("doc_id", "n_chars", "n_bytes", "media")).collect()
    text = {(i, n): (t or "").encode() for i, t, _, _, n in corpus}
    seen = {}
    for r in got:
        data = text[r.doc_id, r.n_chars]
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == 44 + len(payload)
        assert seen.setdefault(data, (r.media_sha256, r.landmarks)) == (r.media_sha256, r.landmarks)
    assert media.read_wav(media.write_wav(empty)).count() == 0
    assert "lang" in table.columns and "text" not in table.columns


def test_media_with_columns_of_any_name(docs):
    odd = docs.select("*", *[F.lit(7).alias(c) for c in ("payload_bytes", "landmarks", "n_bytes", "a.b", "x`y", "file", "data")])
    out = media.read_wav(media.write_wav(odd))
    assert out.count() == docs.count() and {"a.b", "x`y", "file", "data"} <= set(out.columns) and out.columns.count("landmarks") == 1


def plain_landmarks(samples):
    """Frame by frame: the strongest bin of each band, paired with those of the next three frames (or, alone, with later bands)."""
    x = [float(s) - 128 for s in samples]
    frames = max(1, -(-(len(x) - 256) // 128) + 1)
    x += [0.0] * (256 + 128 * (frames - 1) - len(x))
    peaks = []
    for f in range(frames):
        power = np.abs(np.fft.rfft(np.array(x[128 * f : 128 * f + 256]) * np.hanning(258)[1:-1])) ** 2
        peaks.append([max(range(lo, hi), key=lambda k: power[k]) if max(power[lo:hi]) > 1e-6 else None for lo, hi in media.BANDS])
    if frames == 1:
        p = peaks[0]
        return sorted(p[i] << 16 | p[j] << 8 for i in range(5) for j in range(i + 1, 5) if p[i] and p[j])
    return sorted(t << 24 | peaks[t][b] << 16 | peaks[t + d][b] << 8 | d for t in range(frames) for d in (1, 2, 3) if t + d < frames for b in range(5) if peaks[t][b] and peaks[t + d][b])


def test_landmarks_equal_brute_force():
    rng = np.random.default_rng(12)
    for n in (64, 192, 256, 320, 960, 64 * 33):
        samples = rng.integers(32, 123, n).astype(np.uint8)
        assert media.landmarks(samples).tolist() == plain_landmarks(samples)


def test_stored_bytes_are_a_wav_file():
    with wave.open(io.BytesIO(media.to_wav(media.pad(b"abc")))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, 64) and w.readframes(64) == b"abc" + bytes(61)


def test_the_end_of_every_payload_counts():
    rng = np.random.default_rng(4)
    for n in (64, 256, 320, 384, 448, 64 * 21):
        base = rng.integers(97, 123, n).astype(np.uint8)
        other = base.copy()
        other[-64:] = rng.integers(97, 123, 64)
        assert media.landmarks(base).tolist() != media.landmarks(other).tolist()


def test_one_frame_has_landmarks(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(40, 321, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r.landmarks) for r in media.read_wav(media.write_wav(df)).collect()]
    assert all(got) and len(set(got)) == len(texts)


def test_peaks_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8)
    peaks = media.spectrum_peaks(tone)
    assert (peaks[:, 2] == 32).all()  # 1000 Hz is bin 32 of 256 at 8000 Hz
    marks = media.landmarks(tone)
    assert len(marks) and (np.diff(marks) >= 0).all() and ((marks & 0xFF) <= media.FAN_OUT).all()
