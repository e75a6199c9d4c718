import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import pieces, queries, tokenfile
from graphloom.session import materialize

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    return pieces.encoder(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab theé日▁\n\t!0") + ["  ", "\U0001f600", "ing", "\x00"]), max_size=40))
def test_pieces_equal_the_library(parts):
    text = "".join(parts)
    e = pieces.encoder(PIECES)
    assert e.encode(text) == e.sp.encode(text)


def test_pieces_on_long_and_odd_texts(enc):
    rng = random.Random(2)
    for text in ["", " " * 400, "a" * 3000, "▁" * 40, " x" * 500, "".join(rng.choice("abcdefg hij\n") for _ in range(20000)), "\U0001f469‍\U0001f4bb" * 50]:
        assert enc.encode(text) == enc.sp.encode(text)
        assert enc.decode(enc.encode(text)) == enc.sp.decode(enc.sp.encode(text))


def test_backtracking_gives_what_merging_gives(enc):
    rng = random.Random(4)
    for _ in range(2000):
        seg = "".join(rng.choice("▁theingaorst") for _ in range(rng.randint(1, 14)))
        if seg.startswith("▁▁"):
            continue
        assert [enc.piece[i] for i in enc.backtrack(seg)] == enc.merge(seg)


def test_piece_columns(docs, corpus, enc, empty):
    coded = pieces.encode_column(docs, PIECES)
    back = {(r.doc_id, r.n_chars): r.text for r in pieces.decode_column(coded, PIECES).collect()}
    for i, t, _, _, n in corpus:
        assert back[i, n] == (t or "")
    assert coded.where("size(ids) > 0").count() > 50
    got = {r.doc_id: r for r in pieces.round_trip(docs.select("doc_id", "text"), PIECES).collect()}
    ids = enc.sp.encode(corpus[7][1])
    assert got[7].n_tokens == len(ids) and got[7].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.round_trip(empty.select("doc_id", "text"), PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(lengths):
    ends = np.cumsum(lengths, dtype=np.int64) if lengths else np.empty(0, np.int64)
    low, lows, high, samples = tokenfile.ef_encode(ends, int(ends[-1]) if lengths else 0)
    ef = tokenfile.EliasFano(len(ends), low, lows, high, samples)
    assert ef.all().tolist() == ends.tolist()
    assert [ef.select(i) for i in range(len(ends))] == ends.tolist()
    with pytest.raises(IndexError):
        ef.select(len(ends))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(50, 1500, 10000))
    low, *parts = tokenfile.ef_encode(ends, int(ends[-1]))
    assert sum(map(len, parts)) * 8 / len(ends) < 13  # a plain table takes 64


def test_token_files(spark, docs, corpus, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 500)
    path = str(tmp_path / "ids")
    tokenfile.token_segments(docs, WORDS, end_id=1, parts=3).write.parquet(path)
    got = tokenfile.read_documents(spark.read.parquet(path)).orderBy("start").collect()
    tok = Tokenizer.from_file(WORDS)
    rows = sorted(((i, t or "") for i, t, *_ in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    start = 0
    for r, (_, t) in zip(got, rows, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (start, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("text", ["it's we'll I'D", "a<|endoftext|>b c", "x1y22 z...", "É é ǅ İ ß", "a b\tc\x0bd e", "", "don't\n'tis"])
def test_words_equal_the_library(text):
    e = tokenfile.WordEncoder(WORDS)
    assert e.encode(text).tolist() == e.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab tÉéßñøÿɏʼ²½µª'1.,<|\n\t\x0b\x1c\x85\xa0") + ["'s", "́", "İ", "the ", "Über", "…", "日本"]), max_size=25))
def test_any_text_equals_the_library(parts):
    text = "".join(parts)
    e = tokenfile._encoder(WORDS)
    assert e.encode(text).tolist() == e.tok.encode(text, add_special_tokens=False).ids


def test_one_document_is_found_by_select(spark, docs, corpus):
    from tokenizers import Tokenizer

    rows = tokenfile.token_segments(docs, WORDS, parts=1).collect()
    tok, texts = Tokenizer.from_file(WORDS), {i: t or "" for i, t, *_ in corpus}
    names = tokenfile.doc_ids_of(rows[0].segment)
    assert names[0] is None and names[1:] == sorted(names[1:]) and len(names) == len(corpus)
    for i in (1, 5, 70, len(names) - 1):
        want = [*tok.encode(texts[names[i]], add_special_tokens=False).ids, 1]
        assert tokenfile.read_document(rows[0].segment, i).tolist() == want


def test_doc_ids_of_any_range():
    ids = [np.array([1], np.uint16)] * 6
    for names in ([None, None, -(1 << 63), 0, 0, (1 << 63) - 1], [None] * 6, [-5, -5, 3, 4, 1 << 40, 1 << 62]):
        assert tokenfile.doc_ids_of(tokenfile.write_segment(ids, names)) == names


def test_token_files_empty(spark, empty):
    segments = materialize(tokenfile.token_segments(empty, WORDS, parts=2), "t")
    assert tokenfile.read_documents(segments).count() == 0


def test_wide_ids():
    ids = [np.array([70000, 1], np.uint32), np.array([], np.uint32)]
    bounds, flat = tokenfile.read_segment(tokenfile.write_segment(ids))
    assert bounds.all().tolist() == [2, 2] and flat.tolist() == [70000, 1]


def test_query_columns(spark):
    out = queries.op7_tokenfile(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.agg(F.sum("n_tokens")).first()[0] > 0
