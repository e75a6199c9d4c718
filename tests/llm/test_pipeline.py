import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from graphloom.llm import queries, toxicity  # noqa: E402
from tests.llm.test_repeats import plain_bytes  # noqa: E402
from tests.llm.test_simhash import components, plain_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, each stage fed with the Parquet of the one before."""
    home, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out.append([tuple(r[c] for c in P.COLUMNS) for r in docs.collect()])
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(home / name))
        docs = spark.read.parquet(str(home / name))
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_columns(stages):
    assert all(len(r) == 5 for rows in stages[:5] for r in rows)
    assert [n for n, _ in P.STAGES][1] == "simhash_near_dedup" and P.ORACLE_SQL is None


def test_toxic_documents_go(spark, stages):
    model = queries.toxicity_model(spark, SF)
    assert isinstance(model, toxicity.Model)
    assert Counter(stages[1]) == Counter(r for r in stages[0] if model(r[1]) < queries.TOXIC)
    assert 0.9 * len(stages[0]) < len(stages[1]) < len(stages[0])


def test_one_of_each_near_copy_stays(stages):
    rows = sorted(stages[1])
    comp = components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows], 4)
    assert sorted(stages[2]) == [r for r, c in zip(rows, comp, strict=True) if r[0] == c]


def test_copies_without_an_id_go(spark):
    far = [" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "sea", "oak", "ink")]
    rows = [(None, far[0])] * 30 + [(None, far[1])] * 2 + [(4, far[1]), (6, far[1]), (None, far[2]), (5, far[3]), (5, far[2]), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.drop_near_copies(spark, df, SF).collect()
    # Rows of one id with unrelated texts are two documents; of two empty texts without an id one stays.
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, ""), (0, far[0]), (4, far[1]), (5, far[2]), (5, far[3])])


def test_all_stages_on_nulls_repeated_ids_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    far = [" ".join(f"{w}{i}" for i in range(90)) for w in ("red", "sea", "oak")]
    rows = [(None, far[0], "en", None, None)] * 3 + [(7, far[1], "en", "a", 1), (7, far[2], None, "a", 2), (8, None, "en", "b", 0), (9, "", "en", "b", 0), (None, None, None, None, None), (11, "\ufffd kept", "en", "b", 6)]
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, some, kept in (("rows", rows, {far[0], far[1], far[2], "\ufffd kept"}), ("none", [], set())):
        docs = spark.createDataFrame(some, schema)
        for i, (step, f) in enumerate(P.STAGES):
            f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            if i in (1, 2):
                assert Counter(r.text for r in docs.collect() if r.text) == Counter(kept), step
        assert (docs.count() > 0) == bool(some) and docs.columns[-1] == "round_trip"


def test_a_stage_deletes_only_what_the_stage_before_left(spark, tmp_path):
    from graphloom.session import materialize

    mine = materialize(spark.range(5), "mine")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _ in range(2):
        P.drop_near_copies(spark, docs, SF)
    assert mine.count() == 5


def test_repeats_go(stages):
    want = {i: kept.decode(errors="ignore") for i, _, _, _, kept in plain_bytes([(r[0], r[1]) for r in stages[2]], 400)}
    assert {r[0]: r[1] for r in stages[3]} == want and all(r[4] == len(r[1]) for r in stages[3])


def test_mix_repeats_documents(stages):
    have, took = {r[0]: r for r in stages[3]}, Counter(r[0] for r in stages[4])
    assert max(took.values()) <= 2 and all(have[r[0]] == r for r in stages[4])
    words = lambda r: len(r[1].split())
    size, taken = defaultdict(int), defaultdict(int)
    for r in stages[3]:
        size[r[3]] += words(r)
        taken[r[3]] += words(r) * took[r[0]]
    assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.03


def test_ids_equal_the_library(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r[0]: r[1] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for doc_id, _, _, n, ids, same in stages[5]:
        assert ids == sp.encode(text[doc_id]) and n == len(ids) and same == (sp.decode(ids) == text[doc_id])


def test_run_gives_the_last_stage(spark, stages):
    got = P.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], r[3]) for r in stages[5])
