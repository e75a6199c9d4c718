import pytest
from pyspark.sql import functions as F

from graphloom.functions import schemas, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 72, 73, 200])
def test_chunks(spark, n):
    t = "".join(chr(97 + i % 26) for i in range(n))
    want, at = [], 0  # windows of 10 tokens, 2 shared
    while n:
        want.append(t[at : at + 40])
        if at + 40 >= n:
            break
        at += 32
    assert one(spark, t, lambda c: text.chunk_array(c, 10, 2)) == want


def test_chunks_without_progress_advance_by_their_width(spark):
    assert one(spark, "a" * 100, lambda c: text.chunk_array(c, 10, 10)) == ["a" * 40, "a" * 40, "a" * 20]
    with pytest.raises(ValueError):
        text.fixed_step_chunks(F.lit("x"), 5, 5)


def test_fixed_step_may_end_inside_the_overlap(spark):
    got = one(spark, "x" * 70, lambda c: text.fixed_step_chunks(c, 10, 2))
    assert [len(g) for g in got] == [40, 38, 6]
    assert one(spark, "x" * 43, lambda c: text.fixed_step_chunks(c, 10, 2)) == ["x" * 43]


@pytest.mark.parametrize(("raw", "want"), [(" The  Cat .", "cat"), ("'quoted'", "quoted"), ("a dog", "dog"), ("another", "another"), ("", ""), ("THE", "the"), ("an  x.", "x")])
def test_entities_are_normalised(spark, raw, want):
    assert one(spark, raw, text.normalize_entity) == want


def test_extraction_records(spark):
    r = '("entity"<|>A<|>T<|>first (one))##\n("relationship"<|>A<|>B<|>d<|>2.5)##("entity"<|>C<|>T)\nnoise'
    loose = one(spark, r, text.extraction_records)
    assert [(x.kind, x.a, x.description, x.weight) for x in loose] == [("entity", "A", "first (one", None), ("relationship", "A", "d", 2.5)]
    strict = one(spark, r, lambda c: text.extraction_records(c, record=None))
    assert [x.weight for x in strict if x.kind == "relationship"] == [1.0]  # the record mark defeats the number


def test_constructors_are_read_not_run(spark):
    got = one(spark, "extract = Extract([Triple(drug('x'), Adverse_Effect(), adverse_effect('y')), __import__('os').system('true')])", text.constructor_triples)
    assert [(g.head, g.relation, g.tail) for g in got] == [("x", "Adverse_Effect", "y")]
    assert one(spark, "nothing", text.constructor_triples) == []


@pytest.mark.parametrize(("t", "want"), [("short", "short"), ("a" * 9 + "." + "b" * 5, "aaaaaaaaa."), ("a." + "b" * 20, "a." + "b" * 8 + "...")])
def test_truncation(spark, t, want):
    assert one(spark, t, lambda c: text.truncate_answer(c, 10)) == want


def test_answers_verdicts_and_ids(spark):
    assert [one(spark, t, text.valid_answer) for t in ("fine", "", None, "It FAILED", "null")] == [True, False, False, False, False]
    assert [one(spark, t, text.clean_verdict) for t in (" a ", "tie", "x", None)] == ["A", "TIE", "TIE", "TIE"]
    assert [one(spark, t, lambda c: text.to_int_id(c, F.lit(9))) for t in ("7", "community_0_7", "none", None)] == [7, 0, 9, 9]


def test_report_parsing(spark):
    r = one(spark, '{"title": "T", "summary": "S", "rating": "bad", "findings": []}', text.report_struct)
    assert (r.title, r.rating) == ("T", 0.0) and r.full_content.startswith("# T\n\n**Summary:** S")
    r = one(spark, "## x\n# Head\nfirst\nsecond", text.report_struct)
    assert (r.title, r.summary) == ("Head", "first")


def test_conform(spark):
    df = spark.createDataFrame([("b", None, "x"), ("a", 5, "3")], "title string, human_readable_id int, frequency string")
    got = schemas.conform_entities(df, ["title"]).orderBy("title").collect()
    assert [(r.title, r.human_readable_id, r.frequency, r.type, r.text_unit_ids) for r in got] == [("a", 5, 3, "UNKNOWN", []), ("b", 0, 1, "UNKNOWN", [])]
    assert len({r.id for r in got}) == 2
