import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted([tuple(norm(r[i]) for i in order) for r in values], key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["chunks", "entities_merged", "modularity", "winrate_matrix", "elo_ratings", "strict_f1", "report_context", "extract_parse", "parameter_grid", "unit_previews", "best_split", "question_fan_out", "adapted_components", "late_detector", "entity_aliases"])
def test_queries_equal_their_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = con.execute(entry.oracle_sql()[name])
    want = got.fetchall()
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], want)


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
