import duckdb
import pytest

import __spark_entry__ as entry
from headloom.queries import analysis, archives, generated, generated_notes, worker_logs
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


QUERIES, SQL = (analysis.queries() | generated.queries() | archives.queries() | generated_notes.queries() | worker_logs.queries()), (analysis.oracle_sql() | generated.oracle_sql() | archives.oracle_sql() | generated_notes.oracle_sql() | worker_logs.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    key = lambda rows: sorted([tuple(plain(v) for v in r) for r in rows], key=str)
    assert key(got.select(*[f"`{n}`" for n in names]).collect()) == key(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
