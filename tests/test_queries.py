"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from envsense.plans.oracle import oracle_sql
from envsense.plans.queries import queries
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    same = lambda v: round(float(v), 4) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted(repr([same(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(oracle_sql()[name])
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*columns).collect()) == plain(duck.sql(f"SELECT {listed} FROM ({oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_without_sql(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())
