"""Every query against the oracle's SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.sources.tables import TABLES


def shown(x):
    return "null" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_oracle(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [r.asDict() for r in got.collect()]
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_every_core_query_has_sql():
    from sparkloom import queries

    assert set(queries.QUERIES) == set(queries.ORACLE)


@pytest.mark.parametrize("name", ["ssi_pivots", "write_skew", "lost_update", "phantom", "wal_undo", "lsm_compaction_pick", "overlap_join", "lock_waits"])
def test_results_are_not_empty(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["n_name", "revenue", "cnt"]
