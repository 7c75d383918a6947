"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from corpusloom.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name[:-8]} as select * from read_parquet('{sf}/{name}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(str(tuple(map(show, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracles().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert set(catalog.queries()) <= set(names)
