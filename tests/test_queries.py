"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from postern.plans import catalog
from tools.compare import connect, rows


def test_every_statement_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, sf, name):
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    df = catalog.QUERIES[name](spark, sf)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    r = connect(sf).execute(catalog.SQL[name])
    want, wcols = rows([x[0] for x in r.description], r.fetchall())
    assert cols == wcols and got == want
