"""Every registered query against the same question in DuckDB."""

import decimal
import math

import pytest

from palimpsest.plans import catalogue

from .conftest import SF


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(columns)
    out = [tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in data]
    return order, sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(catalogue.ORACLES[name])
    assert got == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
