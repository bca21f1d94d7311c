"""Every query with SQL gives DuckDB's rows; the others run and return rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from pelagia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name, and rows in one order with NaN as None."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    key = lambda r: tuple((v is None, str(type(v)) if isinstance(v, str) else "", 0 if v is None else v) for v in r)
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=key)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_the_oracle(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLES[name])
    assert normal(got.columns, got.collect()) == normal(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_return_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
