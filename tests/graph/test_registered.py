"""Every registered graph query against its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pytest

from kairograph.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted([tuple("none" if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in found], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    twin = sql.execute(queries.ORACLES[name])
    places = [[c[0] for c in twin.description].index(c) for c in columns]
    assert rows(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect())) == rows(tuple(r[i] for i in places) for r in twin.fetchall())


def test_estimates_stay_in_their_band(spark):
    errors = queries.kri_validation(spark, SF).toPandas()["error"]
    assert errors.mean() < 0.065 and errors.max() < 0.3
