"""Every registered query that has SQL, side by side with DuckDB."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from cadenza.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v or 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    wanted = Counter(tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == wanted


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
