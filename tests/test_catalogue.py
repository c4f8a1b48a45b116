"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math

import duckdb
import pytest

from framelake.plans import advice, catalogue, colours, files, layers, measures, rasters, shoots, streams, tracks  # noqa: F401

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(([clean(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    found = duck.sql(catalogue.SQL[name])
    at = found.columns
    assert sorted(at) == columns
    assert got == sorted(([clean(r[at.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
