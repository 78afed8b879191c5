"""Every registered query of the core library against its SQL, on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from breakweave import queries as own

SF = "/root/testdata/sf0.001"
own.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in own.ORACLES:  # its operator has cases of its own
        assert rows and name in {"m11_negative_binomial", "m12", "m1_likelihood", "m9_likelihood"}
        return
    found = duck.execute(own.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
