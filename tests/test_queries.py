import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
CATALOG = [q for q in QUERIES if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        where = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{where}')")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([r[i] for i in order]) for r in records))


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(CATALOG)))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(CATALOG) - set(ORACLES)))
def test_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
