"""Every registered query with SQL gives what DuckDB gives on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" or str(v) == "<NA>" else round(float(v), 6) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf, duck):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    if name == "op2_warc":
        got["refers_to"], want["refers_to"] = got["refers_to"].astype("Int64"), want["refers_to"].astype("Int64")
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
