"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tidewatch.plans import catalog, oracles

QUERIES, SQL = catalog.QUERIES, oracles.all_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = engine.execute(SQL[name])
    position = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(position) == columns
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    found = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    expected = sorted(repr([plain(r[position[c]]) for c in columns]) for r in result.fetchall())
    assert found == expected


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_partition_info_reports_sizes(spark):
    from tidewatch.operators import maintain
    info = maintain.partition_info(spark, catalog._write_months(catalog.Data(spark, SMALL))).collect()
    assert sum(r.table_rows for r in info if r.table_name == "dns_queries") == 1000
    assert all(r.total_mb == r.data_mb and r.update_time for r in info)
