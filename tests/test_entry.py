import duckdb
import pytest

import __spark_entry__ as entry
from oracle import catalog as oracle_catalog
from pulseward.plans import catalog
from tools.check import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"
FAST = [
    "anomaly_signals",
    "anomaly_signals_full",
    "overview_fallback",
    "adapter_normalize",
    "ingest_metrics",
    "json_extract",
    "sql_guard_audit",
    "ticket_topk",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["region", "product_name"]


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracle_catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())
