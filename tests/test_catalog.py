"""Every registered graph query against its SQL in DuckDB, over the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from weftgraph import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, numbers.Number) and not isinstance(value, bool):
        return repr(round(float(value), 6))  # nullable integers come as floats from one side
    return str(value.tolist() if hasattr(value, "tolist") else value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    ours = catalog.QUERIES[name](spark, DATA).toPandas()
    theirs = oracle.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_all_but_the_tree_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"g6_impact_tree"}


def test_cyclic_closure_meets_its_end(spark):
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    found = {r["symbol"]: r["depth"] for r in catalog.QUERIES["g6_impact_closure_cyclic_whole"](spark, sf_dir).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    assert max(found.values()) > 2  # a search of two levels ends before
    assert found == dict(db.execute(catalog.ORACLE_SQL["g6_impact_closure_cyclic_whole"]).fetchall())
