"""Class queries over parts whose keys are longer than the names that the SQL cuts at six digits."""

import duckdb
import pytest
from compiled import M
from pyspark.sql import functions as F
from test_catalog import rows

from weftgraph import catalog
from weftgraph.sources import class_files

#: Twelve keys share a name, two of them with a brand.
KEYS = [(7, "Brand#1"), (100000, "Brand#2"), (1000000, "Brand#2"), *((1000000 + i, f"Brand#{i % 4}") for i in range(1, 10)), (10000012, "Brand#9")]


@pytest.mark.parametrize("name", ["x3_indexed_symbols", "k3_class_edges", "k1_class_usages", "k2_ingested_nodes"])
def test_parts_of_one_name_keep_their_own_rows(spark, tmp_path, name):
    spark.createDataFrame(KEYS, "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(db.execute(catalog.ORACLE_SQL[name]).fetchdf())


def test_usages_point_into_their_own_package(spark):
    files = spark.createDataFrame([("q", "/a/db/M.class", M), ("p", "/a/db/M.class", M)], "package string, path string, content binary")
    trees = class_files.class_trees(files)
    symbols = class_files.tree_symbols(trees, F.col("package")).withColumn("uri", F.concat("package", F.lit(":"), "fqn"))
    found = class_files.tree_usages(trees, symbols).where("callee_uri is not null").select("usage_type", "owner", "caller_uri", "callee_uri").collect()
    assert len(found) == 12  # of each package a class, three methods, and two calls of its own
    assert all(r["caller_uri"] == f"{r['owner']}:a.db.M" and r["callee_uri"].startswith(f"{r['owner']}:") for r in found)
