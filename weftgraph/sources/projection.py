"""A dependency graph projected from the star-schema tables; the same SELECTs run on any SQL engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import ordinals
from ..schemas import EDGE_ORDER
from ..storage import clustered, exists, scratch_path

NODES_SQL = """
SELECT concat('shop.R', CAST(r_regionkey AS STRING)) AS fqn, 'class' AS type, 'geo' AS package, CAST(NULL AS INT) AS line,
       'public' AS visibility, CAST(NULL AS BOOLEAN) AS has_override, CAST(NULL AS BOOLEAN) AS is_transactional FROM region
UNION ALL SELECT concat('shop.N', CAST(n_nationkey AS STRING)), 'class', 'geo', NULL, 'public', NULL, NULL FROM nation
UNION ALL SELECT concat('shop.S', CAST(s_suppkey AS STRING)), 'class', 'supply', NULL, 'protected', NULL, NULL FROM supplier
UNION ALL SELECT concat('shop.C', CAST(c_custkey AS STRING)), 'class', c_mktsegment, NULL, 'public', NULL, NULL FROM customer
UNION ALL SELECT concat('shop.P', CAST(p_partkey AS STRING), '.use()'), 'method', p_brand, p_size, 'package', false, false FROM part
UNION ALL SELECT concat('shop.C', CAST(o_custkey AS STRING), '.o', CAST(o_orderkey AS STRING), '()'), 'method', c_mktsegment,
       CAST(o_orderkey % 500 AS INT), CASE WHEN o_orderkey % 3 = 0 THEN 'public' WHEN o_orderkey % 3 = 1 THEN 'private' ELSE 'package' END,
       o_orderstatus = 'F', o_totalprice > 200000 FROM orders JOIN customer ON o_custkey = c_custkey"""

EDGES_SQL = """
SELECT concat('shop.N', CAST(n_nationkey AS STRING)) AS from_fqn, 'inheritance' AS edge_type, concat('shop.R', CAST(n_regionkey AS STRING)) AS to_fqn,
       'extends' AS kind, 'geo' AS from_package, 'geo' AS to_package, CAST(NULL AS INT) AS from_line FROM nation
UNION ALL SELECT concat('shop.S', CAST(s_suppkey AS STRING)), 'inheritance', concat('shop.N', CAST(s_nationkey AS STRING)), 'implements', 'supply', 'geo', NULL FROM supplier
UNION ALL SELECT concat('shop.C', CAST(c_custkey AS STRING)), 'inheritance', concat('shop.N', CAST(c_nationkey AS STRING)), 'implements', c_mktsegment, 'geo', NULL FROM customer
UNION ALL SELECT concat('shop.C', CAST(o_custkey AS STRING), '.o', CAST(o_orderkey AS STRING), '()'), 'member_of', concat('shop.C', CAST(o_custkey AS STRING)), 'method', c_mktsegment, c_mktsegment, NULL FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('shop.S', CAST(l_suppkey AS STRING)), 'member_of', concat('shop.C', CAST(o_custkey AS STRING), '.o', CAST(o_orderkey AS STRING), '()'), 'argument', 'supply', c_mktsegment, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('shop.C', CAST(o_custkey AS STRING), '.o', CAST(o_orderkey AS STRING), '()'), 'call', concat('shop.P', CAST(l_partkey AS STRING), '.use()'), 'standard', c_mktsegment, p_brand, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
UNION ALL SELECT concat('shop.C', CAST(c_custkey AS STRING)), 'call', concat('shop.C', CAST(o_custkey AS STRING), '.o', CAST(o_orderkey AS STRING), '()'), 'new', c_mktsegment, c_mktsegment, CAST(o_orderkey % 500 AS INT) FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('shop.N', CAST(c_nationkey AS STRING)), 'call', concat('shop.C', CAST(c_custkey AS STRING)), 'standard', 'geo', c_mktsegment, 1 FROM customer
UNION ALL SELECT concat('shop.R', CAST(n_regionkey AS STRING)), 'call', concat('shop.N', CAST(n_nationkey AS STRING)), 'standard', 'geo', 'geo', 1 FROM nation"""

EVENT_EDGES_SQL = """
SELECT from_fqn, to_fqn FROM (
  SELECT concat('u', CAST(user_id AS STRING)) AS from_fqn, concat('u', CAST(lead(user_id) OVER (ORDER BY event_id) AS STRING)) AS to_fqn,
         lead(user_id) OVER (ORDER BY event_id) AS nxt FROM events) t
WHERE nxt IS NOT NULL"""

#: Usages: calls with the file of the caller, and a declaration of each node.
USAGES_SQL = """
SELECT 'java' AS source, 'java_method_call' AS usage_type,
       concat('file:///src/', from_package, CASE WHEN mark LIKE 'o%' AND CAST(substr(mark, 2) AS BIGINT) % 7 = 0 THEN '/src-gen/' ELSE '/' END, from_fqn, '.java') AS caller_uri,
       from_line AS caller_line, from_fqn AS caller_symbol, to_fqn AS callee_symbol, from_package AS module,
       CASE WHEN from_line % 5 = 0 THEN 'none' ELSE 'mini' END AS embedding_model_name, CASE WHEN from_line % 3 = 0 THEN 'v1' WHEN from_line % 3 = 1 THEN 'v2' END AS document_strategy_version
FROM (SELECT e.*, CASE WHEN from_fqn LIKE '%.o%()' THEN replace(substr(from_fqn, instr(from_fqn, '.o') + 1), '()', '') ELSE '' END AS mark FROM edges e WHERE edge_type = 'call') c
UNION ALL SELECT 'java', 'java_declaration', concat('file:///src/', package, '/', fqn, '.java'), line, CAST(NULL AS STRING), fqn, package, 'mini', 'v2' FROM nodes"""

SYMBOLS_SQL = """
SELECT fqn, concat('file:///src/', package, '/', fqn, '.java') AS uri, package, concat(replace(fqn, '.', '/'), '.class') AS relative_uri,
       type = 'class' AND package <> 'geo' AS is_entity, line FROM nodes WHERE visibility <> 'private'"""

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def oracle(sql: str) -> str:
    """A query over nodes, edges, event_edges, usages and symbol_index as one that reads the base tables only."""
    needed, defined = [], [("nodes", NODES_SQL), ("edges", EDGES_SQL), ("event_edges", EVENT_EDGES_SQL), ("usages", USAGES_SQL), ("symbol_index", SYMBOLS_SQL)]
    used = sql
    for name, body in reversed(defined):
        if re.search(rf"\b{name}\b", used):
            needed.insert(0, f"{name} AS ({body})")
            used += body
    if not needed:
        return sql
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    rest = re.sub(r"^\s*WITH( RECURSIVE)?", ",", sql) if re.match(r"\s*WITH", sql) else "\n" + sql
    return head + ",\n".join(needed) + rest


#: How the projected tables are stored: partition columns, and the order of rows.
CLUSTERS = {"nodes": (["package"], ["fqn"]), "edges": (["edge_type"], EDGE_ORDER[2:3] + EDGE_ORDER[:1]), "usages": (["usage_type"], ["callee_symbol", "caller_symbol"]), "symbols": (["package"], ["fqn"])}
_STORED: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


class Graph:
    """The projected tables of a folder. Each is stored on first use, clustered as the engine's are, and read from there."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, sql: str, **frames: DataFrame) -> DataFrame:
        frames = {n: self.table(n) for n in BASE if re.search(rf"\b{n}\b", sql)} | frames
        for name in frames:
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
        return self.spark.sql(sql, **frames)

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED or not exists(self.spark, _STORED[key][0]):
            made, path = make(), f"{scratch_path(self.spark, 'graph')}/{name}"
            clustered(made, path, *CLUSTERS[name])
            _STORED[key] = path, self.spark.read.schema(made.schema).parquet(path).select(*made.columns)
        return _STORED[key][1]

    def store(self) -> None:
        """Stores all tables."""
        for name in CLUSTERS:
            getattr(self, name)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._stored("nodes", lambda: self._sql(NODES_SQL))

    @cached_property
    def edges(self) -> DataFrame:
        return self._stored("edges", lambda: self._sql(EDGES_SQL))

    @cached_property
    def calls(self) -> DataFrame:
        return self.edges.where("edge_type = 'call'")

    @cached_property
    def event_edges(self) -> DataFrame:
        """An event's user calls the next one's: rows are numbered and joined, so that no task holds them all."""
        events = ordinals(self.table("events").select("event_id", "user_id"), ["event_id"], "n")
        one = events.select("n", F.concat(F.lit("u"), "user_id").alias("from_fqn"))
        return one.join(events.select((F.col("n") - 1).alias("n"), F.concat(F.lit("u"), "user_id").alias("to_fqn")), "n").select("from_fqn", "to_fqn").where("to_fqn is not null")

    @cached_property
    def usages(self) -> DataFrame:
        return self._stored("usages", lambda: self._sql(USAGES_SQL, edges=self.edges, nodes=self.nodes))

    @cached_property
    def symbols(self) -> DataFrame:
        return self._stored("symbols", lambda: self._sql(SYMBOLS_SQL, nodes=self.nodes))


__all__ = ["EDGE_ORDER", "Graph", "oracle"]
