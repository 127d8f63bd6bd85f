"""Who is affected by a change: closures over call edges, level by level, and the exact depth-first tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

#: Symbols of a search that the driver holds at most.
FEW = 10_000
_SEEN = "symbol string, depth int"


def impact_closure(edges: DataFrame, symbol: str, depth: int, include_root: bool = True) -> DataFrame:
    """(symbol, depth): callers of a symbol within `depth` steps, all if it is below 0, each at its smallest distance.

    The search ends where a level finds nothing new.

    Each level joins the frontier with the edges and drops duplicates before the next join. Up to FEW symbols are held by
    the driver, so that a level is one job; more are staged in shared storage, so that neither lineage nor repeated work
    grows with the depth. The frontier grows with the graph and is never broadcast by a hint; AQE may do so where it
    measures it as small.
    """
    spark = edges.sparkSession
    callers = edges.select(F.col("to_fqn").alias("symbol"), F.col("from_fqn").alias("caller"))
    known: list[tuple[str, int]] | None = [(symbol, 0)]
    seen = spark.createDataFrame(known, _SEEN)
    frontier = seen.select("symbol")
    for level in count(1) if depth < 0 else range(1, depth + 1):
        found = callers.join(frontier, "symbol").select(F.col("caller").alias("symbol")).distinct().join(seen, "symbol", "left_anti")
        few = [(r["symbol"], level) for r in found.limit(FEW + 1).collect()] if known is not None else []
        if known is not None and len(known) + len(few) <= FEW:
            if not few:
                break
            known += few
            frontier, seen = spark.createDataFrame(few, _SEEN).select("symbol"), spark.createDataFrame(known, _SEEN)
            continue
        known, new = None, staged(found)
        if new.isEmpty():
            break
        seen = seen.unionByName(new.withColumn("depth", F.lit(level)))
        if level % 16 == 0:  # else the plan grows with the depth
            seen = staged(seen)
        frontier = new
    return seen if include_root else seen.where("depth > 0")


def callees_closure(edges: DataFrame, symbol: str, depth: int) -> DataFrame:
    """As impact_closure, along the calls."""
    return impact_closure(edges.select(F.col("to_fqn").alias("from_fqn"), F.col("from_fqn").alias("to_fqn")), symbol, depth)


def callers_of_callers(calls: DataFrame, symbol: str) -> DataFrame:
    """(outer_caller, n): who calls the callers of a symbol, and how often."""
    inner = calls.where(F.col("to_fqn") == symbol).select(F.col("from_fqn").alias("to_fqn"))
    return calls.join(inner, "to_fqn").groupBy(F.col("from_fqn").alias("outer_caller")).agg(F.count("*").alias("n"))


@dataclass
class Tree:
    symbol: str
    depth: int
    direct_callers: int = 0
    total_usages: int = 0
    callers: list[Tree] = field(default_factory=list)

    def rows(self, parent: str | None = None, path: str = "") -> list[tuple]:
        path = f"{path}/{self.symbol}"
        out = [(path, self.depth, self.symbol, parent, self.direct_callers)]
        for child in self.callers:
            out += child.rows(self.symbol, path)
        return out


def _levels(calls: DataFrame, order: list[str], symbol: str, depth: int, width: int, limit: int) -> dict[str, tuple[int, list[str]]]:
    """Number of calls, and the first `limit` callers in order, of what a search can reach: `width` ** `depth` symbols at most."""
    by_callee = Window.partitionBy("to_fqn")
    known: dict[str, tuple[int, list[str]]] = {}
    frontier = {symbol}
    for _ in range(depth + 1):
        asked = calls.sparkSession.createDataFrame([(x,) for x in sorted(frontier)], "to_fqn string")
        mine = calls.join(asked, "to_fqn", "left_semi")  # only these are ranked
        totals = mine.groupBy("to_fqn").agg(F.count("*").alias("total"))
        first = mine.withColumn("nth", F.row_number().over(by_callee.orderBy(*order))).where(F.col("nth") <= limit)
        rows = first.join(totals, "to_fqn").select("to_fqn", "nth", "from_fqn", "total").collect()
        known |= {name: (0, []) for name in frontier}
        for r in sorted(rows, key=lambda r: r["nth"]):
            known[r["to_fqn"]] = r["total"], [*known[r["to_fqn"]][1], r["from_fqn"]]
        frontier = {c for x in frontier for c in known[x][1][:width] if c} - known.keys()
        if not frontier:
            break
    return known


def impact_tree(calls: DataFrame, symbol: str, depth: int = 2, order: list[str] | None = None, width: int = 10, limit: int = 50) -> Tree:
    """The depth-first tree of callers: a symbol is listed once, where the search meets it first.

    `order` settles which callers come first. Levels are fetched by joins; the search then walks the bounded rows with a
    stack of what is still to be listed, so that a symbol met at the last level is not listed again higher up.
    """
    known = _levels(calls, order or ["from_fqn"], symbol, depth, width, limit)
    root = Tree(symbol, 0)
    listed, waiting = set(), [(root, None)]
    while waiting:
        node, parent = waiting.pop()
        if node.symbol in listed:
            continue
        listed.add(node.symbol)
        if parent is not None:
            parent.callers.append(node)
        node.total_usages, callers = known.get(node.symbol, (0, []))
        node.direct_callers = len(callers)
        if node.depth < depth:
            waiting += [(Tree(c, node.depth + 1), node) for c in reversed(callers[:width]) if c and c != node.symbol]
    return root


def impact_rows(calls: DataFrame, symbol: str, depth: int = 2, order: list[str] | None = None, width: int = 10, limit: int = 50) -> DataFrame:
    """impact_tree as flat rows (path, depth, symbol, parent, direct_callers)."""
    tree = impact_tree(calls, symbol, depth, order, width, limit)
    return calls.sparkSession.createDataFrame(tree.rows(), "path string, depth int, symbol string, parent string, direct_callers int")
