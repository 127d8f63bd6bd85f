"""Schemas, as DDL, of the tables that the engine reads and writes."""

from __future__ import annotations

SYMBOLS = "fqn string, uri string, package string, relative_uri string, is_entity boolean, line int"
INDEX_METADATA = "package string, content_hash string, package_order int, indexed_at timestamp"
#: Classes of a package that come from another one.
OVERRIDDEN = "relative_uri string, package string, by_package string"
NODES = "fqn string, type string, package string, line int, visibility string, has_override boolean, is_transactional boolean"
EDGES = "from_fqn string, edge_type string, to_fqn string, kind string, from_package string, to_package string, from_line int"
USAGES = (
    "source string, usage_type string, caller_uri string, caller_line int, caller_symbol string, caller_kind string, callee_uri string,"
    " callee_symbol string, callee_line int, callee_kind string, module string, string_context string, context map<string,string>"
)
CLASS_TREE = (
    "fqn string, node_type string, modifiers array<string>, is_entity boolean, line_number int,"
    " inheritance array<struct<fqn: string, kind: string>>,"
    " fields array<struct<type: string>>,"
    " methods array<struct<fqn: string, line_number: int, modifiers: array<string>, has_override: boolean, is_transactional: boolean,"
    " return_type: string, arguments: array<string>, calls: array<struct<to_fqn: string, kind: string, line_number: int>>>>"
)
#: Order of edges and usages, by which limits and ordinals are settled; equal rows are interchangeable.
EDGE_ORDER = ["from_fqn", "edge_type", "to_fqn", "kind", "from_package", "to_package", "from_line"]
USAGE_ORDER = ["caller_symbol", "callee_symbol", "caller_line", "usage_type", "module", "caller_uri"]
#: Line of a member whose byte code has no line table.
NO_LINE = -1
