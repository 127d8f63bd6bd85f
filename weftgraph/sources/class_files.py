"""Compiled classes: a reader of the class file format, and table functions from files to class trees.

A class tree holds what one file says about its class: parents, field types, and methods with modifiers, argument and
return types, and the calls in their code. Arguments are part of a method's name; a return type is not. Calls through
invokedynamic are left out, and a call of a constructor on a new object is of kind `new`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..schemas import CLASS_TREE, NO_LINE

# Sizes of constant pool entries by tag; 5 and 6 take two places.
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
# Operand bytes by opcode; what is not listed has none. 170, 171 and 196 vary.
_OPERANDS = {
    **dict.fromkeys([16, 18, *range(21, 26), *range(54, 59), 169, 188], 1),
    **dict.fromkeys([17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199], 2),
    197: 3,
    **dict.fromkeys([185, 186, 200, 201], 4),
}
# The format's letters of primitive types, and its opcodes of calls.
_PRIMITIVE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
INVOKE = {182: "standard", 183: "special", 184: "standard", 185: "standard"}
# Annotations that are recorded, and superclass and package by which entities are known.
TRANSACTIONAL, OVERRIDE = "Transactional", "Override"
ENTITY_BASE, ENTITY_PACKAGE, ENTITY_ROOT = "AuditableModel", ".db.", "com.axelor.db.Model"


def types_of(descriptor: str) -> list[str]:
    """The types of a descriptor in order; of a method's the last is the return type."""
    out, at = [], 0
    while at < len(descriptor):
        dims = 0
        while descriptor[at] == "[":
            dims, at = dims + 1, at + 1
        if descriptor[at] in "()":
            at += 1
            continue
        if descriptor[at] == "L":
            end = descriptor.index(";", at)
            name, at = descriptor[at + 1 : end].replace("/", "."), end + 1
        else:
            name, at = _PRIMITIVE[descriptor[at]], at + 1
        out.append(name + "[]" * dims)
    return out


def method_name(owner: str, name: str, descriptor: str) -> str:
    return f"{owner}.{name}({', '.join(types_of(descriptor)[:-1])})"


def is_symbol(name: str) -> bool:
    return name not in fn.PRIMITIVES and not name.startswith("java.lang.")


def modifiers(flags: int) -> list[str]:
    return [name for bit, name in fn.ACCESS if flags & bit]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str):
        value = struct.unpack_from(">" + kind, self.data, self.at)
        self.at += struct.calcsize(">" + kind)
        return value if len(value) > 1 else value[0]

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def _pool(r: _Reader) -> dict[int, tuple]:
    pool, i, count = {}, 1, r.take("H")
    while i < count:
        tag = r.take("B")
        if tag == 1:
            pool[i] = (1, r.bytes(r.take("H")).decode("utf-8", "replace"))
        else:
            raw = r.bytes(_SIZES[tag])
            pool[i] = (tag, *(struct.unpack(">HH", raw) if tag in (9, 10, 11, 12, 17, 18) else struct.unpack(">H", raw) if tag in (7, 8, 16, 19, 20) else ()))
        i += 2 if tag in (5, 6) else 1
    return pool


def _attributes(r: _Reader, pool: dict) -> dict[str, bytes]:
    return {pool[r.take("H")][1]: r.bytes(r.take("I")) for _ in range(r.take("H"))}


def _annotations(attributes: dict[str, bytes], pool: dict) -> list[str]:
    """Simple names of the annotations that are kept at run time."""
    out = []

    def value(r: _Reader) -> None:
        kind = chr(r.take("B"))
        if kind == "@":
            annotation(r)
        elif kind == "[":
            for _ in range(r.take("H")):
                value(r)
        else:
            r.bytes(4 if kind == "e" else 2)

    def annotation(r: _Reader) -> str:
        name = types_of(pool[r.take("H")][1])[0]
        for _ in range(r.take("H")):
            r.bytes(2)
            value(r)
        return name

    if found := attributes.get("RuntimeVisibleAnnotations"):
        r = _Reader(found)
        out = [annotation(r).rpartition(".")[2].rpartition("$")[2] for _ in range(r.take("H"))]
    return out


def _calls(code: bytes, pool: dict) -> tuple[list[dict], int]:
    """Calls in order of the code, and the line of its first instruction."""
    r = _Reader(code)
    r.bytes(4)
    body = r.bytes(r.take("I"))
    r.bytes(8 * r.take("H"))
    lines: list[tuple[int, int]] = []
    if table := _attributes(r, pool).get("LineNumberTable"):
        lines = sorted(struct.iter_unpack(">HH", table[2:]))
    found, at, line = [], 0, 0
    ordered = iter([*lines, (len(body) + 1, 0)])
    begin, number = next(ordered)
    while at < len(body):
        while begin <= at:
            line = number
            begin, number = next(ordered)
        op = body[at]
        if op in INVOKE:
            owner, name, descriptor = _member(pool, struct.unpack_from(">H", body, at + 1)[0])
            kind = "new" if op == 183 and name == "<init>" else "standard"
            found.append({"to_fqn": method_name(owner, name, descriptor), "kind": kind, "line_number": line if lines else NO_LINE})
        if op in (170, 171):
            pad = at + 4 - at % 4
            if op == 170:
                low, high = struct.unpack_from(">ii", body, pad + 4)
                at = pad + 12 + 4 * (high - low + 1)
            else:
                at = pad + 8 + 8 * struct.unpack_from(">i", body, pad + 4)[0]
        elif op == 196:
            at += 6 if body[at + 1] == 132 else 4
        else:
            at += 1 + _OPERANDS.get(op, 0)
    return found, lines[0][1] if lines else NO_LINE


def _member(pool: dict, i: int) -> tuple[str, str, str]:
    _, owner, both = pool[i]
    _, name, descriptor = pool[both]
    return pool[pool[owner][1]][1].replace("/", "."), pool[name][1], pool[descriptor][1]


def class_tree(data: bytes, domains: list[str] | None = None) -> dict | None:
    """The class tree of a file, or null if it can't be read or is outside the domains. Calls and types are kept inside the domains."""
    try:
        return _tree(_Reader(data), domains or [])
    except (struct.error, KeyError, IndexError, ValueError, StopIteration):
        return None


def _tree(r: _Reader, domains: list[str]) -> dict | None:
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("no class file")
    r.bytes(4)
    pool = _pool(r)

    def inside(name: str) -> bool:
        return not domains or name.startswith(tuple(domains))

    def named(i: int) -> str:
        return pool[pool[i][1]][1].replace("/", ".")

    flags, this, parent = r.take("HHH")
    name = named(this)
    if not inside(name):
        return None
    above = [(named(parent), "extends")] if parent and named(parent) != "java.lang.Object" else []
    above += [(named(r.take("H")), "implements") for _ in range(r.take("H"))]
    fields, methods = [], []
    for _ in range(r.take("H")):
        _, _, descriptor = r.take("HHH")
        _attributes(r, pool)
        if is_symbol(kind := types_of(pool[descriptor][1])[0]) and inside(kind):
            fields.append({"type": kind})
    for _ in range(r.take("H")):
        access, called, descriptor = r.take("HHH")
        attributes = _attributes(r, pool)
        calls, line = _calls(attributes["Code"], pool) if "Code" in attributes else ([], NO_LINE)
        *arguments, result = types_of(pool[descriptor][1])
        notes = _annotations(attributes, pool)
        methods.append({
            "fqn": method_name(name, pool[called][1], pool[descriptor][1]),
            "line_number": line,
            "modifiers": modifiers(access),
            "has_override": OVERRIDE in notes,
            "is_transactional": TRANSACTIONAL in notes,
            "return_type": result if is_symbol(result) and inside(result) else None,
            "arguments": [a for a in arguments if is_symbol(a) and inside(a)],
            "calls": [c for c in calls if inside(c["to_fqn"])],
        })
    entity = any(ENTITY_BASE in p for p, how in above if how == "extends") or (ENTITY_PACKAGE in name and name != ENTITY_ROOT)
    kind = "enum" if flags & 0x4000 else "interface" if flags & 0x0200 else "class"
    return {
        "fqn": name, "node_type": kind, "modifiers": modifiers(flags), "is_entity": entity, "line_number": None,
        "inheritance": [{"fqn": p, "kind": how} for p, how in above if inside(p)], "fields": fields, "methods": methods,
    }


def class_trees(files: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Class trees of files (path, content), one row for each that can be read, with its package if files have one.

    Files of several packages may have the same path.
    """
    own = [c for c in ("path", "package") if c in files.columns]
    schema = pa.schema([*[(c, pa.string()) for c in own], *ARROW_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [class_tree(c or b"", domains) for c in batch.column("content").to_pylist()]
            rows = zip(*[batch.column(c).to_pylist() for c in own], trees, strict=True)
            yield pa.RecordBatch.from_pylist([dict(zip(own, x, strict=True)) | t for *x, t in rows if t], schema=schema)

    return files.select(*own, "content").mapInArrow(run, f"{', '.join(f'{c} string' for c in own)}, {CLASS_TREE}")


_CALL = pa.struct([("to_fqn", pa.string()), ("kind", pa.string()), ("line_number", pa.int32())])
_METHOD = pa.struct([
    ("fqn", pa.string()), ("line_number", pa.int32()), ("modifiers", pa.list_(pa.string())), ("has_override", pa.bool_()), ("is_transactional", pa.bool_()),
    ("return_type", pa.string()), ("arguments", pa.list_(pa.string())), ("calls", pa.list_(_CALL)),
])
ARROW_TREE = pa.schema([
    ("fqn", pa.string()), ("node_type", pa.string()), ("modifiers", pa.list_(pa.string())), ("is_entity", pa.bool_()), ("line_number", pa.int32()),
    ("inheritance", pa.list_(pa.struct([("fqn", pa.string()), ("kind", pa.string())]))), ("fields", pa.list_(pa.struct([("type", pa.string())]))), ("methods", pa.list_(_METHOD)),
])


def without_enums(trees: DataFrame) -> DataFrame:
    """Enums are not indexed, and so neither analysed nor linked to."""
    return trees.where("node_type <> 'enum'")


def with_relative_uri(trees: DataFrame) -> DataFrame:
    return trees.withColumn("relative_uri", fn.relative_path(F.col("fqn"), ".class"))


def tree_symbols(trees: DataFrame, package: Column) -> DataFrame:
    """Symbols of classes and methods."""
    trees = with_relative_uri(without_enums(trees).withColumn("package", package))
    classes = trees.select("fqn", "package", "relative_uri", "is_entity", F.col("line_number").alias("line"))
    methods = trees.select("package", "relative_uri", "is_entity", F.explode("methods").alias("m")).select("m.fqn", "package", "relative_uri", "is_entity", F.col("m.line_number").alias("line"))
    both = classes.unionByName(methods)
    return both.withColumn("uri", fn.file_uri(F.col("relative_uri"), F.col("line"))).select("fqn", "uri", "package", "relative_uri", "is_entity", "line")


def tree_nodes(trees: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of what is indexed: classes without, methods with the properties of their byte code."""
    none = F.lit(None).cast("boolean")
    classes = trees.select("fqn", F.lit("class").alias("type"), F.lit(None).cast("int").alias("line"), fn.visibility(F.col("modifiers")).alias("visibility"), none.alias("has_override"), none.alias("is_transactional"))
    methods = trees.select(F.explode("methods").alias("m")).select("m.fqn", F.lit("method").alias("type"), F.col("m.line_number").alias("line"), fn.visibility(F.col("m.modifiers")).alias("visibility"), "m.has_override", "m.is_transactional")
    known = symbols.select("fqn", "package").distinct()
    return classes.unionByName(methods).join(known, "fqn").select("fqn", "type", "package", "line", "visibility", "has_override", "is_transactional")


def _held(symbols: DataFrame, *columns: str) -> DataFrame:
    """(fqn, held): by name what each package that holds a symbol says of it, in order of packages."""
    return symbols.groupBy("fqn").agg(F.sort_array(F.collect_set(F.struct("package", *columns))).alias("held"))


def _nearest(held: str, package: str) -> Column:
    """Of a symbol in several packages that of one's own, else the first."""
    return F.coalesce(F.get(F.filter(held, lambda h: h["package"].eqNullSafe(F.col(package))), F.lit(0)), F.get(held, F.lit(0)))


def tree_edges(trees: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges between indexed symbols, with the package of the file as owner: a member points to what contains it.

    An edge stays one, whatever packages hold its ends.
    """
    trees = trees.withColumn("owner", F.col("package"))
    method = trees.select("owner", "fqn", F.explode("methods").alias("m"))
    none = F.lit(None).cast("int")

    def edge(df: DataFrame, source: str, kind_of_edge: str, target: str, kind: Column, line: Column = none) -> DataFrame:
        return df.select("owner", F.col(source).alias("from_fqn"), F.lit(kind_of_edge).alias("edge_type"), F.col(target).alias("to_fqn"), kind.alias("kind"), line.alias("from_line"))

    parents = trees.select("owner", "fqn", F.explode("inheritance").alias("p"))
    fields = trees.select("owner", "fqn", F.explode("fields").alias("f"))
    arguments = method.select("owner", "m.fqn", F.explode("m.arguments").alias("a"))
    calls = method.select("owner", F.col("m.fqn").alias("fqn"), F.explode("m.calls").alias("c"))
    edges = (
        edge(parents, "fqn", "inheritance", "p.fqn", F.col("p.kind"))
        .unionByName(edge(fields, "f.type", "member_of", "fqn", F.lit("attribute")))
        .unionByName(edge(method, "m.fqn", "member_of", "fqn", F.lit("method")))
        .unionByName(edge(method.where("m.return_type is not null"), "m.return_type", "member_of", "m.fqn", F.lit("return")))
        .unionByName(edge(arguments, "a", "member_of", "fqn", F.lit("argument")))
        .unionByName(edge(calls, "fqn", "call", "c.to_fqn", F.col("c.kind"), F.col("c.line_number")))
    )
    known = _held(symbols)
    first, second = (known.select(F.col("fqn").alias(f"{end}_fqn"), F.col("held").alias(f"{end}_held")) for end in ("from", "to"))
    packages = [_nearest(f"{end}_held", "owner")["package"].alias(f"{end}_package") for end in ("from", "to")]
    return edges.join(first, "from_fqn").join(second, "to_fqn").select("from_fqn", "edge_type", "to_fqn", "kind", *packages, "from_line", "owner")


def tree_usages(trees: DataFrame, symbols: DataFrame) -> DataFrame:
    """Usages, with the package as owner: a declaration of each class and method, and each call with what is known of its callee.

    Of a symbol in several packages that of one's own counts, else the first.
    """
    known = _held(symbols, "uri", "line")
    here = trees.join(known, "fqn").withColumn("uri", _nearest("held", "package")["uri"]).withColumn("module", fn.module_of_artifact(F.col("package")))
    method = here.select("package", "module", "uri", F.explode("methods").alias("m"))
    kind_of = F.when(F.col("callee_symbol").contains("("), "method").otherwise("class")

    def declared(df: DataFrame, symbol: str, line: Column) -> DataFrame:
        return df.select(F.lit("java_declaration").alias("usage_type"), F.col("uri").alias("caller_uri"), line.alias("caller_line"), F.lit(None).cast("string").alias("caller_symbol"), F.col(symbol).alias("callee_symbol"), "module", "package")

    calls = method.select("package", "module", "uri", F.col("m.fqn").alias("caller_symbol"), F.explode("m.calls").alias("c"))
    called = calls.select(F.lit("java_method_call").alias("usage_type"), F.col("uri").alias("caller_uri"), F.col("c.line_number").alias("caller_line"), "caller_symbol", F.col("c.to_fqn").alias("callee_symbol"), "module", "package")
    rows = declared(here, "fqn", F.col("line_number")).unionByName(declared(method, "m.fqn", F.col("m.line_number"))).unionByName(called)
    rows = rows.join(known.withColumnRenamed("fqn", "callee_symbol"), "callee_symbol", "left").withColumn("callee", _nearest("held", "package"))
    return rows.withColumn("callee_uri", F.col("callee.uri")).withColumn("callee_line", F.col("callee.line")).select(
        F.lit("java").alias("source"), "usage_type", "caller_uri", "caller_line", "caller_symbol", F.when(F.col("caller_symbol").isNotNull(), "method").alias("caller_kind"), "callee_uri", "callee_symbol", "callee_line", kind_of.alias("callee_kind"), "module", F.col("package").alias("owner")
    )
