"""TypeScript sources: a token scanner that yields imports, exports, calls, hooks, components and telling strings.

A scanner, not a parser: it skips comments, keeps strings and templates whole, tracks braces to know the function around a
token, and takes `<Name` where a value can begin as a component. Types and overloads are beyond it.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USAGE = "usage_type string, caller_line int, caller_symbol string, callee_symbol string, callee_uri string, string_context string"
# What a module specifier can stand for, best first.
ENDINGS = ["", ".ts", ".tsx", "/index.ts", "/index.tsx"]
# Names that look like a call but are part of the language.
KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "constructor", "new", "await", "import"]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|[^\s\w])""",
    re.S,
)


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of all tokens."""
    out, line = [], 1
    for found in _TOKEN.finditer(text):
        if found.lastgroup != "skip":
            out.append((found.lastgroup, found.group(), line))
        line += found.group().count("\n")
    return out


def resolve(specifier: str, path: str) -> str:
    """A relative specifier as a path without an ending; others as they are."""
    if not specifier.startswith("."):
        return specifier
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))


def is_telling(value: str) -> bool:
    """As functions.is_interesting_string, for a single text."""
    lower = value.lower()
    return 2 <= len(value) <= 200 and bool(value.strip()) and ("." in value or value.startswith("ws/") or "Controller" in value or "action" in lower or "view" in lower)


def usages(text: str, path: str) -> list[tuple]:
    """Rows of USAGE for a file."""
    t = tokens(text)
    out: list[tuple] = []
    modules: dict[str, str] = {}
    around: list[tuple[str, int]] = []  # names of open functions, with the depth of braces at which they end
    depth, waiting = 0, None

    def at(i: int) -> tuple[str, str, int]:
        return t[i] if 0 <= i < len(t) else ("", "", 0)

    def names_in_braces(i: int) -> list[str]:
        """Names behind an opening brace at i; of `a as b` the outer one."""
        found: list[str] = []
        i += 1
        while at(i)[1] not in ("}", ""):
            if at(i)[0] == "name" and at(i)[1] not in ("as", "type"):
                if at(i - 1)[1] == "as" and found:
                    found.pop()
                found.append(at(i)[1])
            i += 1
        return found

    i = 0
    while i < len(t):
        kind, word, line = t[i]
        caller = around[-1][0] if around else None
        if word == "import" and kind == "name" and at(i + 1)[1] not in ("(", "."):
            j, found = i + 1, []
            while at(j)[0] != "string" and at(j)[1] not in (";", ""):
                if at(j)[1] == "{":
                    found += names_in_braces(j)
                    while at(j)[1] not in ("}", ""):
                        j += 1
                elif at(j)[0] == "name" and at(j)[1] not in ("from", "type", "as"):
                    found.append(at(j)[1])
                j += 1
            if at(j)[0] == "string":
                raw = at(j)[1][1:-1]
                for name in found:
                    modules[name] = resolve(raw, path)
                    out.append(("import", line, None, name, modules[name], f"from:{raw}"))
            i = j + 1
            continue
        if word == "export" and kind == "name":
            if at(i + 1)[1] == "{":
                out += [("export", line, None, name, path, None) for name in names_in_braces(i + 1)]
            else:
                j = i + 1
                while at(j)[1] in ("default", "async", "abstract", "declare", "const", "let", "var", "function", "class", "interface", "type", "enum", "namespace"):
                    j += 1
                if at(j)[0] == "name" and j > i + 1:
                    out.append(("export", line, None, at(j)[1], path, None))
        elif kind == "name" and at(i - 1)[1] == "function":
            waiting = word
        elif kind == "name" and at(i - 1)[1] in ("const", "let", "var") and at(i + 1)[1] == "=" and (at(i + 2)[1] in ("(", "async", "function")):
            waiting = word
        elif kind == "name" and at(i + 1)[1] == "(" and word not in KEYWORDS and at(i - 1)[1] != "function":
            out.append(("function_call", line, caller, word, modules.get(word), None))
            if word.startswith("use") and word[3:4].isupper():
                out.append(("hook_call", line, caller, word, modules.get(word), None))
        elif word == "<" and at(i + 1)[0] == "name" and at(i + 1)[1][0].isupper() and (at(i - 1)[0] != "name" or at(i - 1)[1] in ("return", "default")):
            out.append(("react_component", line, caller, at(i + 1)[1], modules.get(at(i + 1)[1]), None))
        elif kind == "string" and is_telling(word[1:-1]):
            context = f"call:{at(i - 2)[1]}" if at(i - 1)[1] == "(" and at(i - 2)[0] == "name" else f"prop:{at(i - 2)[1]}" if at(i - 1)[1] == ":" else "variable" if at(i - 1)[1] == "=" else None
            out.append(("string_literal", line, caller, word[1:-1], None, context))
        if word == "{":
            depth += 1
            if waiting:
                around.append((waiting, depth))
                waiting = None
        elif word == "}":
            if around and around[-1][1] == depth:
                around.pop()
            depth -= 1
        elif word == ";":
            waiting = None
        i += 1
    return out


# Words in front of a declared name, and the kind that they declare.
DECLARED = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace", "module": "namespace"}


def declared(text: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of declarations: functions, classes, methods, interfaces, types, enums, namespaces, components and constants."""
    t = tokens(text)
    out: list[tuple[str, str, int]] = []
    depth, waiting, bodies = 0, False, []  # depths of open class bodies
    for i, (kind, word, line) in enumerate(t):
        before, behind, third = (t[j][1] if 0 <= j < len(t) else "" for j in (i - 1, i + 1, i + 2))
        if kind == "name" and before in DECLARED and (before not in ("type", "module") or behind in ("=", "<", "{")):
            out.append((word, DECLARED[before], line))
            waiting = waiting or before == "class"
        elif kind == "name" and before in ("const", "let", "var"):
            end = next((j for j in range(i + 1, len(t)) if t[j][1] in ("=", ";", ")", "of", "in")), len(t))
            value = [x[1] for x in t[end + 1 : end + 3]] if end < len(t) and t[end][1] == "=" else []
            called = bool(value) and (value[0] in ("function", "async") or _is_arrow(t, end + 1))
            out.append((word, ("component" if word[:1].isupper() else "function") if called else "const", line))
        elif kind == "name" and bodies and bodies[-1] == depth and behind == "(" and before in ("{", "}", ";", "async", "public", "private", "protected", "static", "get", "set", "override"):
            out.append((word, "method", line))
        if word == "{" and kind == "sign":
            depth += 1
            if waiting:
                bodies.append(depth)
                waiting = False
        elif word == "}" and kind == "sign":
            if bodies and bodies[-1] == depth:
                bodies.pop()
            depth -= 1
    return out


def _is_arrow(t: list[tuple[str, str, int]], i: int) -> bool:
    """Whether a value that begins at i is an arrow function."""
    if i + 1 < len(t) and t[i][0] == "name":
        return t[i + 1][1] == "=>"
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j][1] in "([{") - (t[j][1] in ")]}") if t[j][0] == "sign" else 0
        if depth == 0:
            behind = [x[1] for x in t[j + 1 : j + 12]]
            return t[i][1] == "(" and "=>" in behind[: behind.index(";") if ";" in behind else None] and behind[:1] in (["=>"], [":"])
    return False


def _own(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"\.tsx?$") & ~F.col("path").contains("node_modules")).select("path", "content")


def declarations(files: DataFrame) -> DataFrame:
    """(path, name, kind, line) of TypeScript files (path, content); of equal names in a file the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = declared((content or b"").decode("utf-8", "replace"))
                names, kinds, lines = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(lines, pa.int32())], ["path", "name", "kind", "line"])

    every = _own(files).mapInArrow(run, "path string, name string, kind string, line int")
    return every.groupBy("path", "name").agg(F.min_by("kind", "line").alias("kind"), F.min("line").alias("line"))


def with_kinds(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Usages with caller_kind, callee_kind and callee_line by the declarations; a hook's kind is `hook`."""
    callers = declared.select("path", F.col("name").alias("caller_symbol"), F.col("kind").alias("caller_kind"))
    callees = declared.select(F.col("path").alias("callee_uri"), F.col("name").alias("callee_symbol"), F.col("kind").alias("callee_kind"), F.col("line").alias("callee_line"))
    out = found.join(callers, ["path", "caller_symbol"], "left").join(callees, ["callee_uri", "callee_symbol"], "left")
    kind = F.when(F.col("usage_type") == "hook_call", "hook").otherwise(F.col("callee_kind"))
    return out.withColumn("callee_kind", kind).select(*found.columns, "caller_kind", "callee_kind", "callee_line")


def extract(files: DataFrame) -> DataFrame:
    """(path, usage columns) of TypeScript files (path, content)."""
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["path", *[x.split()[0] for x in USAGE.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = usages((content or b"").decode("utf-8", "replace"), path)
                values = list(zip(*found, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *[pa.array(v, k) for v, k in zip(values, types, strict=True)]], names)

    return _own(files).mapInArrow(run, f"path string, {USAGE}")


def resolved(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Usages with the file that a module stands for, the best of its endings, out of a listing (path)."""
    listing = paths.select(F.col("path").alias("target"))
    modules = found.select("callee_uri").distinct().where("callee_uri is not null")
    options = modules.select("callee_uri", F.posexplode(F.array(*[F.lit(x) for x in ENDINGS])).alias("rank", "ending"))
    hits = options.withColumn("target", F.concat("callee_uri", "ending")).join(listing, "target")
    best = hits.groupBy("callee_uri").agg(F.min_by("target", "rank").alias("target"))
    return found.join(best, "callee_uri", "left").withColumn("callee_uri", F.coalesce("target", "callee_uri")).drop("target")


def both_ways(found: DataFrame) -> DataFrame:
    """Usages and their inverses: of what has a known file and line, the callee's view."""
    names = {"function_call": "function_called_by", "hook_call": "hook_called_by", "react_component": "component_used_by"}
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = found.where(F.col("usage_type").isin(list(names)) & F.col("callee_uri").isNotNull() & (F.col("caller_line") > 0))
    back = {"path": "callee_uri", "callee_uri": "path", "caller_symbol": "callee_symbol", "callee_symbol": "caller_symbol", "caller_kind": "callee_kind", "callee_kind": "caller_kind"}
    if "callee_line" in found.columns:  # where both lines are known, they change places
        back |= {"caller_line": "callee_line", "callee_line": "caller_line"}
        known = known.where("callee_line > 0")
    swapped = known.select(*[mapped[F.col("usage_type")].alias(c) if c == "usage_type" else F.col(back.get(c, c)).alias(c) for c in found.columns])
    return found.unionByName(swapped)
