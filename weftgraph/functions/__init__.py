"""Column functions over symbols, paths, XML names and expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a path that mark generated or foreign sources.
GENERATED = ["/build/", "/src-gen/", "\\build\\", "\\src-gen\\", "axelor-open-platform"]
# Types that are no symbols.
PRIMITIVES = ["void", "boolean", "byte", "char", "short", "int", "long", "float", "double"]
# Access flags of the class file format, in the order in which they are named.
ACCESS = [(0x0001, "public"), (0x0002, "private"), (0x0004, "protected"), (0x0008, "static"), (0x0010, "final"), (0x0400, "abstract")]
# Patterns of fields in expressions, and objects whose members are no fields; (?U) gives \w its Unicode sense.
EXPRESSION_PATTERNS = [r"(?U)\bself\.(\w+)", r"(?U)\bcontext\.(\w+)", r"(?U)\b([a-z][a-zA-Z0-9]*)\s*(?:==|!=|IN|NOT|>|<|=)"]
MEMBER_PATTERN = r"(?U)\b(\w+)\.(\w+)"
NO_OBJECTS = ["self", "context", "eval", "call"]
# Patterns of fields in viewer templates, and words that are no fields.
TEMPLATE_PATTERNS = [r"(?U)\{\{record\.(\w+)\}\}", r"(?U)\{record\.(\w+)\}", r'(?U)ng-\w+="[^"]*\{?\{?record\.(\w+)\}?\}?[^"]*"']
BARE_TEMPLATE_PATTERN = r"(?U)\{\{(\w+)\}\}"
NO_FIELDS = ["record", "this", "self", "true", "false", "null"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def is_generated(uri: Column) -> Column:
    """Whether a caller's file was generated or belongs to the platform; an unknown file wasn't."""
    uri = F.coalesce(uri, F.lit(""))
    return any_of([uri.contains(x) for x in GENERATED])


def in_domains(name: Column, domains: list[str]) -> Column:
    """Whether a name starts with one of the domains; without domains all do."""
    return any_of([name.startswith(x) for x in domains]) if domains else F.lit(True)


def is_symbol_type(name: Column) -> Column:
    """False for primitives, their arrays aside, and for java.lang."""
    return name.isNotNull() & ~name.isin(PRIMITIVES) & ~name.startswith("java.lang.")


def to_dotted(internal: Column) -> Column:
    return F.translate(internal, "/", ".")


def class_of_method(fqn: Column) -> Column:
    """The class part of a method's name; a name without arguments is returned as it is."""
    return F.when(fqn.contains("("), F.regexp_extract(fqn, r"^([^(]*)\.[^.(]+\(", 1)).otherwise(fqn)


def simple_name(fqn: Column) -> Column:
    """The last dotted part in front of the arguments."""
    return F.substring_index(F.substring_index(fqn, "(", 1), ".", -1)


def relative_path(fqn: Column, extension: str = ".java") -> Column:
    return F.concat(F.translate(class_of_method(fqn), ".", "/"), F.lit(extension))


def file_uri(path: Column, line: Column) -> Column:
    """file:// of a path, with :line where there is one."""
    path = F.translate(path, "\\", "/")
    rooted = F.when(path.rlike("^[A-Za-z]:"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(F.lit("file://"), rooted, F.when(line > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit("")))


def file_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^/:]+)(:\d+)?$", 1)


def module_of_artifact(name: Column) -> Column:
    """A jar's name without its version."""
    found = F.regexp_extract(name, r"^(.+?)-[\d.]+", 1)
    return F.when(found != "", found).otherwise(name)


def module_of_path(path: Column) -> Column:
    """The part behind the first `modules`, else `unknown`."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "modules")
    return F.when(at > 0, F.coalesce(F.try_element_at(parts, (at + 1).cast("int")), F.lit("unknown"))).otherwise(F.lit("unknown"))


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def field_head(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def field_tail(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def field_rest(name: Column) -> Column:
    """What follows the first dot, or null."""
    return F.when(name.contains("."), F.regexp_replace(name, r"^[^.]*\.", ""))


def visibility(modifiers: Column) -> Column:
    chosen = F.lit("package")
    for name in ("protected", "private", "public"):
        chosen = F.when(F.array_contains(modifiers, name), F.lit(name)).otherwise(chosen)
    return F.coalesce(chosen, F.lit("package"))


def access_modifiers(flags: Column) -> Column:
    named = [F.when(flags.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in ACCESS]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def is_interesting_string(text: Column) -> Column:
    """Whether a string literal may name an action, a view or a service."""
    lower = F.lower(text)
    sized = (F.length(text) >= 2) & (F.length(text) <= 200) & (F.trim(text) != "")
    return sized & (text.contains(".") | text.startswith("ws/") | text.contains("Controller") | lower.contains("action") | lower.contains("view"))


def action_parts(value: Column) -> Column:
    """The trimmed, non-empty actions of an event attribute."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def java_call(action: Column) -> Column:
    """Struct of class and method of `Class:method`, else null."""
    parts = F.split(action, ":")
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("class"), F.trim(parts[1]).alias("method")))


def trigger_id(view: Column, field: Column, event: Column) -> Column:
    """`view:field:event`, with what is known of it."""
    view, field = F.nullif(view, F.lit("")), F.nullif(field, F.lit(""))
    return F.concat_ws(":", view, field, event)


def expression_fields(text: Column) -> Column:
    """The sorted names of fields that an expression or script refers to."""
    direct = [F.regexp_extract_all(text, F.lit(p), 1) for p in EXPRESSION_PATTERNS]
    members = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(MEMBER_PATTERN), i).alias(n) for i, n in ((1, "object"), (2, "field"))])
    members = F.transform(F.filter(members, lambda x: ~x["object"].isin(NO_OBJECTS)), lambda x: x["field"])
    return F.sort_array(F.array_distinct(F.concat(*direct, members)))


def template_fields(text: Column) -> Column:
    """The sorted names of fields that a viewer template shows."""
    named = [F.regexp_extract_all(text, F.lit(p), 1) for p in TEMPLATE_PATTERNS]
    bare = F.filter(F.regexp_extract_all(text, F.lit(BARE_TEMPLATE_PATTERN), 1), lambda x: ~x.isin(NO_FIELDS))
    return F.sort_array(F.array_distinct(F.concat(*named, bare)))


def strip_empty(context: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(context, lambda _, v: v.isNotNull() & (v != ""))


def usage_document(kind: Column, value: Column, module: Column) -> Column:
    """The text that is indexed for a usage."""
    return F.concat(kind, F.lit(": "), value, F.lit(" in module "), module)


def shortened(text: Column, n: int = 100) -> Column:
    return F.left(text, F.lit(n))


def per_thousand(n: Column, total: Column) -> Column:
    return F.floor(1000 * (n / total))


def is_own_module(specifier: Column) -> Column:
    """Whether an import is of a file of one's own: relative, and not below node_modules."""
    return specifier.startswith(".") & ~specifier.contains("node_modules")


def contains_text(column: Column, text: str) -> Column:
    """Whether a text occurs, in any case, as SQL's ILIKE has it."""
    return column.ilike(f"%{text}%")


def ends_with_name(column: Column, name: str) -> Column:
    """Whether a dotted name ends with parts, in any case."""
    return column.ilike(f"%.{name}")
