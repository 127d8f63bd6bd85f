"""View and action definitions in XML: a table function from files to references.

One walk over a file's elements carries the scope of each: the nearest view, action view, related panel and editor above.
Rules look at an element and its scope and yield references; lookups of a view's model go to the global map first and
then to the file's own.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn

# The vocabulary of view files.
VIEWS = ["grid", "form", "calendar", "gantt", "chart", "custom", "kanban", "cards"]
EVENTS = ["onClick", "onChange", "onNew", "onLoad", "onSave", "onSelect", "onTabSelect", "onCopy", "onDelete", "onInit", "onMove"]
CONDITIONS = ["if", "showIf", "hideIf", "requiredIf", "readonlyIf", "validIf", "canNew", "canEdit", "canSave", "canDelete", "collapseIf", "saveIf"]
EXPRESSIONS = ["expr", "domain", "target", "value"]
VIEW_ATTRIBUTES = ["form-view", "grid-view", "calendar-view", "chart-view", "gantt-view", "custom-view"]
FIELDS = ["field", "column", "string", "integer", "decimal", "boolean", "date", "datetime", "many-to-one", "one-to-many", "many-to-many", "one-to-one", "binary", "panel-related"]
OPERATIONS = ["insert", "replace", "remove", "attribute"]
# Folders that hold no sources.
EXCLUDED_FOLDERS = ["build", "node_modules", "dist", ".git", "target", "bin", ".gradle", ".settings", "out"]

REFERENCE = "ref_type string, ref_value string, line_number int, context map<string,string>"
Reference = tuple[str, str, dict[str, str]]


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?U)", ""))


_DIRECT, _MEMBER = [_compiled(p) for p in fn.EXPRESSION_PATTERNS], _compiled(fn.MEMBER_PATTERN)
_SHOWN, _BARE = [_compiled(p) for p in fn.TEMPLATE_PATTERNS], _compiled(fn.BARE_TEMPLATE_PATTERN)


def expression_fields(text: str) -> list[str]:
    """As functions.expression_fields, for a single text."""
    found = {x for p in _DIRECT for x in p.findall(text)}
    return sorted(found | {name for owner, name in _MEMBER.findall(text) if owner not in fn.NO_OBJECTS})


def template_fields(text: str) -> list[str]:
    found = {x for p in _SHOWN for x in p.findall(text)}
    return sorted(found | {x for x in _BARE.findall(text) if x not in fn.NO_FIELDS})


def local(tag: object) -> str:
    return str(tag).rpartition("}")[2]


@dataclass
class Scope:
    """What stands above an element, the root first."""

    above: list[ET.Element] = field(default_factory=list)

    def upward(self) -> Iterator[ET.Element]:
        return reversed(self.above)

    def nearest(self, names: list[str]) -> ET.Element | None:
        return next((x for x in self.upward() if local(x.tag) in names), None)

    def view(self) -> dict[str, str]:
        found = self.nearest(VIEWS)
        if found is None:
            return {"parent_view_id": "", "parent_view_name": "", "parent_view_tag": ""}
        name = found.get("name", "")
        return {"parent_view_id": found.get("id") or name, "parent_view_name": name, "parent_view_tag": local(found.tag)}


def _walk(root: ET.Element) -> Iterator[tuple[ET.Element, str, Scope]]:
    """Elements in order of the file, of any depth; what stands above is one list that grows and shrinks."""
    above: list[ET.Element] = []
    waiting = [iter([root])]
    while waiting:
        element = next(waiting[-1], None)
        if element is None:
            waiting.pop()
            if above:
                above.pop()
            continue
        yield element, local(element.tag), Scope(above)
        above.append(element)
        waiting.append(iter(element))


def view_models(root: ET.Element) -> dict[str, str]:
    """Model of each view of a file that has a name and a model; the last of a name counts."""
    return {x.get("name"): x.get("model") for x in root.iter() if local(x.tag) in VIEWS and x.get("name") and x.get("model")}


def _definition(x: ET.Element, tag: str) -> Iterator[Reference]:
    name = x.get("name")
    if not name or not (tag in VIEWS or tag.startswith("action-")):
        return
    extends = x.get("extension") == "true"
    context = {"view_id": x.get("id") or name, "is_extension": str(extends), "model": x.get("model", "")}
    if extends:
        parts = [e for e in x.iter() if e is not x and local(e.tag) == "extend"]
        goals = [e.get("target") for e in parts if e.get("target")]
        done = [local(c.tag) for e in parts for c in e if local(c.tag) in OPERATIONS]
        context |= {"extend_targets": "|".join(goals)} if goals else {}
        context |= {"extend_operations": ",".join(done)} if done else {}
    yield f"{tag}_{'extension' if extends else 'definition'}", name, context


def _group(x: ET.Element, tag: str) -> Iterator[Reference]:
    name = x.get("name")
    if tag != "action-group" or not name:
        return
    children = [c.get("name") for c in x if local(c.tag) == "action" and c.get("name")]
    yield "action_group_definition", name, {"child_actions": ",".join(children), "child_count": str(len(children))}
    for i, child in enumerate(children):
        yield "action_group_contains_action", child, {"parent_action": name, "position": str(i)}
        yield "action_contained_by_group", name, {"child_action": child, "position": str(i)}


def _method(x: ET.Element, tag: str) -> Iterator[Reference]:
    name = x.get("name")
    if tag != "action-method" or not name:
        return
    call = next((c for c in x.iter() if local(c.tag) == "call"), None)
    if call is None:
        return
    owner, method = call.get("class", ""), call.get("method", "")
    yield "action_method_definition", name, {"java_class": owner, "java_method": method, "java_fqn": f"{owner}.{method}" if owner and method else ""}
    if method:
        yield "xml_calls_java_method", method, {"action_name": name, "java_class": owner, "java_fqn": f"{owner}.{method}"}


def _java_call(action: str, event: str, more: dict[str, str]) -> Iterator[Reference]:
    parts = action.split(":")
    if len(parts) == 2:
        yield "xml_calls_java_method", parts[1], {"event_type": event, "java_class": parts[0], "java_fqn": action, "direct_call": "true", **more}


def _events(x: ET.Element, tag: str, scope: Scope, events: list[str] = EVENTS) -> Iterator[Reference]:
    name, view = x.get("field", "") or x.get("name", ""), None
    for event in events:
        action = x.get(event)
        if not action:
            continue
        view = view or scope.view()
        above = view["parent_view_id"]
        if "," in action:
            group = "-".join(["inline-group", *([above] if above else []), name or tag, event])
            actions = [a.strip() for a in action.split(",")]
            listed = {"child_actions": ",".join(actions), "child_count": str(len(actions)), "is_inline": "true"}
            yield "inline_action_group", group, {"event_type": event, "element_tag": tag, "element_name": name, **view, **listed}
            for i, one in enumerate(actions):
                if one:
                    place = {"position": str(i), "event_type": event, "element_name": name, "parent_view_id": above}
                    yield "inline_group_contains_action", one, {"parent_group": group, **place}
                    yield "action_contained_by_inline_group", group, {"child_action": one, **place}
                    yield from _java_call(one, event, {"inline_group": group})
        elif ":" in action:
            yield from _java_call(action, event, {})
        else:
            trigger = ":".join([*([above] if above and name else []), name or tag, event])
            place = {"event_type": event, "element_tag": tag, "field_name": name, **view}
            yield "xml_trigger_calls_action", action, {"trigger_identifier": trigger, **place}
            yield "xml_action_called_by_trigger", trigger, {"action_name": action, **place}


def _view_uses(x: ET.Element, tag: str, scope: Scope) -> Iterator[Reference]:
    name = x.get("name", "")
    for attribute in VIEW_ATTRIBUTES:
        if used := x.get(attribute):
            view = scope.view()
            place = {"element_tag": tag, **view, "attribute": attribute, "view_type": attribute.removesuffix("-view")}
            yield "xml_element_uses_view", used, {"element_name": name, **place}
            yield "xml_view_used_by_element", name or f"{tag}@{view['parent_view_id']}", {"view_name": used, **place}
    if tag == "view" and name and x.get("type"):
        owner = scope.nearest(["action-view"])
        called = "" if owner is None else owner.get("name", "")
        identifier = "" if owner is None else called or owner.get("id", "")
        kind = {"parent_action_name": called, "view_type": x.get("type")}
        yield "xml_action_view_uses_view", name, {"parent_action_view": identifier, **kind}
        yield "xml_view_used_by_action_view", identifier, {"view_name": name, **kind}


Models = list[dict[str, str]]


def _own_target(x: ET.Element, names: tuple[str, str]) -> tuple[str, str]:
    for attribute, how in zip(("target", "target-name"), names, strict=True):
        if x.get(attribute):
            return x.get(attribute), how
    return "", ""


def _panel_model(panel: ET.Element, models: Models, prefix: str) -> tuple[str, str]:
    """The model of the view that a related panel names; a panel's grid goes before its form."""
    used = panel.get("grid-view") or panel.get("form-view")
    kind = "grid" if panel.get("grid-view") else "form"
    model = next((m[used] for m in models if used in m), "")
    return (model, f"{prefix}panel_related_{kind}_view") if model else ("", "")


def head_model(x: ET.Element, scope: Scope, models: Models) -> tuple[str, str]:
    """The model that a field belongs or leads to, and how it was found."""
    if (found := _own_target(x, ("field_target", "field_target_name")))[0]:
        return found
    for i, above in enumerate(scope.upward(), 2):
        tag = local(above.tag)
        if tag == "panel-related":
            if above.get("target"):
                return above.get("target"), "panel_related"
            found = _panel_model(above, models, "")
            return found if found[0] else ("", "unresolved_panel_related")
        if tag == "editor":
            owner = scope.above[-i] if i <= len(scope.above) else None
            if owner is not None and local(owner.tag) == "field":
                if model := owner.get("target") or owner.get("target-name"):
                    return model, "editor_parent_field"
            return "", "unresolved_editor"
        if tag in VIEWS:
            return (above.get("model"), "view") if above.get("model") else ("", "unresolved")
    return "", "unresolved"


def tail_model(x: ET.Element, scope: Scope, models: Models) -> tuple[str, str]:
    """The model that the last part of a dotted field belongs to."""
    if (found := _own_target(x, ("tail_from_field_target", "tail_from_field_target_name")))[0]:
        return found
    panel = next((y for y in chain([x], scope.upward()) if local(y.tag) == "panel-related"), None)
    return ("", "") if panel is None else _panel_model(panel, models, "tail_from_")


def _fields(x: ET.Element, tag: str, scope: Scope, models: Models) -> Iterator[Reference]:
    full = x.get("field") if tag == "panel-related" else x.get("name")
    if tag not in FIELDS or not full:
        return
    head, dot, rest = full.partition(".")
    shown = {"field_tag": tag, **scope.view(), "widget": x.get("widget", ""), "target": x.get("target", ""), "target_name": x.get("target-name", "")}
    found = [(head, *head_model(x, scope, models), "is_head_of_dotted_field")]
    if dot:
        found.append((full.rpartition(".")[2], *tail_model(x, scope, models), "is_tail_of_dotted_field"))
    for name, model, how, part in found:
        if model:
            path = {part: "true", "field_path_full": full, "dotted_path": rest} if dot else {}
            yield "field_references_model", model, {"field_name": name, "model_resolution": how, **shown, **path}
            yield "model_referenced_by_field", name, {"model": model, "model_resolution": how, **shown, **path}


def _viewer(x: ET.Element, tag: str, scope: Scope) -> Iterator[Reference]:
    if tag != "viewer":
        return
    owner = scope.above[-1] if scope.above else None
    name, above = ("", "") if owner is None else (owner.get("name", ""), local(owner.tag))
    text = x.text or ""
    for shown in template_fields(text) if text.strip() else ():
        yield "xml_viewer_field_ref", shown, {"parent_field": name, "parent_tag": above, "viewer_content": text[:100]}
    for needed in (x.get("depends") or "").split(","):
        if needed.strip():
            yield "xml_viewer_depends", needed.strip(), {"parent_field": name, "attribute": "depends"}


def _expressions(x: ET.Element, tag: str, conditions: list[str] = CONDITIONS) -> Iterator[Reference]:
    for attribute in dict.fromkeys([*conditions, *EXPRESSIONS]):
        if value := x.get(attribute):
            for name in expression_fields(value):
                yield "xml_expression_field_ref", name, {"attribute": attribute, "expression": value[:100], "element_tag": tag}
    if x.text and x.text.strip():
        for name in expression_fields(x.text):
            yield "xml_script_field_ref", name, {"element_tag": tag, "script_type": "groovy" if tag == "action-script" else "expression"}


def _root(text: str | bytes) -> ET.Element | None:
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def references(text: str | bytes, global_models: dict[str, str] | None = None, events: list[str] = EVENTS, conditions: list[str] = CONDITIONS) -> list[Reference]:
    """All references of a file; none of one that isn't well-formed."""
    root = _root(text)
    if root is None:
        return []
    models = [global_models or {}, view_models(root)]
    out: list[Reference] = []
    for x, tag, scope in _walk(root):
        out += [*_definition(x, tag), *_group(x, tag), *_method(x, tag), *_events(x, tag, scope, events), *_view_uses(x, tag, scope)]
        out += [*_fields(x, tag, scope, models), *_viewer(x, tag, scope), *_expressions(x, tag, conditions)]
    return out


def used_views(text: str | bytes) -> list[str]:
    """Views whose models a file needs: those that its related panels name."""
    root = _root(text)
    panels = [] if root is None else [x for x in root.iter() if local(x.tag) == "panel-related"]
    return sorted({x.get("grid-view") or x.get("form-view") for x in panels} - {None})


def xml_files(files: DataFrame) -> DataFrame:
    """Files (path, content) that are views of sources: no part of their path is an excluded folder."""
    parts = F.split("path", "/")
    return files.where(F.col("path").endswith(".xml") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in EXCLUDED_FOLDERS])))


def extract(files: DataFrame, view_map: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(path, module, ref_type, ref_value, line_number, context) of files (path, content).

    view_map: (view_name, model) of all repositories. Up to MOST_VIEWS rows go to the driver; of a larger map each file is
    joined with the views that it names. vocabulary: (path, kind, name) of schemas, few by nature; their events and
    conditions, if they have any, take the place of the fixed ones.
    """
    known: dict[str, str] = {}
    rows = files.select("path", "content")
    if view_map is not None:
        collected = view_map.limit(MOST_VIEWS + 1).collect()
        if len(collected) > MOST_VIEWS:
            rows = rows.join(_views_of_files(rows, view_map), "path", "left")
        else:
            known = {r["view_name"]: r["model"] for r in collected}
    words = {"events": EVENTS, "conditions": CONDITIONS}
    if vocabulary is not None:
        for r in vocabulary.where(F.col("kind").isin(list(words))).groupBy("kind").agg(F.sort_array(F.collect_set("name")).alias("names")).collect():
            words[r["kind"]] = r["names"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("views").to_pylist() if "views" in batch.schema.names else [None] * batch.num_rows
            for path, content, views in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), own, strict=True):
                found = references(content or b"", dict(views) if views else known, words["events"], words["conditions"])
                kinds, values, contexts = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([0] * len(found), pa.int32()), pa.array([list(c.items()) for c in contexts], pa.map_(pa.string(), pa.string()))],
                    ["path", "ref_type", "ref_value", "line_number", "context"],
                )

    return rows.mapInArrow(run, f"path string, {REFERENCE}").withColumn("module", fn.module_of_path(F.col("path")))


def models_of_files(files: DataFrame) -> DataFrame:
    """(path, view_name, model) of the views that files (path, content) define; the last of a name in a file counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                root = _root(content or b"")
                found = {} if root is None else view_models(root)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([path] * len(found), list(found), list(found.values()))], ["path", "view_name", "model"])

    return files.select("path", "content").mapInArrow(run, "path string, view_name string, model string")


#: Views of a global map that go to the driver and to each task at most.
MOST_VIEWS = 1_000_000


def _views_of_files(files: DataFrame, view_map: DataFrame) -> DataFrame:
    """(path, views): the part of a map that a file needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                names = used_views(content or b"")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], ["path", "view_name"])

    single = view_map.groupBy("view_name").agg(F.max("model").alias("model"))
    named = files.mapInArrow(run, "path string, view_name string").join(single, "view_name")
    return named.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("view_name", "model"))).alias("views"))


def usages(extracted: DataFrame) -> DataFrame:
    """Extracted references as rows of the usage table, each with the text that is indexed for it."""
    document = fn.usage_document(F.col("ref_type"), F.col("ref_value"), F.col("module"))
    return extracted.select(
        F.lit("xml").alias("source"),
        F.col("path").alias("source_file"),
        F.col("ref_type").alias("usage_type"),
        F.col("path").alias("caller_uri"),
        F.col("line_number").alias("caller_line"),
        F.col("ref_value").alias("callee_symbol"),
        "module",
        "context",
        F.to_json("context").alias("context_json"),
        document.alias("document"),
    )
