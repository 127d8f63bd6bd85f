"""Traversal, pages, changes and the engine, on small graphs with known answers."""

import pytest

from compiled import BASE, M, renamed
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from weftgraph import functions as fn
from weftgraph import storage, streaming
from weftgraph.operators import mutate, query, traverse
from weftgraph.plans import Engine, render
from weftgraph.sources import class_files, listings, typescript, xml_views

CALLS = [("b", "a"), ("c", "a"), ("c", "b"), ("d", "c"), ("a", "d")]


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([(*x, i) for i, x in enumerate(CALLS)], "from_fqn string, to_fqn string, n int")


def shape(tree):
    return tree.symbol + (f"[{', '.join(map(shape, tree.callers))}]" if tree.callers else "")


@pytest.mark.parametrize(("depth", "expected"), [(0, "a"), (1, "a[b, c]"), (2, "a[b[c]]"), (3, "a[b[c[d]]]")])
def test_tree_lists_a_symbol_where_the_search_meets_it(calls, depth, expected):
    tree = traverse.impact_tree(calls, "a", depth, ["n"])
    assert shape(tree) == expected
    assert tree.direct_callers == 2


@pytest.mark.parametrize(("depth", "expected"), [(0, {"a": 0}), (1, {"a": 0, "b": 1, "c": 1}), (2, {"a": 0, "b": 1, "c": 1, "d": 2}), (-1, {"a": 0, "b": 1, "c": 1, "d": 2})])
@pytest.mark.parametrize("few", [traverse.FEW, 2])
def test_closure_has_smallest_distances(calls, monkeypatch, depth, expected, few):
    monkeypatch.setattr(traverse, "FEW", few)
    assert {r["symbol"]: r["depth"] for r in traverse.impact_closure(calls, "a", depth).collect()} == expected


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=12))
def test_closures_grow_with_depth_and_hold_the_tree(spark, edges):
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(edges)], "from_fqn string, to_fqn string, n int")
    near, far = ({r["symbol"] for r in traverse.impact_closure(df, "a", d).collect()} for d in (1, 2))
    assert near <= far
    assert {r[2] for r in traverse.impact_tree(df, "a", 2, ["n"]).rows()} <= far


def usage(i, generated=False):
    folder = "/src-gen/" if generated else "/src/"
    return ("java", "java_method_call", f"file://{folder}c{i}.java", i, f"c{i}", "x", "m")


USAGE = "source string, usage_type string, caller_uri string, caller_line int, caller_symbol string, callee_symbol string, module string"


@pytest.mark.parametrize(("offset", "lines"), [(0, [0, 1]), (2, [3, 4]), (4, [5, 6]), (6, [])])
def test_pages_know_true_totals(spark, offset, lines):
    usages = spark.createDataFrame([usage(i, i == 2) for i in range(7)], USAGE)
    page = query.page(query.usages_of(usages, "x"), offset, 2)
    assert [r["caller_line"] for r in page.rows.collect()] == lines
    assert (page.total, page.has_more) == (6, offset < 4)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    once = mutate.upsert(old, new, ["k"], "v")
    assert sorted(once.collect()) == [("a", 1), ("b", 4), ("c", 5)] == sorted(mutate.upsert(once, new, ["k"], "v").collect())
    kept = mutate.insert_ignore(old, new, ["k"], "v", [])
    assert sorted(kept.collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_entities_come_from_the_last_package_and_others_from_the_first(spark):
    files = spark.createDataFrame([("E", "p", 1, True), ("E", "q", 2, True), ("N", "p", 1, False), ("N", "q", 2, False)], "relative_uri string, package string, package_order int, is_entity boolean")
    assert {(r["relative_uri"], r["package"]) for r in mutate.claim_files(files).collect()} == {("E", "q"), ("N", "p")}


def test_ordinals_are_global_and_without_gaps(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    found = [(r["a"], r["b"] if r["b"] is not None else -1) for r in mutate.ordinals(df, ["a", "b"]).orderBy("id").collect()]
    assert found == sorted(found) and len(found) == 500


def test_inverse_of_inverse(spark):
    edges = spark.createDataFrame([("f", "call", "g", "new", "p", "q", 3), ("f", "call", "h", None, "p", "q", None)], "from_fqn string, edge_type string, to_fqn string, kind string, from_package string, to_package string, from_line int")
    back = query.inverse(query.inverse(edges))
    assert [(r["from_fqn"], r["to_fqn"], r["from_package"]) for r in back.collect()] == [("f", "g", "p")]


def test_class_reader():
    tree = class_files.class_tree(M)
    assert (tree["fqn"], tree["is_entity"], tree["node_type"]) == ("a.db.M", True, "class")
    assert tree["inheritance"] == [{"fqn": "a.db.Base", "kind": "extends"}, {"fqn": "java.lang.Runnable", "kind": "implements"}]
    assert tree["fields"] == [{"type": "a.db.Base"}]
    run = next(m for m in tree["methods"] if m["fqn"] == "a.db.M.run()")
    assert [(c["to_fqn"], c["kind"]) for c in run["calls"]] == [("a.db.Base.make(long)", "standard"), ("a.db.M.run()", "standard"), ("a.db.M.<init>()", "new")]
    pick = next(m for m in tree["methods"] if ".pick" in m["fqn"])
    assert (pick["fqn"], pick["arguments"], pick["return_type"]) == ("a.db.M.pick(a.db.Base[], java.lang.String)", ["a.db.Base[]"], "a.db.Base")
    assert class_files.class_tree(b"") is None and class_files.class_tree(M[:200]) is None and class_files.class_tree(M, ["b."]) is None


def test_engine_reads_changed_packages_only(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "tables"))
    files = spark.createDataFrame([("p", "/p/M.class", M), ("q", "/q/Base.class", BASE)], "package string, path string, content binary")
    assert engine.ingest_classes(files) == ["p", "q"]
    before = {n: sorted(map(tuple, engine.table(n).collect()), key=repr) for n in ("nodes", "edges", "symbol_index")}
    assert ("a.db.M", "inheritance", "a.db.Base", "extends", "p", "q", None) in before["edges"]
    assert engine.ingest_classes(files) == []
    changed = spark.createDataFrame([("p", "/p/M.class", M), ("q", "/q/Base.class", BASE), ("p", "/p/N.txt", b"")], "package string, path string, content binary")
    assert engine.ingest_classes(changed) == ["p"]
    assert {n: sorted(map(tuple, engine.table(n).collect()), key=repr) for n in before} == before
    assert engine.sql("SELECT count(*) AS n FROM {nodes}").first()["n"] == len(before["nodes"])
    engine.drop_package("q")
    assert {r["package"] for r in engine.table("nodes").collect()} == {"p"}


def test_engine_answers(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    assert engine.call("find_callers", {"symbol": "a"})["results"] == []
    rows = [("java", "java_method_call", f"file:///s/{x}.java", i, x, y, "m") for i, (x, y) in enumerate(CALLS)]
    engine.add_usages(spark.createDataFrame([*rows, ("java", "java_declaration", "file:///s/a.java:3", None, None, "a", "m")], USAGE))
    found = engine.find_usages("a", depth=2)
    assert found["total"] == 3 and [r["caller_symbol"] for r in found["results"]] == [None, "b", "c"]
    assert [r["caller_symbol"] for r in found["results"][1]["children"]] == ["c"]
    text = render.usages_text("a", found)
    assert "declared in a.java:3" in text and "└── c (c.java:1)" in text
    impact = engine.call("impact_analysis", {"symbol": "a", "depth": 3})
    assert impact["callers"][0]["symbol"] == "b" and impact["pagination"]["total"] == 1
    assert render.impact_text(impact).splitlines()[0] == "a (2 usages)"
    assert engine.call("get_stats", {})["usage_type"] == {"java_method_call": 5, "java_declaration": 1}
    assert engine.call("nothing", {}) == {"error": "unknown tool: nothing", "tool": "nothing"}
    assert engine.call("find_callers", {"what": 1})["tool"] == "find_callers"


def test_callers_after_an_extraction(spark, tmp_path):
    """Calls and declarations of compiled classes answer, point to sources, and a second run changes nothing."""
    for name, content in {"modules/m/build/classes/a/M.class": renamed(b"a/xx/M"), "modules/m/build/classes/a/Base.class": BASE, "modules/m/src/main/java/a/xx/M.java": b"class M", "modules/web/a.tsx": b"const f = () => g();"}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(content)
    engine = Engine(spark, str(tmp_path / "t"))
    first = engine.extract(str(tmp_path / "src"), "full")
    found = engine.find_callers("a.db.Base.make(long)", limit=5)
    assert [(r["caller_symbol"], r["callee_kind"], r["module"]) for r in found["results"]] == [("a.xx.M.run()", "method", "m")] and not found["has_more"]
    assert engine.find_callees("a.xx.M.run()")["total"] == 3
    assert [r["caller_uri"] for r in engine.get_definition("a.xx.M")["results"]][0].endswith("/modules/m/src/main/java/a/xx/M.java")
    assert [c["symbol"] for c in engine.impact_analysis("a.db.Base.make(long)")["callers"]] == ["a.xx.M.run()"]
    assert engine.impact_analysis("a.db.Base.make(long)", only_custom=True)["callers"] == []
    before = {n: sorted(map(repr, engine.table(n).collect())) for n in ("usages", "nodes", "edges", "symbol_index")}
    again = engine.extract(str(tmp_path / "src"), "full")
    assert first["packages"] == ["m"] and again["packages"] == [] and again["total"] == first["total"]
    assert {n: sorted(map(repr, engine.table(n).collect())) for n in before} == before
    assert engine.extract(str(tmp_path / "src"), "full", reset=True, limit=1)["packages"] == ["m"]
    assert engine.table("nodes").where("type = 'class'").count() == 1
    assert Engine.detected(spark, str(tmp_path), ("none", "t", "u")).store.folder.endswith("/t") and Engine.detected(spark, str(tmp_path), ("none", "new")).store.folder.endswith("/new")


def test_a_class_comes_from_one_package(spark, tmp_path):
    """An entity from the last package, any other class from the first; a package that gave one up takes it back."""
    files = spark.createDataFrame([("p", 1, "/p/M.class", M), ("q", 2, "/q/M.class", M), ("p", 1, "/p/R.class", renamed(b"a/xx/M")), ("q", 2, "/q/R.class", renamed(b"a/xx/M"))], "package string, package_order int, path string, content binary")
    engine = Engine(spark, str(tmp_path / "t"))
    assert engine.ingest_classes(files.where("package = 'p'")) == ["p"]

    def owners():
        return {r["fqn"]: r["package"] for r in engine.table("symbol_index").where("fqn in ('a.db.M', 'a.xx.M')").collect()}

    assert owners() == {"a.db.M": "p", "a.xx.M": "p"}
    assert engine.ingest_classes(files) == ["p", "q"]  # q's entity is taken out of p
    assert owners() == {"a.db.M": "q", "a.xx.M": "p"} and engine.table("nodes").where("fqn = 'a.db.M.run()'").count() == 1
    assert engine.ingest_classes(files) == []
    less = files.where("path <> '/q/M.class'")
    assert engine.ingest_classes(less) == ["p", "q"] and owners() == {"a.db.M": "p", "a.xx.M": "p"}
    engine.drop_package("p")
    assert owners() == {} and engine.ingest_classes(less) == ["p", "q"]


def test_a_change_holds_all_at_once(spark, tmp_path):
    store = storage.Store(spark, str(tmp_path / "s"), {"a": ("k string, v int", [], ["k"]), "b": ("k string, part string", ["part"], ["k"])})
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, owner string")
    store.write({"a": rows(("x", 1, "o/1"), ("y", 2, "o2")), "b": spark.createDataFrame([("x", "l", "o2")], "k string, part string, owner string")})
    seen = store.read("a")
    (tmp_path / "s/a/batch=lost/owner=o2").mkdir(parents=True)  # what a change leaves that ended before its manifest
    store.write({"a": rows(("y", 3, "o2"))}, {"b": {"o2"}})
    assert sorted(map(tuple, store.read("a").collect())) == [("x", 1), ("y", 3)] and store.read("b").count() == 0 and store.owners("a") == {"o/1", "o2"}
    assert sorted(map(tuple, seen.collect())) == [("x", 1), ("y", 2)]  # a reader of the version before still can
    store.write({"a": rows(("z", 4, "o2"))})
    assert len(list((tmp_path / "s/a").glob("batch=*/owner=o2/*.parquet"))) == 2
    assert store.read("a", without={"o2"}).collect()[0]["k"] == "x"
    plan = store.read("b")._jdf.queryExecution().toString() if store.read("b").columns else ""
    store.reset()
    assert store.read("a").count() == 0 and plan


def test_stored_edges_are_read_by_type(spark, tmp_path):
    edges = spark.createDataFrame([(f"f{i}", ["call", "member_of"][i % 2], f"t{i}", None, "p", "p", 1, "p") for i in range(20)], "from_fqn string, edge_type string, to_fqn string, kind string, from_package string, to_package string, from_line int, owner string")
    engine = Engine(spark, str(tmp_path))
    engine.store.write({"edges": edges})
    plan = engine.table("edges").where("edge_type = 'call' and to_fqn = 't4'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(edge_type" in plan and "EqualTo(to_fqn,t4)" in plan


def test_long_chains_are_followed_to_their_end(spark, tmp_path):
    """More than fifty levels: no depth is cut."""
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}", 1) for i in range(52)], "from_fqn string, to_fqn string, n int").coalesce(1)
    found = {r["symbol"]: r["depth"] for r in traverse.impact_closure(chain, "n0", -1).collect()}
    assert found == {f"n{i}": i for i in range(53)}
    engine = Engine(spark, str(tmp_path))
    engine.add_usages(spark.createDataFrame([("java", "java_method_call", f"file:///{i}.java", 1, f"n{i + 1}", f"n{i}", "m") for i in range(52)], USAGE))
    level, depth = engine.find_usages("n0", depth=-1)["results"], 1
    while level := level[0].get("children"):
        depth += 1
    assert depth == 52
    assert "children" not in engine.find_usages("n0", depth=-1, max_depth=1)["results"][0]["children"][0]


def test_archives_of_a_listing(spark, tmp_path):
    import zipfile

    for name, content in (("core", M), ("web", BASE)):
        with zipfile.ZipFile(tmp_path / f"{name}.jar", "w") as z:
            z.writestr("a/db/X.class", content)
    lines = [f"AXELOR_DEP|com.axelor|{n}|1|{tmp_path}/{n}.jar|NONE" for n in ("core", "web")]
    listing = listings.parse_listing(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), place=True)
    files = listings.package_files(listing)
    assert {(r["package"], r["package_order"], r["path"]) for r in files.collect()} == {("web-1", 0, f"{tmp_path}/web.jar!/a/db/X.class"), ("core-1", 1, f"{tmp_path}/core.jar!/a/db/X.class")}
    engine = Engine(spark, str(tmp_path / "t"))
    assert engine.ingest_archives(listing, cache=str(tmp_path / "kept")) == ["core-1", "web-1"]
    (tmp_path / "core.jar").unlink()  # what is kept isn't opened again
    assert engine.ingest_archives(listing, cache=str(tmp_path / "kept")) == []
    (tmp_path / "r/build/classes/java/main").mkdir(parents=True)
    (tmp_path / "r/modules/m/build/classes/java/main").mkdir(parents=True)
    assert listings.build_folders(spark, str(tmp_path / "r")) == [str(tmp_path / "r/build/classes/java/main"), str(tmp_path / "r/modules/m/build/classes/java/main")]


def test_extract_reads_a_folder(spark, tmp_path):
    for name, content in {"modules/sales/f.xml": FORM.encode(), "modules/web/a.tsx": b"export const f = () => g();", "p/build/classes/a/M.class": M}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(content)
    engine, copy = Engine(spark, str(tmp_path / "t")), Engine(spark, str(tmp_path / "u"))
    done = engine.call("extract", {"folder": str(tmp_path / "src"), "mode": "full", "reset": True})
    assert done["packages"] == ["p"] and done["total"] == engine.table("usages").count() > 10
    sources = {r["source"]: r["n"] for r in query.sources_seeded(engine.table("usages")).collect()}
    assert sources["java"] == 8 and sources["typescript"] == 2 and sources["xml"] > 10
    copy.copy_from(engine, 5)
    assert copy.table("usages").count() == 5
    assert "error" in engine.call("extract", {"folder": "/nowhere", "mode": "other"})


def test_best_file_of_a_class(spark):
    files = spark.createDataFrame([("/r/p/src/main/java/a/db/M.java",), ("/r/p/build/src-gen/java/a/db/M.java",), ("/r/p/src/main/java/a/S.java",)], "path string")
    symbols = spark.createDataFrame([("a.db.M", "old", "p", "a/db/M.class"), ("a.S", "old", "p", "a/S.class"), ("x.Y", "old", "q", "x/Y.class")], "fqn string, uri string, package string, relative_uri string")
    found = {r["fqn"]: r["uri"] for r in mutate.fix_uris(symbols, mutate.uri_candidates(files, symbols)).collect()}
    assert found == {"a.db.M": "file:///r/p/build/src-gen/java/a/db/M.java", "a.S": "file:///r/p/src/main/java/a/S.java", "x.Y": "old"}


def test_places_of_sources_by_rank(spark):
    """The project's generated sources, the module's, the module's own, those beside the classes, any."""
    paths = ["/r/build/src-gen/java/a/db/M.java", "/r/modules/m/build/src-gen/java/a/db/M.java", "/r/modules/m/build/src-gen/java/a/db/N.java", "/r/modules/m/src/main/java/a/S.java", "/r/modules/other/src/main/java/a/S.java", "/s/lib-2.0/sources/a/T.java", "/s/else/sources/a/T.java", "/x/src/main/java/a/U.java"]
    files = spark.createDataFrame([(x,) for x in paths], "path string")
    rows = [("a.db.M", "m-1.0"), ("a.db.N", "m-1.0"), ("a.S", "m-1.0"), ("a.S$In", "m-1.0"), ("a.T", "lib-2.0"), ("a.U", "lib-2.0"), ("a.V", "lib-2.0")]
    symbols = spark.createDataFrame([(f, "old", p, f.replace(".", "/") + ".class") for f, p in rows], "fqn string, uri string, package string, relative_uri string")
    found = {r["fqn"]: r["uri"] for r in mutate.fix_uris(symbols, mutate.uri_candidates(files, symbols)).collect()}
    expected = {"a.db.M": paths[0], "a.db.N": paths[2], "a.S": paths[3], "a.S$In": paths[3], "a.T": paths[5], "a.U": paths[7]}
    assert found == {f: f"file://{x}" for f, x in expected.items()} | {"a.V": "old"}


def test_stream_ingests_what_arrives(spark, tmp_path):
    (tmp_path / "in/p/classes").mkdir(parents=True)
    (tmp_path / "in/p/classes/M.class").write_bytes(M)
    engine = Engine(spark, str(tmp_path / "t"))
    for _ in range(2):
        streaming.ingest_stream(spark, str(tmp_path / "in"), engine, str(tmp_path / "at")).awaitTermination()
    assert engine.table("nodes").where("fqn = 'a.db.M'").count() == 1


FORM = """<object-views xmlns="http://example.org/views"><form name="f" model="a.M">
<field name="x.y" onChange="go, b.C:m" target="a.T"/><button name="k" onClick="save"/><button name="l" onClick="b.C:n"/>
<panel-related field="ls" grid-view="g"><field name="n"/></panel-related><panel-related field="ms"><field name="o"/></panel-related>
<viewer depends="x, y">{{record.a}} {{b}} {record.c}</viewer></form>
<grid id="e" name="e" extension="true"><extend target="//p"><insert/><remove/></extend></grid>
<action-group name="ag"><action name="one"/><action name="two"/></action-group>
<action-method name="am"><call class="b.C" method="m"/></action-method>
<action-view name="av"><view type="grid" name="g"/></action-view></object-views>"""


def test_view_references():
    found = {}
    for kind, value, context in xml_views.references(FORM, {"g": "a.L"}):
        found.setdefault(kind, []).append((value, context))
    values = {k: [v for v, _ in x] for k, x in found.items()}
    assert values["inline_action_group"] == ["inline-group-f-x.y-onChange"] and values["inline_group_contains_action"] == ["go", "b.C:m"]
    assert values["xml_calls_java_method"] == ["m", "n", "m"] and values["xml_trigger_calls_action"] == ["save"]
    assert values["xml_action_called_by_trigger"] == ["f:k:onClick"]
    heads = [(v, c["model"], c["model_resolution"]) for v, c in found["model_referenced_by_field"]]
    assert heads == [("x", "a.T", "field_target"), ("y", "a.T", "tail_from_field_target"), ("ls", "a.M", "view"), ("n", "a.L", "panel_related_grid_view"), ("ms", "a.M", "view")]
    assert values["xml_viewer_field_ref"] == ["a", "b", "c"] and values["xml_viewer_depends"] == ["x", "y"]
    assert found["grid_extension"][0][1]["extend_operations"] == "insert,remove" and found["grid_extension"][0][1]["extend_targets"] == "//p"
    assert values["action_group_contains_action"] == ["one", "two"] and "action-group_definition" in values and "action_group_definition" in values
    assert found["xml_view_used_by_action_view"][0] == ("av", {"view_name": "g", "parent_action_name": "av", "view_type": "grid"})
    assert xml_views.references("<broken") == []


def test_view_files_to_usages(spark):
    files = spark.createDataFrame([("/r/modules/sales/f.xml", FORM.encode()), ("/r/build/f.xml", FORM.encode()), ("/r/x.xml", b"<")], "path string, content binary")
    rows = xml_views.usages(xml_views.extract(xml_views.xml_files(files))).collect()
    assert {r["module"] for r in rows} == {"sales"}
    assert "form_definition: f in module sales" in {r["document"] for r in rows}


def test_deep_views_and_large_maps(spark, monkeypatch):
    """A file of 5,000 levels, a map that is joined instead of collected, and a schema's own words."""
    deep = "<form name='d' model='m'>" + "<panel>" * 5000 + "<field name='x' onMine='go' whenIf='self.y'/>" + "</panel>" * 5000 + "</form>"
    assert ("field_references_model", "m") in {(k, v) for k, v, _ in xml_views.references(deep)}
    files = spark.createDataFrame([("/r/modules/sales/f.xml", FORM.encode()), ("/r/modules/s/d.xml", deep.encode())], "path string, content binary")
    views = spark.createDataFrame([("g", "a.L"), ("other", "a.O")], "view_name string, model string")
    words = spark.createDataFrame([("x", "events", "onMine"), ("x", "conditions", "whenIf"), ("x", "views", "form")], "path string, kind string, name string")
    few = sorted(map(str, xml_views.extract(files, views).collect()))
    monkeypatch.setattr(xml_views, "MOST_VIEWS", 1)
    assert sorted(map(str, xml_views.extract(files, views).collect())) == few and any("a.L" in x for x in few)
    kinds = {(r["ref_type"], r["ref_value"]) for r in xml_views.extract(files, None, words).where("module = 's'").collect()}
    assert ("xml_trigger_calls_action", "go") in kinds and ("xml_expression_field_ref", "y") in kinds
    broken = spark.createDataFrame([("a", b"<broken"), ("b", None)], "path string, content binary")
    assert listings.vocabularies(broken).count() == 0


@pytest.mark.parametrize("text", ["self.a == 1 && context.b != null && obj.c > 2", "", "naïve.été = x", "eval.a call.b"])
def test_expression_fields_agree_on_both_sides(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(fn.expression_fields(F.col("t")).alias("f"), fn.template_fields(F.lit("{{record.a}} {{b}} {record.c} {{true}}")).alias("g")).first()
    assert row["f"] == xml_views.expression_fields(text)
    assert row["g"] == ["a", "b", "c"]


def test_listing_archives_and_vocabulary(spark):
    import io
    import zipfile

    lines = ["AXELOR_DEP|com.axelor|core|1|/j/core.jar|NONE", " AXELOR_DEP|com.axelor|core|1|/j/other.jar|/s ", "AXELOR_DEP|com.axelor|web|2|/j/web.jar", "noise", "AXELOR_DEP|org.x|y|1|/a|/b"]
    found = listings.parse_listing(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()
    assert [(r["artifact"], r["jar"], r["sources"]) for r in found] == [("core", "/j/core.jar", None)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/M.class", M)
        z.writestr("readme.txt", "x")
    jars = spark.createDataFrame([("/j/a.jar", data.getvalue()), ("/j/b.jar", b"no")], "path string, content binary")
    assert [(r["member"], bytes(r["content"])) for r in listings.archive_members(jars).collect()] == [("a/M.class", M)]
    schema = '<s:schema xmlns:s="http://www.w3.org/2001/XMLSchema"><s:choice><s:element name="form"/><s:element name="action-view"/></s:choice><s:attribute name="onNew"/><s:attribute name="onOld" use="prohibited"/><s:attribute name="showIf"/></s:schema>'
    assert listings.vocabulary(schema) == {"events": ["onNew"], "conditions": ["showIf"], "views": ["form"], "actions": ["action-view"]}


def test_typescript_usages(spark):
    text = "import {f} from './m';\nfunction g() { f(); useX(); return <Comp/>; }\n// f()\n"
    files = spark.createDataFrame([("/r/src/a.tsx", text.encode()), ("/r/src/m.ts", b"export const f = () => 1;")], "path string, content binary")
    found = typescript.resolved(typescript.extract(files), files.select("path"))
    rows = {(r["usage_type"], r["caller_symbol"], r["callee_symbol"], r["callee_uri"]) for r in found.collect()}
    assert ("function_call", "g", "f", "/r/src/m.ts") in rows and ("hook_call", "g", "useX", None) in rows
    assert ("import", None, "f", "/r/src/m.ts") in rows and ("react_component", "g", "Comp", None) in rows and ("export", None, "f", "/r/src/m.ts") in rows
    both = {(r["usage_type"], r["path"], r["caller_symbol"], r["callee_symbol"], r["callee_uri"]) for r in typescript.both_ways(found).collect()}
    assert ("function_called_by", "/r/src/m.ts", "f", "g", "/r/src/a.tsx") in both


def test_typescript_kinds(spark):
    text = "interface I {}\ntype T = string;\nenum E { a }\nnamespace N {}\nclass C { m(x) { return x; }\n  private n() { if (x) { y(); } } }\nconst View = (p) => p;\nconst f = async (a: T): T => a;\nconst g = function () {};\nconst k = (1 + 2);\nfunction h() { f(); }\nconst one = x => x;"
    found = {n: (k, line) for n, k, line in typescript.declared(text)}
    assert found == {"I": ("interface", 1), "T": ("type", 2), "E": ("enum", 3), "N": ("namespace", 4), "C": ("class", 5), "m": ("method", 5), "n": ("method", 6), "View": ("component", 7), "f": ("function", 8), "g": ("function", 9), "k": ("const", 10), "h": ("function", 11), "one": ("function", 12)}
    files = spark.createDataFrame([("/r/a.tsx", b"import {f} from './m';\nfunction g() { f(); useX(); }"), ("/r/m.ts", b"\nexport const f = () => 1;")], "path string, content binary")
    used = typescript.with_kinds(typescript.resolved(typescript.extract(files), files.select("path")), typescript.declarations(files))
    rows = {(r["usage_type"], r["callee_symbol"], r["caller_kind"], r["callee_kind"], r["callee_line"]) for r in typescript.both_ways(used).collect()}
    assert ("function_call", "f", "function", "function", 2) in rows and ("hook_call", "useX", "function", "hook", None) in rows
    assert ("function_called_by", "g", "function", "function", 2) in rows
