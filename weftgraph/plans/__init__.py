"""The engine: stored tables of a dependency graph, their ingestion package by package, and questions to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schemas, storage
from ..operators import mutate, query, traverse
from ..sources import class_files, listings, typescript, xml_views
from . import render

# Names of stores, the one with embeddings first.
STORES = (".vector-semantic-db", ".vector-raw-db")
#: By table its schema, the partition columns behind the owner, and the order of rows inside them.
TABLES = {
    "symbol_index": (schemas.SYMBOLS, [], ["fqn"]),
    "index_metadata": (schemas.INDEX_METADATA, [], ["package"]),
    "overridden": (schemas.OVERRIDDEN, [], ["relative_uri"]),
    "nodes": (schemas.NODES, [], ["fqn"]),
    "edges": (schemas.EDGES, ["edge_type"], ["to_fqn", "from_fqn"]),
    "usages": (schemas.USAGES, ["usage_type"], ["callee_symbol", "caller_symbol"]),
}
#: Of these tables a package owns its rows; the metadata, a row per package, are one part.
OF_PACKAGES = ["symbol_index", "overridden", "nodes", "edges", "usages"]
UNKNOWN = "unknown"
# Fixed value: how names of modules of one's own begin.
CUSTOM_MODULES = "open-auction-"


class Engine:
    """A store below a folder, and what can be asked of it. Tables that aren't written yet are empty."""

    def __init__(self, spark: SparkSession, folder: str, custom_modules: str = CUSTOM_MODULES):
        self.spark, self.custom_modules = spark, custom_modules
        self.store = storage.Store(spark, folder, TABLES)
        self.tools: dict[str, Callable[..., object]] = {
            "find_usages": self.find_usages,
            "raw_usages": self.raw_usages,
            "get_definition": self.get_definition,
            "find_callers": self.find_callers,
            "find_callees": self.find_callees,
            "impact_analysis": self.impact_analysis,
            "search_by_file": self.search_by_file,
            "get_stats": self.get_stats,
            "extract": self.extract,
        }

    @classmethod
    def detected(cls, spark: SparkSession, base: str, names: tuple[str, ...] = STORES, **options) -> Engine:
        """The first store of those names that exists below a folder; else the last name, which an extraction then fills."""
        base = base.rstrip("/")
        found = [n for n in names if storage.exists(spark, f"{base}/{n}/_manifest")]
        return cls(spark, f"{base}/{(found or names[-1:])[0]}", **options)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables, by their names in braces: SELECT count(*) FROM {nodes}."""
        return self.spark.sql(text, **{n: self.table(n) for n in TABLES if f"{{{n}}}" in text})

    def reset(self) -> None:
        self.store.reset()

    # Ingestion.

    def ingest_classes(self, files: DataFrame, domains: list[str] | None = None, sources: DataFrame | None = None, limit: int | None = None) -> list[str]:
        """Brings packages of class files (package, path, content) up to date; returns those that were read anew.

        files: whole packages, with package_order if their order matters; else it is that of their names. Only packages
        whose content differs from what was indexed are read, and those from whose files a changed package takes a class
        or gives one up: of a class in several packages, an entity comes from the last and any other from the first. Rows of
        a package are replaced as a whole, so that a second run changes nothing. sources: paths of source files, which
        symbols then point to. limit: read so many files at most, the first by path. Names of packages go to the driver;
        there are as many as jars.
        """
        if limit is not None:
            files = listings.first_files(files, limit)
        files = files.withColumn("package", F.coalesce(F.nullif("package", F.lit("")), F.lit(UNKNOWN)))
        if "package_order" not in files.columns:
            files = files.withColumn("package_order", F.lit(None).cast("int"))
        hashes = mutate.content_hashes(files.withColumn("name", F.col("path"))).join(files.groupBy("package").agg(F.min("package_order").alias("package_order")), "package")
        hashes = storage.staged(hashes)
        given = {r["package"]: r["package_order"] for r in hashes.select("package", "package_order").collect()}
        todo = {r["package"] for r in mutate.changed_packages(hashes, self.table("index_metadata")).select("package").collect()}
        if not todo:
            return []
        names = self.spark.createDataFrame([(p,) for p in sorted(todo)], "by_package string")
        todo |= {r["package"] for r in self.table("overridden").join(names, "by_package", "left_semi").select("package").distinct().collect()} & given.keys()
        order = self._package_order(given)
        while True:
            trees, claims = self._claimed(files, sorted(todo), order, domains)
            lost = {r["package"] for r in claims.where("stored and package <> by_package").select("package").distinct().collect()} & given.keys() - todo
            if not lost:
                break
            todo |= lost
        self._store_classes(trees, claims.where("not stored"), hashes, todo, sources)
        return sorted(todo)

    def _package_order(self, given: dict[str, int | None]) -> DataFrame:
        """A place for each package that is given or stored: by package_order, those without one last, then by name."""
        known = {r["package"]: r["package_order"] for r in self.table("index_metadata").select("package", "package_order").collect()} | given
        ordered = sorted(known, key=lambda p: (known[p] is None, known[p] or 0, p))
        return self.spark.createDataFrame([(p, i) for i, p in enumerate(ordered)], "package string, package_order int")

    def _claimed(self, files: DataFrame, todo: list[str], order: DataFrame, domains: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """Class trees of packages, without classes that another package has; and the claims (relative_uri, package, by_package, stored)."""
        wanted = files.join(self.spark.createDataFrame([(p,) for p in todo], "package string"), "package", "left_semi")
        trees = class_files.class_trees(wanted, domains)
        trees = storage.staged(class_files.with_relative_uri(class_files.without_enums(trees)))
        mine = trees.select("relative_uri", "package", "is_entity").distinct().withColumn("stored", F.lit(False))
        held = self.store.read("symbol_index", without=set(todo)).select("relative_uri", "package", "is_entity").distinct().withColumn("stored", F.lit(True))
        every = mine.unionByName(held.join(mine, "relative_uri", "left_semi")).join(order, "package")
        winners = mutate.claim_files(every).select("relative_uri", F.col("package").alias("by_package"))
        claims = storage.staged(every.join(winners, "relative_uri").select("relative_uri", "package", "by_package", "stored"))
        return trees.join(claims.where("package = by_package"), ["relative_uri", "package"], "left_semi"), claims

    def _store_classes(self, trees: DataFrame, claims: DataFrame, hashes: DataFrame, todo: set[str], sources: DataFrame | None) -> None:
        symbols = class_files.tree_symbols(trees, F.col("package")).dropDuplicates(["fqn", "package"])
        if sources is not None:
            symbols = mutate.fix_uris(symbols, mutate.uri_candidates(sources, symbols))
        symbols = storage.staged(symbols)
        known = self.store.read("symbol_index", without=todo).unionByName(symbols)
        mine = self.spark.createDataFrame([(p,) for p in sorted(todo)], "package string")
        stamp = hashes.join(mine, "package", "left_semi").withColumn("indexed_at", F.current_timestamp())
        metadata = self.table("index_metadata").join(mine, "package", "left_anti").unionByName(stamp)
        own = F.col("package")
        changes = {
            "symbol_index": symbols.withColumn("owner", own),
            "overridden": claims.where("package <> by_package").select("relative_uri", "package", "by_package", own.alias("owner")),
            "nodes": class_files.tree_nodes(trees, symbols).dropDuplicates(["fqn"]).withColumn("owner", own),
            "edges": class_files.tree_edges(trees, known),
            "usages": self._rows_of("usages", class_files.tree_usages(trees, known)),
            "index_metadata": metadata.withColumn("owner", F.lit("all")),
        }
        self.store.write(changes, {t: todo for t in OF_PACKAGES} | {"index_metadata": {"all"}})

    def _rows_of(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns and the owner; what is missing is null."""
        schema = self.store.schema(name)
        return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], "owner")

    def add_usages(self, rows: DataFrame, owner: Column | str = "added") -> None:
        """Adds rows of owners, in place of what these had before."""
        rows = rows.withColumn("owner", F.coalesce(owner if isinstance(owner, Column) else F.lit(owner), F.lit(UNKNOWN)))
        self.store.write({"usages": self._rows_of("usages", rows)})

    def ingest_views(self, files: DataFrame, view_map: DataFrame | None = None, vocabulary: DataFrame | None = None) -> None:
        """Adds the references of view files (path, content), which are whole modules, to the usages; vocabulary: as listings.vocabularies()."""
        found = xml_views.usages(xml_views.extract(xml_views.xml_files(files), view_map, vocabulary))
        self.add_usages(found, F.concat(F.lit("xml:"), "module"))

    def ingest_typescript(self, files: DataFrame) -> None:
        """Adds the usages of TypeScript files (path, content), which are whole modules, both ways, with imports resolved among the files."""
        found = typescript.extract(files)
        found = typescript.both_ways(typescript.with_kinds(typescript.resolved(found, files.select("path")), typescript.declarations(files)))
        found = found.withColumn("source", F.lit("typescript")).withColumn("module", fn.module_of_path(F.col("path")))
        self.add_usages(found.withColumnRenamed("path", "caller_uri"), F.concat(F.lit("typescript:"), "module"))

    def ingest_archives(self, listing: DataFrame, domains: list[str] | None = None, cache: str | None = None) -> list[str]:
        """Brings the packages of a dependency listing (artifact, version, jar) up to date, out of their archives; later lines come first.

        cache: a folder in which archives' members are kept, so that each is opened once.
        """
        files = listings.package_files(listing) if cache is None else listings.materialised(listing, cache)
        return self.ingest_classes(files, domains)

    def extract(self, folder: str, mode: str = "local", reset: bool = False, limit: int | None = None) -> dict:
        """Reads what lies below a folder: sources and views, and with mode `full` the classes, by package, as well."""
        if mode not in ("local", "full"):
            raise ValueError(f"unknown mode: {mode}")
        if reset:
            self.reset()
        schemas_found = listings.files(self.spark, folder, "object-views*.xsd")
        self.ingest_views(listings.files(self.spark, folder, "*.xml"), vocabulary=listings.vocabularies(schemas_found))
        self.ingest_typescript(listings.files(self.spark, folder, "*.ts").unionByName(listings.files(self.spark, folder, "*.tsx")))
        classes = listings.files(self.spark, folder, "*.class").withColumn("package", listings.package_of(F.col("path")))
        sources = listings.files(self.spark, folder, "*.java").select("path")
        packages = self.ingest_classes(classes, sources=sources, limit=limit) if mode == "full" else []
        return {"mode": mode, "packages": packages, "total": self.table("usages").count()}

    def copy_from(self, other: Engine, limit: int | None = None) -> None:
        """Copies another engine's usages, the first ones in a settled order if limited, in place of an earlier copy."""
        self.add_usages(query.copied(other.table("usages"), limit), "copied")

    def drop_package(self, package: str) -> None:
        """Drops what a package owns, and edges of others to it."""
        edges = self.table("edges").where(F.col("to_package") == package)
        touched = {r["from_package"] for r in edges.select("from_package").distinct().collect()} - {package}
        kept = self.store.read("edges", without=self.store.owners("edges") - touched).where(F.col("to_package") != package)
        owner = F.when(F.col("edge_type") == "member_of", F.col("to_package")).otherwise(F.col("from_package"))
        losers = self.table("overridden").where(F.col("by_package") == package).select("package").distinct()  # to be read again
        metadata = self.table("index_metadata").where(F.col("package") != package).join(losers, "package", "left_anti")
        changes = {"edges": kept.withColumn("owner", owner), "index_metadata": metadata.withColumn("owner", F.lit("all"))}
        self.store.write(changes, {t: {package} | (touched if t == "edges" else set()) for t in OF_PACKAGES} | {"index_metadata": {"all"}})

    # Questions. Each returns a dict of bounded rows.

    def _page(self, df: DataFrame, offset: int, limit: int, order: list | None = None) -> dict:
        found = query.page(df, offset, limit, order)
        return {"results": [r.asDict(recursive=True) for r in found.rows.collect()], **found.info()}

    def find_usages(self, symbol: str, usage_type: str | None = None, module_filter: str | None = None, exclude_generated: bool = True, offset: int = 0, limit: int = 20, depth: int = 0, max_children_per_level: int = 10, max_depth: int | None = None) -> dict:
        """Usages of a symbol; with a depth, each caller carries its own callers, and a symbol is opened once.

        A depth below 0 goes on to the end, or to max_depth.

        A level is one query, whatever the number of its symbols; a page bounds the first and each row opens
        `max_children_per_level` at most.
        """
        usages = query.chosen(self.table("usages"), usage_type, module_filter, exclude_generated)
        out = self._page(usages.where(F.col("callee_symbol") == symbol), offset, limit)
        opened: set[str] = set()
        bounds = [x for x in (depth if depth >= 0 else None, max_depth) if x is not None]
        level, left = out["results"], min(bounds, default=-1)
        while left and (names := [n for n in dict.fromkeys(r["caller_symbol"] for r in level) if n and n not in opened]):
            opened |= set(names)
            found = query.first_usages_of_each(usages, names, max_children_per_level).orderBy("callee_symbol", "nth").collect()
            level, left = self._open(level, names, [r.asDict(recursive=True) for r in found]), left - 1
        return out

    @staticmethod
    def _open(rows: list[dict], names: list[str], found: list[dict]) -> list[dict]:
        """Hangs what was found under the first row of each caller; returns it as the next level."""
        waiting = set(names)
        for row in rows:
            if row["caller_symbol"] in waiting:
                waiting.remove(row["caller_symbol"])
                shown = [f for f in found if f["callee_symbol"] == row["caller_symbol"]]
                total = shown[0]["group_size"] if shown else 0
                row |= {"children": shown, "children_total": total, "children_displayed": len(shown), "children_truncated": total > len(shown)}
        for f in found:
            del f["nth"], f["group_size"]
        return found

    def raw_usages(self, symbol: str, usage_type: str | None = None, module_filter: str | None = None, exclude_generated: bool = True, offset: int = 0, limit: int = 20) -> dict:
        return self._page(query.usages_of(self.table("usages"), symbol, usage_type, module_filter, exclude_generated), offset, limit)

    def get_definition(self, symbol: str) -> dict:
        return {"results": [r.asDict(recursive=True) for r in query.definition(self.table("usages"), symbol).collect()]}

    def find_callers(self, symbol: str, offset: int = 0, limit: int = 20) -> dict:
        return self._page(query.callers(self.table("usages"), symbol), offset, limit)

    def find_callees(self, symbol: str, offset: int = 0, limit: int = 20) -> dict:
        return self._page(query.callees(self.table("usages"), symbol), offset, limit)

    def impact_analysis(self, symbol: str, depth: int = 2, only_custom: bool = False, module_filter: str | None = None, offset: int = 0, limit: int = 50) -> dict:
        """The tree of callers; module_filter keeps calls of modules whose name starts with it, only_custom those of one's own."""
        module_filter = module_filter or (self.custom_modules if only_custom else None)
        calls = self.table("usages").where(F.col("usage_type") == query.CALL)
        calls = calls.where(~fn.is_generated(F.col("caller_uri")))
        if module_filter:
            calls = calls.where(F.col("module").startswith(module_filter))
        edges = calls.select(F.col("caller_symbol").alias("from_fqn"), F.col("callee_symbol").alias("to_fqn"), "caller_line", "module", "caller_uri")
        tree = traverse.impact_tree(edges, symbol, depth, ["from_fqn", "caller_line", "module", "caller_uri"], limit=limit)
        total = len(tree.callers)
        tree.callers = tree.callers[offset : offset + limit]
        more = offset + limit < total
        return render.tree_dict(tree) | {"pagination": {"total": total, "offset": offset, "limit": limit, "has_more": more, "next_offset": offset + limit if more else None}}

    def search_by_file(self, file_path: str, offset: int = 0, limit: int = 50) -> dict:
        return self._page(query.in_file(self.table("usages"), file_path), offset, limit, ["sort_line", *query.USAGE_ORDER])

    def get_stats(self, module: str | None = None) -> dict:
        usages = self.table("usages")
        if module:
            usages = usages.where(F.col("module") == module)
        out: dict = {"total": usages.count(), "usage_type": {}, "source": {}, "module": {}}
        for r in query.histograms(usages).orderBy("dimension", F.desc("n"), "value").collect():
            out[r["dimension"]][r["value"]] = r["n"]
        return out

    def call(self, tool: str, arguments: dict) -> dict:
        """Runs a tool by name; whatever goes wrong comes back as an error of that tool."""
        if tool not in self.tools:
            return {"error": f"unknown tool: {tool}", "tool": tool}
        try:
            return self.tools[tool](**arguments)
        except Exception as e:  # a caller of tools gets all errors as data
            return {"error": str(e), "tool": tool}
