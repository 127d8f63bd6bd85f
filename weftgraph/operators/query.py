"""Lookups over usages and edges, with pages that know their true totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..schemas import USAGE_ORDER

CALL, DECLARATION = "java_method_call", "java_declaration"


@dataclass
class Page:
    rows: DataFrame
    total: int
    offset: int
    limit: int

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total

    @property
    def next_offset(self) -> int | None:
        return self.offset + self.limit if self.has_more else None

    def info(self) -> dict:
        return {"total": self.total, "offset": self.offset, "limit": self.limit, "has_more": self.has_more, "next_offset": self.next_offset}


def slice_rows(df: DataFrame, offset: int, limit: int, order: list | None = None) -> DataFrame:
    """A page in a settled order: a top-k, so that each task sends `offset + limit` rows at most."""
    return df.orderBy(*(order or USAGE_ORDER)).offset(offset).limit(limit)


def page(df: DataFrame, offset: int, limit: int, order: list | None = None) -> Page:
    return Page(slice_rows(df, offset, limit, order), df.count(), offset, limit)


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """total, has_more and next_offset as a row, counted where the page is."""
    more = F.lit(offset + limit) < F.col("total")
    return df.agg(F.count("*").alias("total")).select("total", more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset"))


def chosen(usages: DataFrame, usage_type: str | None = None, module: str | None = None, exclude_generated: bool = True) -> DataFrame:
    """Usages of a type and a module, if given; callers in generated files are left out unless asked for."""
    kept: Column = F.lit(True)
    if usage_type:
        kept &= F.col("usage_type") == usage_type
    if module:
        kept &= F.col("module") == module
    if exclude_generated:
        kept &= ~fn.is_generated(F.col("caller_uri"))
    return usages.where(kept)


def usages_of(usages: DataFrame, symbol: str, usage_type: str | None = None, module: str | None = None, exclude_generated: bool = True) -> DataFrame:
    """Usages of a symbol, narrowed as by chosen()."""
    return chosen(usages.where(F.col("callee_symbol") == symbol), usage_type, module, exclude_generated)


def first_usages_of_each(usages: DataFrame, symbols: list[str], n: int) -> DataFrame:
    """The first n usages of each symbol in one query, with nth and the total of its symbol."""
    asked = usages.sparkSession.createDataFrame([(s,) for s in symbols], "callee_symbol string")
    return first_per_group(usages.join(asked, "callee_symbol", "left_semi"), "callee_symbol", USAGE_ORDER, n)


def definition(usages: DataFrame, symbol: str) -> DataFrame:
    return slice_rows(usages.where((F.col("callee_symbol") == symbol) & (F.col("usage_type") == DECLARATION)), 0, 100)


def callers(usages: DataFrame, symbol: str) -> DataFrame:
    return usages_of(usages, symbol, CALL)


def callees(usages: DataFrame, symbol: str) -> DataFrame:
    return usages.where((F.col("caller_symbol") == symbol) & (F.col("usage_type") == CALL))


def in_file(usages: DataFrame, part: str) -> DataFrame:
    """Usages whose caller's file contains `part`; sort by line, with unknown lines as 0."""
    return usages.where(F.col("caller_uri").contains(part)).withColumn("sort_line", F.coalesce("caller_line", F.lit(0)))


def outdated(usages: DataFrame, version: str, by_strategy: bool = True, by_model: bool = False) -> DataFrame:
    """Entries of another document strategy or, if asked for, without an embedding; none if neither is asked for."""
    kept: Column = F.lit(False)
    if by_strategy:
        kept |= ~F.col("document_strategy_version").eqNullSafe(version)
    if by_model:
        kept |= F.col("embedding_model_name") == "none"
    return usages.where(kept)


def edge_usages(edges: DataFrame, nodes: DataFrame, symbol: str, edge_type: str = "call", limit: int = 100) -> DataFrame:
    """Edges to a symbol, by full name or as the last part of one, with what is known of their origin."""
    hit = (F.col("to_fqn") == symbol) | fn.ends_with_name(F.col("to_fqn"), symbol)
    found = edges.where((F.col("edge_type") == edge_type) & hit)
    known = nodes.select(F.col("fqn").alias("from_fqn"), F.col("type").alias("from_type"), F.col("visibility").alias("from_visibility"))
    return found.join(known, "from_fqn", "left").orderBy("from_fqn", "to_fqn", "from_line", "kind").limit(limit)


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, with nth and the size of the group."""
    by_group = Window.partitionBy(group)
    ranked = df.withColumn("nth", F.row_number().over(by_group.orderBy(*order)))
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    return ranked.where(F.col("nth") <= n).join(sizes, group)


def histograms(usages: DataFrame) -> DataFrame:
    """(dimension, value, n) of usage types, sources and modules in one pass; unnamed modules are left out."""
    known = usages.select(F.coalesce("usage_type", F.lit("unknown")).alias("usage_type"), F.coalesce("source", F.lit("java")).alias("source"), F.coalesce("module", F.lit("")).alias("module"))
    sets = known.groupingSets([[F.col("usage_type")], [F.col("source")], [F.col("module")]], F.col("usage_type"), F.col("source"), F.col("module"))
    counted = sets.agg(F.count("*").alias("n"), F.grouping("usage_type").alias("a"), F.grouping("source").alias("b"))
    dimension = F.when(F.col("a") == 0, "usage_type").when(F.col("b") == 0, "source").otherwise("module")
    out = counted.select(dimension.alias("dimension"), F.coalesce("usage_type", "source", "module").alias("value"), "n")
    return out.where((F.col("dimension") != "module") | (F.col("value") != ""))


def sources_seeded(usages: DataFrame, sources: tuple[str, ...] = ("java", "xml", "typescript")) -> DataFrame:
    """Counts by source; the known ones are listed even where they have none."""
    seed = usages.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    counted = usages.groupBy("source").agg(F.count("*").alias("n"))
    return seed.join(counted, "source", "full_outer").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def embedding_health(usages: DataFrame) -> DataFrame:
    """Entries with and without an embedding, and the percentage of those with one."""
    with_model = F.coalesce(F.col("embedding_model_name"), F.lit("none")) != "none"
    counted = usages.agg(F.count("*").alias("total"), F.count_if(with_model).alias("embedded"))
    share = F.when(F.col("total") > 0, F.round(100.0 * F.col("embedded") / F.col("total"), 1)).otherwise(0.0)
    return counted.select("total", "embedded", (F.col("total") - F.col("embedded")).alias("missing"), share.alias("percent"))


def package_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("package").agg(F.count("*").alias("symbols"), F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type") == "method").alias("methods"))


def inverse(edges: DataFrame) -> DataFrame:
    """Edges read from the other end; only those whose far end has a name and a line."""
    kinds = {"call": "called_by", "inheritance": "inherited_by", "member_of": "contains"}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    known = edges.where("to_fqn is not null and from_line > 0")
    return known.select(F.col("to_fqn").alias("from_fqn"), named[F.col("edge_type")].alias("edge_type"), F.col("from_fqn").alias("to_fqn"), "kind", F.col("to_package").alias("from_package"), F.col("from_package").alias("to_package"), "from_line")


def with_packages(edges: DataFrame, symbols: DataFrame, project: str | None = None) -> DataFrame:
    """Edges with the packages of both ends by the symbol index: unknown ends drop an edge, or belong to `project` if given."""
    known = symbols.select("fqn", "package").distinct()
    how = "inner" if project is None else "left"
    out = edges.drop("from_package", "to_package")
    for end in ("from", "to"):
        out = out.join(known.select(F.col("fqn").alias(f"{end}_fqn"), F.col("package").alias(f"{end}_package")), f"{end}_fqn", how)
        if project is not None:
            out = out.withColumn(f"{end}_package", F.coalesce(f"{end}_package", F.lit(project)))
    return out


def class_trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with their methods, and those with their calls, out of flat nodes and edges."""
    calls = edges.where("edge_type = 'call'").groupBy(F.col("from_fqn").alias("method")).agg(F.sort_array(F.collect_list(F.struct("to_fqn", "kind", "from_line"))).alias("calls"))
    methods = nodes.where("type = 'method'").select(F.col("fqn").alias("method"), "line", fn.class_of_method(F.col("fqn")).alias("fqn"))
    empty = F.array().cast("array<struct<to_fqn: string, kind: string, from_line: int>>")
    methods = methods.join(calls, "method", "left").groupBy("fqn").agg(F.sort_array(F.collect_list(F.struct("method", "line", F.coalesce("calls", empty).alias("calls")))).alias("methods"))
    return nodes.where("type = 'class'").select("fqn", "package").join(methods, "fqn", "left")


# What is asked of nodes, symbols and edges.


def named_like(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(fn.contains_text(F.col("fqn"), text))


def edges_to_name(edges: DataFrame, name: str) -> DataFrame:
    """Edges to symbols that end with a dotted name."""
    return edges.where(fn.ends_with_name(F.col("to_fqn"), name))


def among(df: DataFrame, wanted: DataFrame, key: str = "fqn") -> DataFrame:
    """Rows whose key is among the wanted: a join, however many there are."""
    return df.join(wanted.select(key), key, "left_semi")


def methods_where(nodes: DataFrame, flag: str) -> DataFrame:
    """Methods with a property, such as is_transactional or has_override."""
    return nodes.where((F.col("type") == "method") & F.col(flag))


def public_overrides(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("visibility") == "public") & F.col("has_override"))


def methods_taking(edges: DataFrame, name: str) -> DataFrame:
    """What has an argument of a type, in order of names."""
    mine = (F.col("edge_type") == "member_of") & (F.col("kind") == "argument") & (F.col("from_fqn") == name)
    return edges.where(mine).select("to_fqn").distinct().orderBy("to_fqn")


def find_node(nodes: DataFrame, fqn: str) -> DataFrame:
    return nodes.where(F.col("fqn") == fqn).limit(1)


def resolve_uri(symbols: DataFrame, fqn: str, packages: list[str] | None = None) -> DataFrame:
    """Where a symbol lies, if it is in one of the packages; these are a caller's few."""
    allowed = F.col("package").isin(packages) if packages is not None else F.lit(True)
    return symbols.where((F.col("fqn") == fqn) & allowed).select("uri").limit(1)


def indexed_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose target is indexed."""
    return edges.join(symbols.select(F.col("fqn").alias("to_fqn")), "to_fqn", "left_semi").select(*edges.columns)


def brief_callers(usages: DataFrame, symbol: str, n: int, *without: str) -> DataFrame:
    """The first n callers, without wide columns."""
    return slice_rows(callers(usages, symbol), 0, n).drop(*without)


def annotations(nodes: DataFrame) -> DataFrame:
    """(fqn, annotation): a row for each annotation of a node that is recorded."""
    notes = F.array_compact(F.array(F.when(F.col("is_transactional"), F.lit("Transactional")), F.when(F.col("has_override"), F.lit("Override"))))
    return nodes.select("fqn", F.explode(notes).alias("annotation"))


def known_members(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fqn, indexed_members, unknown_members) of classes: methods with and without a package."""
    members = edges.where("edge_type = 'member_of' and kind = 'method'").select(F.col("to_fqn").alias("fqn"), F.col("from_fqn").alias("member"))
    known = symbols.select(F.col("fqn").alias("member"), F.lit(True).alias("known"))
    found = nodes.where("type = 'class'").select("fqn").join(members, "fqn", "left").join(known, "member", "left")
    return found.groupBy("fqn").agg(F.count("known").alias("indexed_members"), F.count_if(F.col("member").isNotNull() & F.col("known").isNull()).alias("unknown_members"))


def first_known(df: DataFrame, key: str, value: str, *maps: DataFrame) -> DataFrame:
    """df with a value looked up by key in maps (key, value), the first map that has it counting: a global one, then a file's own."""
    for i, known in enumerate(maps):
        df = df.join(known.select(key, F.col(value).alias(f"_{i}")), key, "left")
    return df.withColumn(value, F.coalesce(*[F.col(f"_{i}") for i in range(len(maps))])).drop(*[f"_{i}" for i in range(len(maps))])


# Aggregates.


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of tables."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def kinds(nodes: DataFrame, *by: str) -> DataFrame:
    """Numbers of classes and methods, of all or by columns."""
    return nodes.groupBy(*by).agg(F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type") == "method").alias("methods"))


def tally(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values by falling count, ties by value."""
    found = tally(df, column).orderBy(F.desc("n"), column)
    return found if n is None else found.limit(n)


def listed(df: DataFrame, group: str, place: list[str], value: str, name: str, total: str) -> DataFrame:
    """The values of each group in order of their place, joined by commas, and how many there are."""
    grouped = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*place, F.col(value).cast("string").alias("_value")))).alias("_all"))
    return grouped.select(group, F.array_join(F.transform("_all", lambda x: x["_value"]), ",").alias(name), F.size("_all").cast("long").alias(total))


def methods_of_classes(edges: DataFrame) -> DataFrame:
    members = edges.where("edge_type = 'member_of' AND kind = 'method'").select(F.col("to_fqn").alias("fqn"), "from_fqn")
    return listed(members, "fqn", ["from_fqn"], "from_fqn", "methods", "n").drop("n")


def nested_sums(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Classes, methods and calls of each package."""
    made = calls.groupBy(F.col("from_fqn").alias("fqn")).agg(F.count("*").alias("c"))
    kinds_of = [F.count_if(F.col("type") == t).alias(n) for t, n in (("class", "classes"), ("method", "methods"))]
    return nodes.join(made, "fqn", "left").groupBy("package").agg(*kinds_of, F.sum(F.coalesce("c", F.lit(0))).alias("calls"))


def package_links(edges: DataFrame) -> DataFrame:
    return edges.select("from_package", "to_package").distinct()


def last_and_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias("last"), F.min_by(value, order).alias("first"))


def names_of(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The sorted distinct values of each group."""
    return df.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias(name))


def union_of_matches(df: DataFrame, group: str, matches: list[Column], name: str) -> DataFrame:
    """The sorted distinct matches of each group, of several kinds."""
    sets = df.groupBy(group).agg(*[F.collect_set(m).alias(f"_{i}") for i, m in enumerate(matches)])
    every = reduce(F.array_union, [F.col(f"_{i}") for i in range(len(matches))])
    return sets.select(group, F.array_join(F.sort_array(every), ",").alias(name))


def union_of(*extracted: DataFrame) -> DataFrame:
    """Rows of several extractors; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), extracted)


def package_shares(nodes: DataFrame) -> DataFrame:
    """(package, per_thousand) of all nodes."""
    total = nodes.agg(F.count("*").alias("total"))
    counted = nodes.groupBy("package").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return counted.select("package", fn.per_thousand(F.col("n"), F.col("total")).alias("per_thousand"))


def copied(usages: DataFrame, n: int | None = None) -> DataFrame:
    """All usages, or the first n in a settled order."""
    return usages if n is None else slice_rows(usages, 0, n)
