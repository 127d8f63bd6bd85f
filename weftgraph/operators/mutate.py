"""Changes to tables as DataFrames: what a table holds after them. storage.Store then holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import file_uri, module_of_artifact, simple_name
from ..storage import staged


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by `order`. A partial aggregate, not a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `new` replace those of their key; of several the last counts."""
    latest = last_of(new, keys, order).select(*old.columns)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str, required: list[str]) -> DataFrame:
    """Rows of `new` with unknown keys are added, of several the first; rows without a required value are dropped."""
    whole = new.dropna(subset=[*keys, *required])
    return old.unionByName(first_of(whole, keys, order).select(*old.columns).join(old.select(*keys), keys, "left_anti"))


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fqn, type, name, uri) of ends of edges that no node stands for: methods where their name has arguments or they call."""
    call = F.col("edge_type") == "call"
    callers = edges.select(F.col("from_fqn").alias("fqn"), call.alias("calls"))
    callees = edges.select(F.col("to_fqn").alias("fqn"), F.lit(False).alias("calls"))
    ends = callers.unionByName(callees).groupBy("fqn").agg(F.max("calls").alias("calls")).join(nodes.select("fqn"), "fqn", "left_anti")
    kind = F.when(F.col("calls") | F.col("fqn").contains("("), "method").otherwise("class")
    return ends.select("fqn", kind.alias("type"), simple_name(F.col("fqn")).alias("name"), F.lit("unknown").alias("uri"))


def without_package(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, package: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without a package; an edge goes if either end is in it."""
    other = F.col("package") != package
    return nodes.where(other), edges.where((F.col("from_package") != package) & (F.col("to_package") != package)), symbols.where(other)


def content_hashes(files: DataFrame) -> DataFrame:
    """(package, content_hash) of files (package, name, content): a hash per file first, then over those in order of names."""
    single = files.select("package", F.struct("name", F.sha2("content", 256).alias("digest")).alias("file"))
    listed = single.groupBy("package").agg(F.sort_array(F.collect_list("file")).alias("files"))
    text = F.array_join(F.transform("files", lambda x: F.concat_ws("\u0000", x["name"], x["digest"])), "\n")
    return listed.select("package", F.sha2(text, 256).alias("content_hash"))


def changed_packages(now: DataFrame, metadata: DataFrame) -> DataFrame:
    """Packages to index: those without a known hash and those whose hash differs."""
    known = metadata.select("package", F.col("content_hash").alias("known"))
    return now.join(known, "package", "left").where(~F.col("content_hash").eqNullSafe(F.col("known"))).drop("known")


def claim_files(files: DataFrame) -> DataFrame:
    """The package that a file's symbols come from, of files (relative_uri, package, package_order, is_entity): an entity's last, of others the first."""
    place = F.when(F.col("is_entity"), -F.col("package_order")).otherwise(F.col("package_order"))
    rank = F.row_number().over(Window.partitionBy("relative_uri").orderBy(F.col("is_entity").desc(), place))
    return files.withColumn("nth", rank).where("nth = 1").drop("nth")


def not_indexed(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that are to be read: entities always, others only if no symbol of theirs is known."""
    known = symbols.select("relative_uri").distinct().withColumn("known", F.lit(True))
    return files.join(known, "relative_uri", "left").where(F.col("is_entity") | F.col("known").isNull()).drop("known")


def indexed_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files (relative_uri, package) of which symbols are known: those that an analysis reads."""
    return files.join(symbols, ["relative_uri", "package"], "left_semi")


def fix_uris(symbols: DataFrame, candidates: DataFrame) -> DataFrame:
    """Symbols with the uri of the best ranked of their candidates (relative_uri, rank, uri, and package if it matters), or their own."""
    keys = [k for k in ("relative_uri", "package") if k in candidates.columns]
    best = candidates.groupBy(*keys).agg(F.min_by("uri", F.struct("rank", "uri")).alias("_uri"))
    return symbols.join(best, keys, "left").withColumn("uri", F.coalesce("_uri", "uri")).select(*symbols.columns)


# Where sources lie, below a project or one of its modules.
_MODULE, _MODULE_GENERATED = r"^.*?/modules/([^/]+)/src/main/java/(.+)\.java$", r"^.*?/modules/([^/]+)/build/src-gen/java/(.+)\.java$"
_GENERATED, _SOURCES, _MAIN = r"^.*?/()(?:build/src-gen/java|src-gen)/(.+)\.java$", r"^(?:.*/)?([^/]+)/sources/(.+)\.java$", r"^.*?/()src/(?:main/java/)?(.+)\.java$"


def uri_candidates(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(relative_uri, package, rank, uri) of source files (path) for symbols, best first.

    Classes of a persisted model: the project's generated sources, then those of the module. All: the sources of the module
    that the package is called after, those that lie beside a package's classes, then any under src.
    """
    roots = [("generated", _GENERATED), ("module_generated", _MODULE_GENERATED), ("module", _MODULE), ("sources", _SOURCES), ("main", _MAIN)]
    found = F.array(*[F.struct(F.lit(name).alias("root"), F.regexp_extract("path", x, 1).alias("place"), F.regexp_extract("path", x, 2).alias("class")) for name, x in roots])
    known = files.select("path", F.explode(found).alias("f")).select("path", "f.*").where("class <> ''")
    known = known.where("root <> 'generated' or path not like '%/modules/%/build/%'")
    wanted = symbols.select("relative_uri", "package").distinct()
    # An inner class lies in the file of the outer one.
    wanted = wanted.withColumn("class", F.regexp_extract("relative_uri", r"^(.*?)(\$[^/]*)?\.class$", 1))
    persisted, module = F.col("class").contains("/db/"), module_of_artifact(F.col("package"))
    rank = (
        F.when((F.col("root") == "generated") & persisted, 0)
        .when((F.col("root") == "module_generated") & persisted & (F.col("place") == module), 1)
        .when((F.col("root") == "module") & (F.col("place") == module), 2)
        .when((F.col("root") == "sources") & (F.col("place") == F.col("package")), 3)
        .when(F.col("root") == "main", 4)
    )
    hits = wanted.join(known, "class").withColumn("rank", rank).where("rank is not null")
    return hits.select("relative_uri", "package", "rank", file_uri(F.col("path"), F.lit(None).cast("int")).alias("uri"))


def ordinals(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Numbers from 1 in a global order, nulls first, without bringing all rows to one task.

    Rows are range-sorted and staged with the number of their partition; the partitions' counts, a row each, give where
    each begins.
    """
    keys: list[Column] = [F.col(c).asc_nulls_first() for c in order]
    parts = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + inside).drop("_part", "_begin")
