"""Dependency listings, archives, schema vocabularies and view caches as DataFrames."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import first_of

# The form of a listing's lines, and what stands for no sources.
LISTING_PREFIX, LISTING_GROUP, NO_SOURCES = "AXELOR_DEP|", "com.axelor", "NONE"
_SCHEMA = "{http://www.w3.org/2001/XMLSchema}"


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files below a folder; their tasks are dealt out by Spark's reader."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.load(folder).select("path", "content")


def first_files(found: DataFrame, n: int) -> DataFrame:
    """The first n files by path; only paths are sorted."""
    first = found.select("path").orderBy("path").limit(n)
    return found.join(first, "path", "left_semi")


def package_of(path: Column) -> Column:
    """The folder below which a package's classes lie: the part in front of `/classes/`, or of `/build/classes/`."""
    return F.regexp_extract(path, r"([^/]+)/(?:build/)?classes/", 1)


# Where a build puts classes, in a project and in its modules.
BUILD_FOLDERS = ["build/classes/java/main", "modules/*/build/classes/java/main"]


def build_folders(spark: SparkSession, project: str) -> list[str]:
    """The folders of compiled classes that a project has, its own first."""
    out = []
    for pattern in BUILD_FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{project.rstrip('/')}/{pattern}")
        hits = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        out += sorted(h.getPath().toUri().getPath() for h in hits or [] if h.isDirectory())
    return out


def parse_listing(lines: DataFrame, prefix: str = LISTING_PREFIX, group: str = LISTING_GROUP, place: bool = False) -> DataFrame:
    """(group, artifact, version, jar, sources) of listing lines (value); of equal coordinates the first line counts.

    place: keep the column `nth`, which grows with the lines.
    """
    parts = F.split(F.trim("value"), r"\|")
    named = lines.withColumn("nth", F.monotonically_increasing_id()).where(F.trim("value").startswith(prefix) & (F.size(parts) == 6))
    columns = [parts[i].alias(c) for i, c in enumerate(("group", "artifact", "version", "jar", "sources"), 1)]
    found = named.select("nth", *columns).where(F.col("group").startswith(group))
    first = first_of(found, ["group", "artifact", "version"], "nth")
    first = first if place else first.drop("nth")
    return first.withColumn("sources", F.nullif("sources", F.lit(NO_SOURCES)))


def archive_members(archives: DataFrame, pattern: str = r".*\.class") -> DataFrame:
    """(path, member, content) of members of archives (path, content); one that can't be read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if wanted.fullmatch(name):
                        try:
                            data = archive.read(name)
                        except (zipfile.BadZipFile, zlib.error):
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([data], pa.binary())], ["path", "member", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def package_files(listing: DataFrame) -> DataFrame:
    """(package, package_order, path, content) of the classes in a listing's archives (artifact, version, jar); later lines come first.

    A listing has a row per dependency; its paths go to the driver, which hands them to Spark's reader.
    """
    spark, order = listing.sparkSession, [F.desc("nth")] if "nth" in listing.columns else ["artifact", "version"]
    rows = listing.orderBy(*order).select(F.concat_ws("-", "artifact", "version").alias("package"), "jar").collect()
    if not rows:
        return spark.createDataFrame([], "package string, package_order int, path string, content binary")
    plain = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
    known = spark.createDataFrame([(r["package"], i, r["jar"]) for i, r in enumerate(rows)], "package string, package_order int, jar string")
    read = spark.read.format("binaryFile").load(sorted({r["jar"] for r in rows})).select("path", "content")
    members = archive_members(read).withColumn("jar", plain)
    joined = members.join(known.withColumn("jar", F.regexp_replace("jar", "^[a-z]+:(//[^/]*)?(?=/)", "")), "jar")
    return joined.select("package", "package_order", F.concat("jar", F.lit("!/"), "member").alias("path"), "content")


def materialised(listing: DataFrame, folder: str) -> DataFrame:
    """As package_files, kept in a folder: only archives of packages that it doesn't hold yet are opened."""
    spark, schema = listing.sparkSession, "package_order int, path string, content binary, package string"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    kept = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    new = listing.withColumn("package", F.concat_ws("-", "artifact", "version")).join(kept.select("package").distinct(), "package", "left_anti").drop("package")
    package_files(new).select("package_order", "path", "content", "package").write.mode("append").partitionBy("package").parquet(folder)
    named = listing.select(F.concat_ws("-", "artifact", "version").alias("package")).distinct()
    return spark.read.schema(schema).parquet(folder).join(named, "package", "left_semi")


def view_cache(spark: SparkSession, path: str) -> DataFrame:
    """(view_name, model) of a JSON file that maps one to the other."""
    return mapped(spark.read.text(path, wholetext=True), "value")


def mapped(texts: DataFrame, column: str, *kept: str) -> DataFrame:
    """(view_name, model) of JSON objects, with other columns."""
    return texts.select(*kept, F.explode(F.from_json(column, "map<string,string>")).alias("view_name", "model"))


# Parts of attributes that hold conditions and expressions.
CONDITION_PARTS = ("If", "domain", "target", "expr", "value")


def vocabulary(text: str | bytes) -> dict[str, list[str]]:
    """Names that an XML schema declares: events, conditions, views and actions, sorted; none of one that isn't well-formed."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return {}
    allowed = [a.get("name", "") for a in root.iter(f"{_SCHEMA}attribute") if a.get("use") != "prohibited"]
    elements = [e.get("name", "") for c in root.iter(f"{_SCHEMA}choice") for e in c.findall(f"{_SCHEMA}element")]
    chosen = {
        "events": [a for a in allowed if a.startswith("on")],
        "conditions": [a for a in allowed if any(x in a for x in CONDITION_PARTS)],
        "views": [e for e in elements if e and not e.startswith(("action-", "menuitem"))],
        "actions": [e for e in elements if e.startswith("action-")],
    }
    return {k: sorted(set(v)) for k, v in chosen.items()}


def vocabularies(schemas: DataFrame) -> DataFrame:
    """(path, kind, name) of schema files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(path, kind, name) for kind, names in vocabulary(content or b"").items() for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, ["path", "kind", "name"])

    return schemas.select("path", "content").mapInArrow(run, "path string, kind string, name string")
