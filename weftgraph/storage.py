"""Tables in shared storage: staged ones that cut lineage, clustered ones, and a store whose changes hold all at once."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one of this machine where all runs on it and none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    found, files = _path(spark, path)
    files.mkdirs(found)
    files.deleteOnExit(found)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df, computed once and cut off from its lineage."""
    path = f"{scratch_path(df.sparkSession, 'stage')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    found, files = _path(spark, path)
    return files.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    found, files = _path(spark, path)
    files.delete(found, True)


#: Rows that one task sorts and writes.
ONE_TASK = 100_000


def clustered(df: DataFrame, path: str, parts: list[str], order: list[str]) -> None:
    """Writes df with a folder per value of `parts` and rows in `order`, so that scans skip folders and row groups.

    Ranges of both are dealt over tasks: a partition with most rows is written by many.
    """
    keys, rows = [F.col(c) for c in (*parts, *order)], staged(df)
    dealt = rows.coalesce(1) if rows.count() <= ONE_TASK else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.partitionBy(*parts).parquet(path)


class Store:
    """Tables below a folder, in partitions by owner that are replaced as a whole.

    A change writes new folders first, and then a manifest with the next number, which says what folder holds an owner's
    rows of a table: all of a change holds, or nothing of it. Folders that neither the last manifest nor the one before
    names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, list[str], list[str]]]):
        """tables: by name the schema, the partition columns behind the owner, and the order of rows."""
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self._known: dict[tuple[str, int], DataFrame] = {}

    def _manifests(self) -> list[int]:
        path, files = _path(self.spark, f"{self.folder}/_manifest")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit()) if files.exists(path) else []

    def _manifest(self, number: int) -> dict[str, dict[str, str]]:
        """By table the batch of each owner."""
        path, files = _path(self.spark, f"{self.folder}/_manifest/{number:012d}")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _now(self) -> tuple[int, dict[str, dict[str, str]]]:
        numbers = self._manifests()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def _folder_of(self, table: str, owner: str, batch: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(owner)
        return f"{self.folder}/{table}/batch={batch}/owner={escaped}"

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(self.tables[table][0])

    def owners(self, table: str) -> set[str]:
        return set(self._now()[1].get(table, {}))

    def read(self, table: str, without: set[str] = frozenset()) -> DataFrame:
        """Rows of a table, but for those of some owners; a table that isn't written yet is empty."""
        number, manifest = self._now()
        if not without and (table, number) in self._known:
            return self._known[table, number]
        schema, columns = self.schema(table), [f.name for f in self.schema(table).fields]
        found = [self._folder_of(table, o, b) for o, b in sorted(manifest.get(table, {}).items()) if o not in without]
        if not found:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, *StructType.fromDDL("batch string, owner string").fields])
        df = self.spark.read.schema(whole).option("basePath", f"{self.folder}/{table}").parquet(*found).select(*columns)
        if not without:
            self._known = {k: v for k, v in self._known.items() if k[1] == number} | {(table, number): df}
        return df

    def write(self, changes: dict[str, DataFrame], gone: dict[str, set[str]] | None = None) -> None:
        """Replaces the owners that occur in changed tables (with a column `owner`), and drops those that are `gone`."""
        number, manifest = self._now()
        before = {t: dict(owners) for t, owners in manifest.items()}
        batch = uuid.uuid4().hex
        for table, owners in (gone or {}).items():
            manifest[table] = {o: b for o, b in manifest.get(table, {}).items() if o not in owners}
        for table, df in changes.items():
            _, parts, order = self.tables[table]
            path = f"{self.folder}/{table}/batch={batch}"
            clustered(df, path, ["owner", *parts], order)
            found, files = _path(self.spark, path)
            unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            names = [s.getPath().getName() for s in files.listStatus(found)]
            manifest.setdefault(table, {}).update({unescape(n.removeprefix("owner=")): batch for n in names if n.startswith("owner=")})
        self._publish(number + 1, manifest)
        self._tidy(number - 1, before, manifest)

    def _publish(self, number: int, manifest: dict) -> None:
        draft, files = _path(self.spark, f"{self.folder}/_manifest/.{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        name, _ = _path(self.spark, f"{self.folder}/_manifest/{number:012d}")
        if files.exists(name) or not files.rename(draft, name):
            raise RuntimeError("the store was changed meanwhile: try again")

    def _tidy(self, number: int, *kept: dict) -> None:
        if number > 0:
            for table, owners in self._manifest(number).items():
                for owner, batch in owners.items():
                    if not any(m.get(table, {}).get(owner) == batch for m in kept):
                        remove(self.spark, self._folder_of(table, owner, batch))
            remove(self.spark, f"{self.folder}/_manifest/{number:012d}")

    def reset(self) -> None:
        """Drops all rows; what ran before may still read them."""
        if self._manifests():
            self.write({}, {t: self.owners(t) for t in self.tables})
