"""Continuous ingestion: class files that arrive in a folder go through the same per-package update as a batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import Engine
from ..sources.listings import files as listed
from ..sources.listings import package_of

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, folder: str, engine: Engine, checkpoint: str, domains: list[str] | None = None) -> StreamingQuery:
    """Watches `folder`/<package>/classes; a package is brought up to date as a whole when any of its files is new."""
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.class").load(folder)

    def update(batch: DataFrame, _: int) -> None:
        touched = batch.select(package_of(F.col("path")).alias("package")).distinct()
        every = listed(batch.sparkSession, folder, "*.class").withColumn("package", package_of(F.col("path")))
        engine.ingest_classes(every.join(touched, "package", "left_semi"), domains)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
