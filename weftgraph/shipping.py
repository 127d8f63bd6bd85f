"""Sends this package's code to the executors, for clusters where it isn't installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark's file server then hands the archive to every executor, also to late ones."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if context.applicationId in _SENT or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="weftgraph-")  # of the driver alone, which serves the archive while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "weftgraph-code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the code sent first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
