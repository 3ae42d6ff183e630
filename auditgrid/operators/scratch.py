"""Results that several later steps read: computed once, and whole when executors are lost."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Without it a local session gets a temporary one; a cluster, whose executors share no such
    folder, is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditgrid-")
        spark.sparkContext.setCheckpointDir(found)
        _WRITTEN.append((spark, found))
    return found.rstrip("/")


def reserved(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def settled(rows: DataFrame, tag: str = "settled") -> DataFrame:
    """The rows as a table in the shared folder, from which all that follows reads.

    What made them runs once (again only for a task that is lost before its rows are
    committed); the tables go when the driver ends.
    """
    path = reserved(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_WRITTEN):
        with contextlib.suppress(Exception):  # the session may have ended first
            delete(spark, path)
