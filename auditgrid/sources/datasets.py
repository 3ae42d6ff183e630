"""Training sets with their images decoded: from JSON lines beside a folder, or from a published Parquet set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import checked_records
from .pixels import MAX_BYTES, decoded
from .writers import with_image_bytes

COLUMNS = ("images", "messages")


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def resolved_path(spark: SparkSession, path: Column, root: str) -> Column:
    """The full path of an image: relative ones lie under ``root``, absolute ones in root's file system."""
    system, folder = _qualified(spark, f"{root}/x").split("/", 1)[0], _qualified(spark, root).rstrip("/")
    if "://" in folder:
        system = "/".join(folder.split("/", 3)[:3])
    full = F.when(path.startswith("/"), F.concat(F.lit(system), path)).otherwise(F.concat(F.lit(f"{folder}/"), path))
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), path).otherwise(full)


def with_files(records: DataFrame, root: str) -> DataFrame:
    """images (one file's bytes), messages of each record, from the files under ``root``.

    A record without an image part, or whose file is not there, is an error.
    """
    spark = records.sparkSession
    path = resolved_path(spark, F.col("record.image_path"), root)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = records.select(F.col("record").withField("image_path", path).alias("record"))
    return with_image_bytes(rows, listing.select("path", F.col("content").alias("bytes")))


def image_dataset(spark: SparkSession, path: str, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """images (width, height, rgb) and messages of a file of records; an empty one is an error."""
    records = checked_records(spark, path)
    if records.isEmpty():
        raise ValueError(f"no records in {path}")
    return decoded(with_files(records, root), max_bytes)


def published_dataset(spark: SparkSession, path: str, split: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """images (width, height, rgb) and messages of one split that write_splits wrote.

    The columns are checked before anything is read.
    """
    rows = spark.read.parquet(f"{path}/split={split}")
    if lacking := [c for c in COLUMNS if c not in rows.columns]:
        raise ValueError(f"split {split} of {path} lacks {lacking}; it has {sorted(rows.columns)}")
    return decoded(rows.select(*COLUMNS), max_bytes)
