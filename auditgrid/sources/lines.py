"""Lines of text files with their numbers, without a file going through one task.

A file is read in splits.  The lines of each split are counted first; the sums of the
counts before a split give the number of its first line, and a line's place within its
split the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import validated
from ..operators.scratch import settled

PART = "struct<type:string,text:string>"
RECORD = f"image_path string, messages array<struct<role:string,content:array<{PART}>>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 in each file), raw of every line, blank ones too.

    The table of splits has a row for some 128 MB of input; its running sums are windows
    within a file.  Both passes read the same listing of files, so their splits and the
    places in them are the same.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    splits = settled(lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "splits")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.col("id") - F.col("first") + F.col("before") + 1
    return lines.join(begins, ["file", "start"]).select("file", number.alias("line"), "raw")


def training_records(spark: SparkSession, path: str) -> DataFrame:
    """file, line, raw, record, malformed of JSON-lines files; blank lines are left out but count."""
    lines = numbered_lines(spark, path).filter(F.trim("raw") != "")
    return lines.withColumns({"record": F.from_json("raw", RECORD), "malformed": F.try_parse_json("raw").isNull()})


def checked_records(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """file, line, record; reading a line that is no JSON, or no valid record, fails and names the line.

    The check is part of the rows: it costs no pass of its own, and the error comes with
    the first action that reaches a bad line.
    """
    rows = training_records(spark, path)
    wrong = F.when(F.col("malformed"), F.lit("no JSON"))
    if validate:
        rows = validated(rows)
        wrong = F.coalesce(wrong, F.col("error"))
    told = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "), wrong)
    record = F.when(wrong.isNotNull(), F.raise_error(told).cast(rows.schema["record"].dataType)).otherwise(F.col("record"))
    return rows.select("file", "line", record.alias("record"))
