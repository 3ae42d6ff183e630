"""Sinks: training records, embedded images, evaluation reports and their history."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import formatted_size
from ..operators.corpus import assistant_text, has_image, validated


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a whole staged folder in the place of ``path``; the old one goes last.

    Two renames: between them the old output stands beside its place, never half written.
    """
    fs, new = _fs(spark, staged)
    at, old = _fs(spark, path)[1], _fs(spark, f"{staged}-old")[1]
    fs.mkdirs(at.getParent())
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"cannot move {staged} to {path}")
    fs.delete(old, True)


def _staging(path: str) -> str:
    return f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"


def write_records(records: DataFrame, path: str, validate: bool = True, record: str = "record") -> int:
    """Write records as JSON lines and return how many; with a bad record the old output stays.

    One pass validates, counts and writes to a folder beside ``path``, which then takes its place.
    """
    spark, staged, seen = records.sparkSession, _staging(path), Observation()
    rows = validated(records, record) if validate else records.withColumn("error", F.lit(None).cast("string"))
    lines = rows.select(F.to_json(record).alias("value"), "error")
    lines = lines.observe(seen, F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.min("error").alias("first"))
    try:
        lines.select("value").write.mode("errorifexists").text(staged)
        if seen.get["bad"]:
            raise ValueError(f"invalid record: {seen.get['first']} ({seen.get['bad']} of {seen.get['n']})")
        _replace(spark, staged, path)
    finally:
        fs, at = _fs(spark, staged)
        fs.delete(at, True)
    return seen.get["n"]


def with_image_bytes(records: DataFrame, images: DataFrame, record: str = "record") -> DataFrame:
    """images (bytes) and messages of each record; a record without its image is an error.

    ``images``: path, bytes.
    """
    rows = records.select(F.col(f"{record}.image_path").alias("path"), F.col(f"{record}.messages").alias("messages"))
    joined = rows.join(images.select("path", "bytes"), "path", "left")
    why = F.when(~has_image(F.col("messages")), F.lit("record has no image part: ")).when(F.col("bytes").isNull(), F.lit("image not found: "))
    checked = F.when(why.isNotNull(), F.raise_error(F.concat(why, "path")).cast("binary")).otherwise(F.col("bytes"))
    return joined.select(F.array(checked).alias("images"), "messages")


def write_splits(rows: DataFrame, path: str) -> None:
    """Rows with ``split`` as Parquet, a folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(report: DataFrame, path: str, stamp: str | None = None) -> None:
    """A report as JSON under ``path``/latest, and under ``path``/history/<stamp> if one is given.

    It is computed once: the files of the one write are copied.  A stamp that is taken is an
    error and leaves ``latest`` as it is.  Undefined numbers are null.  A frame of the one
    column ``value`` (see report_document) is written as it stands.
    """
    spark, staged = report.sparkSession, _staging(f"{path}/latest")
    whole = F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")
    kept = _fs(spark, f"{path}/history/{stamp}")[1]
    fs, at = _fs(spark, staged)
    if stamp and fs.exists(kept):
        raise ValueError(f"a report of {stamp} is there already")
    try:
        (report if report.columns == ["value"] else report.select(whole)).coalesce(1).write.text(staged)
        if stamp:
            copy = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy
            copy(fs, at, fs, kept, False, spark.sparkContext._jsc.hadoopConfiguration())
        _replace(spark, staged, f"{path}/latest")
    finally:
        fs.delete(at, True)


def _members(*columns: str) -> Column:
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return text.substr(F.lit(2), F.length(text) - 2)


def _quoted(value: Column) -> Column:
    text = F.to_json(F.array(value.cast("string")))
    return text.substr(F.lit(2), F.length(text) - 2)


def report_document(mode: str, parts: list[tuple]) -> DataFrame:
    """One row, ``value``: a JSON document of several small report tables, its order fixed, nulls kept.

    A part (name, rows) gives the members of ``name`` by the columns of its one row; a part
    (name, rows, field, key) gives a member ``field``, an object with the other columns for
    each value of ``key``, in the order of the key.  Parts of one name share one object.
    Reports have a row for a label, a threshold or a model; they come together in one task.
    """
    made = []
    for place, (name, rows, *keyed) in enumerate(parts):
        if keyed:
            field, key = keyed
            item = F.concat(_quoted(F.col(key)), F.lit(":{"), _members(*[c for c in rows.columns if c != key]), F.lit("}"))
            items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("t")))), lambda x: x["t"])
            text = F.concat(F.lit(json.dumps(field) + ":{"), F.concat_ws(",", items), F.lit("}"))
        else:
            many = F.raise_error(F.lit(f"{name}: more than one row")).cast("string")
            text = F.when(F.count(F.lit(1)) > 1, many).otherwise(F.max(_members(*rows.columns)))
        made.append(rows.agg(text.alias("text")).select(F.lit(place).alias("place"), "text"))
    texts = reduce(DataFrame.unionByName, made).agg(F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("at"))
    names = list(dict.fromkeys(name for name, *_ in parts))
    members = [F.lit(f'"mode":{json.dumps(mode)}')]
    for name in names:
        inner = [F.col("at")[place] for place, part in enumerate(parts) if part[0] == name]
        members.append(F.concat(F.lit(json.dumps(name) + ":{"), F.concat_ws(",", *inner), F.lit("}")))
    return texts.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("value"))


def corpus_plan(records: DataFrame, images: DataFrame, record: str = "record") -> DataFrame:
    """records, images, missing and bytes of what an upload would hold; nothing is written."""
    paths = records.select(F.col(f"{record}.image_path").alias("path"))
    found = paths.distinct().join(images.select("path", F.octet_length("bytes").cast("long").alias("n")), "path", "left")
    sums = found.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))
    return records.agg(F.count(F.lit(1)).alias("records"), F.count(assistant_text(F.col(f"{record}.messages"))).alias("targets")).join(F.broadcast(sums))


def plan_summary(plan: DataFrame, source: str, root: str, target: str, split: str = "train", private: bool = True) -> DataFrame:
    """Add ``summary`` to a corpus_plan: what would be published, line by line, with a warning if images are missing."""
    told = [
        ("records from", F.lit(source)),
        ("images under", F.lit(root)),
        ("published as", F.lit(f"{target}, split {split}, {'private' if private else 'public'}")),
        ("records", F.col("records").cast("string")),
        ("different images", F.col("images").cast("string")),
        ("images missing", F.col("missing").cast("string")),
        ("image bytes", formatted_size(F.col("bytes"))),
    ]
    rows = [F.concat(F.lit(f"{name}: "), value) for name, value in told]
    warning = F.when(F.col("missing") > 0, F.concat(F.lit("warning: publishing would fail on "), F.col("missing").cast("string"), F.lit(" missing images")))
    return plan.withColumn("summary", F.concat_ws("\n", *rows, warning))
