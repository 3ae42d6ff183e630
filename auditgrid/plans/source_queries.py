"""Registered queries of readers and sinks: the driver's tables go out in a file format and are read back."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..functions.geometry import AXES
from ..functions.vocab import LABEL_MAPS
from ..operators import corpus, metrics, scratch
from ..sources import datasets, lines, pixels, readers, writers
from .audit_queries import _MAP_SQL, _NATIVE, _NATIVE_SQL, SQL, query
from .corpus_queries import training_targets
from .derive import BOXES_SQL, boxes, side, table


def _native(number):
    return F.get(F.array(*map(F.lit, _NATIVE)), (number % len(_NATIVE)).cast("int"))


@query(f"""WITH m(k, v) AS (VALUES {_MAP_SQL}), l AS (SELECT l_orderkey AS image_id, {_NATIVE_SQL}[l_partkey % 8 + 1] AS native, l_quantity AS q, l_suppkey % 50 AS s,
  l_orderkey % 3 AS d FROM lineitem), f AS (SELECT l.*, v AS finding FROM l LEFT JOIN m ON lower(trim(native)) = k)
SELECT CAST(image_id AS VARCHAR) AS image_id, finding, native AS native_label, CASE WHEN d <> 0 AND finding <> 'no_finding' THEN round(q / 200.0, 6) END AS y0,
  CASE WHEN d <> 0 AND finding <> 'no_finding' THEN round(s / 100.0, 6) END AS x0, CASE WHEN d <> 0 AND finding <> 'no_finding' THEN round((q + 40) / 200.0, 6) END AS y1,
  CASE WHEN d <> 0 AND finding <> 'no_finding' THEN round((s + 20) / 100.0, 6) END AS x1 FROM f WHERE finding IS NOT NULL
UNION ALL SELECT CAST(image_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY image_id HAVING count(finding) = 0""")
def read_vindr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and sizes written as the published CSV files; a third of the images has no size."""
    path, t = scratch.reserved(spark, "vindr"), table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_suppkey") % 50).cast("double"), F.col("l_quantity").cast("double")
    image = F.col("l_orderkey").alias("image_id")
    named = (_native(F.col("l_partkey")), F.lit(0), F.lit("R1"), x, y, x + 20, y + 40)
    rows = t.select(image, *[c.alias(n) for c, n in zip(named, readers.VINDR_COLUMNS[1:], strict=True)])
    # labels with spaces around them must come back as they were
    rows.write.csv(f"{path}/boxes", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    sized = t.filter("l_orderkey % 3 <> 0").select(image).distinct().withColumns({"dim0": F.lit(200), "dim1": F.lit(100)})
    sized.write.csv(f"{path}/sizes", header=True)
    out = readers.vindr_boxes(spark, f"{path}/boxes", readers.vindr_dims(spark, f"{path}/sizes"))
    return out.select("image_id", "finding", "native_label", *[F.round(f"box.{a}", 6).alias(a) for a in AXES])


_NIH = sorted(LABEL_MAPS["nih"])
_NIH_SQL = "[" + ", ".join(f"'{x}'" for x in _NIH) + "]"
_NIH_MAP_SQL = ", ".join("('{}', {})".format(k, f"'{v}'" if v else "NULL") for k, v in LABEL_MAPS["nih"].items())


@query(f"""WITH m(k, v) AS (VALUES {_NIH_MAP_SQL}), l AS (SELECT l_orderkey || '.png' AS image_id, {_NIH_SQL}[l_partkey % {len(_NIH)} + 1] AS native_label, l_quantity AS q, l_suppkey % 50 AS s FROM lineitem)
SELECT image_id, v AS finding, native_label, round(q / 1024.0, 6) AS y0, round(s / 1024.0, 6) AS x0, round((q + 256) / 1024.0, 6) AS y1, round((s + 512) / 1024.0, 6) AS x1
FROM l JOIN m ON native_label = k WHERE v IS NOT NULL""")
def read_nih_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and sizes written as a CSV file of plain names."""
    path, t = scratch.reserved(spark, "nih"), table(spark, sf_dir, "lineitem")
    label = F.get(F.array(*map(F.lit, _NIH)), (F.col("l_partkey") % len(_NIH)).cast("int"))
    named = (F.concat(F.col("l_orderkey").cast("string"), F.lit(".png")), label, F.col("l_suppkey") % 50, F.col("l_quantity").cast("double"), F.lit(512), F.lit(256))
    t.select(*[c.alias(n) for c, n in zip(named, readers.NIH_NAMED, strict=True)]).write.csv(path, header=True)
    return readers.nih_boxes(spark, path).select("image_id", "finding", "native_label", *[F.round(f"box.{a}", 6).alias(a) for a in AXES])


@query(f"SELECT image_id, target, true AS numbered FROM ({SQL['training_targets']})")
def written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records validated and written as JSON lines, then read strictly with their line numbers.

    ``numbered``: the lines of the record's file are 1 .. n, each once.
    """
    path = scratch.reserved(spark, "records")
    made = training_targets(spark, sf_dir).select(corpus.chat_record(F.col("image_id").cast("string"), F.lit("Report."), F.col("target")).alias("record"))
    writers.write_records(made, path)
    rows = lines.checked_records(spark, path)
    # the different lines of a file as bits, 64 to a row, so that no line is dealt by itself
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("line", F.lit(64)).cast("int"))
    words = rows.groupBy("file", F.floor(F.col("line") / 64).alias("word")).agg(F.bit_count(F.bit_or(bit)).alias("d"), F.count(F.lit(1)).alias("n"), F.min("line").alias("a"), F.max("line").alias("b"))
    files = words.groupBy("file").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("a").alias("a"), F.max("b").alias("b"))
    whole = files.select("file", ((F.col("d") == F.col("n")) & (F.col("a") == 1) & (F.col("b") == F.col("n"))).alias("numbered"))
    whole = scratch.settled(whole, "files")  # a row for each file: Spark sees that it is small
    return rows.join(whole, "file").select(F.col("record.image_path").cast("long").alias("image_id"), corpus.assistant_text(F.col("record.messages")).alias("target"), "numbered")


@query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, md5(regexp_replace(hex(encode(text)), '(.)', '\\1\\1\\1', 'g')) AS rgb_md5
FROM documents WHERE octet_length(encode(text)) > 0""")
def published_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as grey PNG images (a pixel for each hex digit), embedded, published as a split, read and decoded."""
    path = scratch.reserved(spark, "published")
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    drawn = docs.select("doc_id", F.hex(F.col("text").cast("binary")).cast("binary").alias("grey"), F.octet_length("text").alias("width"), F.lit(2).alias("height"))
    files = pixels.as_png(drawn).select(F.col("doc_id").cast("string").alias("path"), "bytes")
    records = docs.select(corpus.chat_record(F.col("doc_id").cast("string"), F.col("doc_id").cast("string"), F.lit("[]")).alias("record"))
    writers.write_splits(writers.with_image_bytes(records, files).withColumn("split", F.lit("train")), path)
    image = F.col("images")[0]
    user = F.filter(F.col("messages")[0]["content"], lambda p: p["type"] == "text")[0]["text"]
    rows = datasets.published_dataset(spark, path, "train")
    return rows.select(user.cast("long").alias("doc_id"), *[image[c].cast("long").alias(c) for c in ("width", "height")], F.md5(image["rgb"]).alias("rgb_md5"))


@F.arrow_udf(BinaryType())
def _doubled(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else np.repeat(np.frombuffer(t, np.uint8), 2).tobytes() for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(LongType())
def _byte_sum(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else int(np.frombuffer(t, np.uint8).sum(dtype=np.int64)) for t in texts.to_pylist()], pa.int64())


@query("""WITH c AS (SELECT doc_id, text, doc_id % 3 AS kind FROM documents WHERE octet_length(encode(text)) > 0), p AS (
  SELECT doc_id, kind, unnest(range(1, length(h) + 1)) AS i, h FROM (SELECT doc_id, kind, hex(encode(text)) AS h FROM c)
), v AS (SELECT doc_id, kind, i, ascii(h[i]) * 257 AS x FROM p), w AS (
  SELECT doc_id, CASE WHEN kind = 1 THEN 12000.0 ELSE quantile_cont(x, 0.01) END AS a, CASE WHEN kind = 1 THEN 18000.0 ELSE quantile_cont(x, 0.99) END AS b FROM v GROUP BY doc_id, kind
), g AS (SELECT doc_id, kind, CASE WHEN b > a THEN CAST(round_even(least(1, greatest(0, (x - a) / (b - a))) * 255, 0) AS BIGINT) END AS grey FROM v JOIN w USING (doc_id))
SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN grey IS NULL THEN 0 WHEN kind = 2 THEN 255 - grey ELSE grey END) AS BIGINT) AS total FROM g GROUP BY doc_id""")
def windowed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as 16-bit pixels: a third with a given window, a third by percentiles, a third inverted."""
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    digits = F.hex(F.col("text").cast("binary")).cast("binary")
    kind = F.col("doc_id") % 3
    rows = docs.select(
        "doc_id",
        # each digit twice: its code in both bytes, so times 257
        _doubled(digits).alias("pixels"),
        F.lit(15000.0).alias("centre"),
        F.when(kind == 1, 6000.0).when(kind == 2, 0.0).alias("window"),
        (kind == 2).alias("inverted"),
    )
    grey = pixels.windowed_pixels(rows)
    return grey.select("doc_id", F.octet_length("grey").cast("long").alias("n"), _byte_sum(F.col("grey")).alias("total"))


@query(f"SELECT finding, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({SQL['presence_metrics']})")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presence report as one JSON document, written to latest and history, and the labels of the history's copy."""
    path, rows = scratch.reserved(spark, "report"), boxes(spark, sf_dir)
    per = scratch.settled(metrics.presence_metrics(side(rows, "image"), side(rows, "draft")), "presence")
    document = writers.report_document("image", [("presence", metrics.macro(per)), ("presence", per, "per_finding", "finding")])
    writers.write_report(document, path, uuid.uuid4().hex)
    told = "struct<tp:long,fp:long,fn:long,precision:double,recall:double,f1:double>"
    read = spark.read.text(f"{path}/history/*").select(F.from_json("value", f"presence struct<per_finding:map<string,{told}>>").alias("d"))
    rows = read.select(F.explode("d.presence.per_finding").alias("finding", "m"))
    return rows.select("finding", "m.tp", "m.fp", "m.fn", *[F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH r AS (SELECT DISTINCT o_orderkey AS path FROM orders), f AS (SELECT path, octet_length(encode(text)) AS n FROM r LEFT JOIN documents ON doc_id = path),
p AS (SELECT (SELECT count(*) FROM orders) AS records, count(*) AS images, count(*) FILTER (WHERE n IS NULL) AS missing, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes FROM f)
SELECT records, records AS targets, images, missing, bytes, missing > 0 AS warned FROM p""")
def embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a published set of the training records would hold, if its images were the documents' texts."""
    records = training_targets(spark, sf_dir).select(corpus.chat_record(F.col("image_id").cast("string"), F.lit("Report."), F.col("target")).alias("record"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("bytes"))
    plan = writers.plan_summary(writers.corpus_plan(records, files), "records", "documents", "corpus")
    return plan.select("records", "targets", "images", "missing", "bytes", F.contains("summary", F.lit("warning: ")).alias("warned"))
