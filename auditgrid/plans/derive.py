"""Findings, drafts and pools derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.vocab import CANONICAL, POSITIVE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of findings that a task should get, and from how many on they are dealt anew.
TASK_ROWS, DEALT_FROM = 1 << 19, 1 << 21


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows dealt by image_id into so many parts that a task's share of findings has a bound.

    The number of parts follows the table of findings (a count of its Parquet footers), and all
    that deals by it agrees, so that images and their findings meet without another shuffle.
    A small table is left to the session's settings.
    """
    n = table(spark, sf_dir, "lineitem").count()
    if n <= DEALT_FROM:
        return rows
    return rows.repartition(max(-(-n // TASK_ROWS), spark.sparkContext.defaultParallelism), "image_id")


def _label(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, CANONICAL)), (number % len(CANONICAL)).cast("int"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, side, ord, finding, status, box, span: a finding for each lineitem."""
    # named before the window, so that Spark knows its rows as dealt by image_id
    used = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    t = dealt(spark, sf_dir, table(spark, sf_dir, "lineitem").select(*used).withColumnRenamed("l_orderkey", "image_id"))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    y0, x0 = (F.col("l_quantity") - 1) / F.lit(100), F.col("l_discount") * F.lit(4.0)
    none = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7)
    whole = box(y0, x0, y0 + F.lit(0.2) + F.col("l_tax") * F.lit(3.0), x0 + F.lit(0.3) + F.col("l_tax") * F.lit(2.0))
    return t.select(
        "image_id",
        F.when(F.col("l_suppkey") % 2 == 0, "image").otherwise("draft").alias("side"),
        order.cast("long").alias("ord"),
        _label(F.col("l_partkey")).alias("finding"),
        F.when(F.col("l_returnflag") == "A", "absent").otherwise("present").alias("status"),
        F.when(~none, whole).alias("box"),
        F.concat(F.lit("span "), F.col("l_partkey").cast("string")).alias("span"),
    )


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("side") == name)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id")))


_LIST = "[" + ", ".join(f"'{x}'" for x in CANONICAL) + "]"
POSITIVES = "(" + ", ".join(f"'{x}'" for x in POSITIVE) + ")"
POSITIVE_LIST = "[" + ", ".join(f"'{x}'" for x in POSITIVE) + "]"

#: `b`: the same rows as boxes(), with the box as four columns (null together).
BOXES_SQL = f"""b0 AS (
  SELECT l_orderkey AS image_id, CASE WHEN l_suppkey % 2 = 0 THEN 'image' ELSE 'draft' END AS side,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
         {_LIST}[l_partkey % 6 + 1] AS finding, CASE WHEN l_returnflag = 'A' THEN 'absent' ELSE 'present' END AS status,
         (l_quantity - 1) / 100 AS y0, l_discount * CAST(4 AS DOUBLE) AS x0, l_tax AS t, l_linestatus = 'O' AND l_linenumber = 7 AS none, 'span ' || l_partkey AS span
  FROM lineitem
), b AS (
  SELECT image_id, side, ord, finding, status, span, CASE WHEN NOT none THEN y0 END AS y0, CASE WHEN NOT none THEN x0 END AS x0,
         CASE WHEN NOT none THEN y0 + CAST(0.2 AS DOUBLE) + t * CAST(3 AS DOUBLE) END AS y1, CASE WHEN NOT none THEN x0 + CAST(0.3 AS DOUBLE) + t * CAST(2 AS DOUBLE) END AS x1
  FROM b0
)"""


def iou_sql(a: str, b: str) -> str:
    high = f"greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    wide = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    area = lambda c: f"({c}.y1 - {c}.y0) * ({c}.x1 - {c}.x0)"
    inter = f"{high} * {wide}"
    return f"CASE WHEN {inter} > 0 THEN {inter} / ({area(a)} + {area(b)} - {inter}) ELSE 0 END"
