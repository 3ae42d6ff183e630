"""Readers of annotation files, as tables; every reader states its schema, none infers it.

A header that is not the expected one is an error, as is a malformed required value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import from_corner_and_size, from_pixels
from ..functions.vocab import LABEL_MAPS, NO_FINDING, mapped_label
from .pixels import png_size

VINDR_COLUMNS = ("image_id", "class_name", "class_id", "rad_id", "x_min", "y_min", "x_max", "y_max")
VINDR = "image_id string, class_name string, class_id int, rad_id string, x_min double, y_min double, x_max double, y_max double"
FINDING = "struct<finding:string,status:string,box:array<double>,confidence:double,evidence:string>"
FLAGS = "struct<missing_findings:array<string>,unsupported_claims:array<string>,urgent_review_flags:array<string>>"
NIH_SIZE = 1024
NIH_NAMED = ("image_id", "finding", "x", "y", "w", "h")
NIH_PLACED = ("Image Index", "Finding Label", "Bbox [x", "y", "w", "h]")
#: The categories of the rasters in their published order, from number 1 on.
CHESTXDET_CATEGORIES = (
    "Atelectasis",
    "Calcification",
    "Cardiomegaly",
    "Consolidation",
    "Diffuse Nodule",
    "Effusion",
    "Emphysema",
    "Fibrosis",
    "Fracture",
    "Mass",
    "Nodule",
    "Pleural Thickening",
    "Pneumothorax",
)
BACKGROUND = 255


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).head()
    return [c.strip().strip('"') for c in first[0].lstrip("﻿").split(",")] if first else []


def _in_order(rows: DataFrame) -> DataFrame:
    """Add ``ord``: the place within the file, from where a split begins and the row's number in its task.

    A split of a file is read by one task from its beginning, so the order does not depend
    on which task reads which split; 2**33 rows of a task fit beside a split's beginning.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("ord", F.col("_metadata.file_block_start") * F.lit(1 << 20) + number)


def vindr_dims(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height; dim0 is the height and dim1 the width where they are named so."""
    cols = _header(spark, path)
    key = next((c for c in ("image_id", "id") if c in cols), None)
    pair = next((p for p in (("width", "height"), ("dim1", "dim0")) if set(p) <= set(cols)), None)
    if key is None or pair is None:
        raise ValueError(f"dimension columns not found in {cols}")
    rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {'int' if c in pair else 'string'}" for c in cols))
    return rows.select(F.col(key).alias("image_id"), F.col(pair[0]).alias("width"), F.col(pair[1]).alias("height"))


def vindr_boxes(spark: SparkSession, path: str, dims: DataFrame | None = None) -> DataFrame:
    """image_id, ord, finding, box, native_label: every image keeps a row (finding null) even without labels."""
    if tuple(_header(spark, path)) != VINDR_COLUMNS:
        raise ValueError(f"unexpected header in {path}")
    rows = mapped_label(_in_order(spark.read.csv(path, header=True, schema=VINDR)), "class_name", "vindr")
    if dims is None:
        rows = rows.withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})
    else:
        rows = rows.join(dims, "image_id", "left")
    whole = from_pixels(F.col("x_min"), F.col("y_min"), F.col("x_max"), F.col("y_max"), F.col("width"), F.col("height"))
    box = F.when(F.col("finding") != NO_FINDING, whole)
    found = rows.filter("finding IS NOT NULL").select("image_id", "ord", "finding", box.alias("box"), F.col("class_name").alias("native_label"))
    bare = rows.groupBy("image_id").agg(F.count("finding").alias("n")).filter("n = 0").select("image_id")
    return found.unionByName(bare, allowMissingColumns=True)


def vqa_annotations(spark: SparkSession, path: str) -> DataFrame:
    """image_id, finding, box, native_finding of one JSON array of questions.

    A location needs four numbers; it gives a box where both dimensions are known.
    """
    first = spark.read.text(path, wholetext=True).head()
    if not first or not first[0].lstrip().startswith("["):
        raise ValueError("the annotations are not a JSON array")
    schema = "image_id string, question_type string, question string, answer string, gt_finding string, gt_location array<int>, image_width int, image_height int"
    rows = mapped_label(_in_order(spark.read.json(path, schema=schema, multiLine=True)), "gt_finding", "vindr")
    at = F.col("gt_location")
    bad = at.isNotNull() & (F.size(at) != 4)
    checked = F.when(bad, F.raise_error(F.lit("gt_location must have four numbers")).cast("array<int>")).otherwise(at)
    rows = rows.withColumn("gt_location", checked)
    box = from_pixels(*[F.get("gt_location", F.lit(i)) for i in range(4)], F.col("image_width"), F.col("image_height"))
    return rows.select("image_id", "ord", "finding", F.when(F.col("gt_location").isNotNull(), box).alias("box"), F.col("gt_finding").alias("native_finding"))


def joined_to_images(rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """The rows, or those of the images given."""
    return rows if images is None else rows.join(images.select("image_id").distinct(), "image_id", "left_semi")


def nih_boxes(spark: SparkSession, path: str, width: int = NIH_SIZE, height: int = NIH_SIZE) -> DataFrame:
    """image_id, finding, box, native_label, from a header of plain names or from the published one.

    The published header is read by place, as its brackets hold commas.
    """
    cols = _header(spark, path)
    if set(NIH_NAMED) <= set(cols):
        rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in cols)).withColumnRenamed("finding", "label")
    elif tuple(cols[: len(NIH_PLACED)]) == NIH_PLACED:
        names = ("image_id", "label", "x", "y", "w", "h", *[f"e{i}" for i in range(len(cols) - len(NIH_PLACED))])
        rows = spark.read.csv(path, header=True, enforceSchema=True, schema=", ".join(f"{c} string" for c in names))
    else:
        raise ValueError(f"missing columns: {path} has {cols}")
    rows = mapped_label(_in_order(rows), "label", "nih")
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "w", "h"))
    box = from_corner_and_size(x, y, w, h, F.lit(width), F.lit(height))
    return rows.filter("finding IS NOT NULL").select("image_id", "ord", "finding", box.alias("box"), F.col("label").alias("native_label"))


def _raster(label: Column) -> Column:
    """The rows of category numbers of a raster written as JSON: two axes, or a third of channels, of which the first counts."""
    axes = F.length(F.regexp_extract(F.regexp_replace(label, r"\s", ""), r"^\[*", 0))
    flat = F.from_json(label, "array<array<int>>")
    first = F.transform(F.from_json(label, "array<array<array<int>>>"), lambda line: F.transform(line, lambda v: v[0]))
    wrong = F.raise_error(F.lit("a raster must be 2-D")).cast("array<array<int>>")
    return F.when(label.isNull(), F.lit(None)).when(axes == 2, flat).when(axes == 3, first).otherwise(wrong)


def chestxdet_boxes(spark: SparkSession, path: str, categories: tuple[str, ...] = CHESTXDET_CATEGORIES) -> DataFrame:
    """image_id, ord, finding, box, native_label: the tight box of each category of a raster.

    The far edge of a box lies one pixel after the last; background and unmapped numbers go.
    Every image keeps a row (finding null) even without a box or a raster.
    """
    read = spark.read.json(path, schema="image_id string, label string", multiLine=True)
    rows = read.select(F.coalesce("image_id", F.lit("")).alias("image_id"), _raster(F.col("label")).alias("label"))
    lines = rows.select("image_id", F.size("label").alias("h"), F.posexplode("label").alias("y", "line"))
    cells = lines.select("image_id", "h", F.size("line").alias("w"), "y", F.posexplode("line").alias("x", "v")).filter(F.col("v") != BACKGROUND)
    sides = ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"), (F.max, "w", "w"), (F.max, "h", "h"))
    tight = cells.groupBy("image_id", "v").agg(*[f(c).alias(n) for f, c, n in sides])
    known = [(i, n, LABEL_MAPS["chestxdet"].get(n.lower())) for i, n in enumerate(categories, 1)]
    names = spark.createDataFrame(known, "v int, native_label string, finding string").filter("finding IS NOT NULL")
    box = from_pixels(F.col("x0"), F.col("y0"), F.col("x1") + 1, F.col("y1") + 1, F.col("w"), F.col("h"))
    found = tight.join(F.broadcast(names), "v").select("image_id", F.col("v").cast("long").alias("ord"), "finding", box.alias("box"), "native_label")
    bare = rows.select("image_id").distinct().join(found.select("image_id").distinct(), "image_id", "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


def open_reports(spark: SparkSession, path: str) -> DataFrame:
    """image_id, findings_text, impression_text, image (frontal, else lateral, else null)."""
    schema = "uid int, findings string, impression string, img_frontal binary, img_lateral binary"
    rows = spark.read.json(path, schema=schema, multiLine=True)
    return rows.select(F.col("uid").cast("string").alias("image_id"), F.coalesce("findings", F.lit("")).alias("findings_text"), F.coalesce("impression", F.lit("")).alias("impression_text"), F.coalesce("img_frontal", "img_lateral").alias("image"))


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """image_id (the file's name without its ending), path, bytes, width, height of a folder's images.

    The sizes come from the header of a PNG; they are null for other formats.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id")
    size = png_size(F.col("content"))
    return rows.select(name, "path", F.col("content").alias("bytes"), size["width"].alias("width"), size["height"].alias("height"))


def images_of(ids: DataFrame, listing: DataFrame) -> DataFrame:
    """The images of the given image_id, each once; an id without its image is an error."""
    joined = ids.select("image_id").distinct().join(listing, "image_id", "left")
    gone = F.raise_error(F.concat(F.lit("image not found: "), F.col("image_id"))).cast("string")
    return joined.withColumn("path", F.when(F.col("path").isNull(), gone).otherwise(F.col("path")))


def boxes_by_image(rows: DataFrame) -> DataFrame:
    """image_id and ``boxes``: its found rows (ord, finding, box, native_label) in their order; none for a bare image."""
    named = F.struct(*[c for c in ("ord", "finding", "box", "native_label") if c in rows.columns])
    found = F.array_sort(F.collect_list(F.when(F.col("finding").isNotNull(), named)))
    return rows.groupBy("image_id").agg(found.alias("boxes"))


def windowed(pixel: Column, centre: Column, width: Column, inverted: Column) -> Column:
    """A pixel's grey value: centre - width / 2 .. centre + width / 2 becomes 0 .. 255, halves rounded to even."""
    low = centre - width / 2
    grey = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (pixel - low) / width)) * 255).cast("int")
    return F.when(width > 0, F.when(inverted, 255 - grey).otherwise(grey))


def eval_cases(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """The cases of one evaluation document: 'image' (findings) or 'audit' (flags)."""
    key, value = {"image": ("image_id", f"array<{FINDING}>"), "audit": ("case_id", FLAGS)}[mode]
    schema = f"cases array<struct<{key}:string,predicted:{value},expected:{value}>>"
    rows = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    return rows.select(F.posexplode("cases").alias("at", "c")).select("at", "c.*")


def first_existing(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    """The first of the named files that a folder of any file system has."""
    jvm = spark.sparkContext._jvm
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return f"{folder}/{name}"
    return None


def default_path(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The first of the named files that is there, else the last name, for the read to fail on."""
    return first_existing(spark, folder, names) or f"{folder}/{names[-1]}"


#: key, title and layout of the annotation sets that can be read here.
CATALOG = (("vindr", "VinDr-CXR boxes", "csv"), ("vqa", "visual questions", "json"), ("chestxdet", "ChestX-Det rasters", "json"), ("nih", "NIH ChestX-ray14 boxes", "csv"), ("open_i", "Open-i reports", "json"))


def catalog(spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
    """The catalogue, or the named sets of it in its own order; 'all' names every set."""
    known = [k for k, _, _ in CATALOG]
    if wrong := [k for k in keys or [] if k not in (*known, "all")]:
        raise ValueError(f"unknown datasets: {wrong}")
    rows = [r for r in CATALOG if not keys or "all" in keys or r[0] in keys]
    return spark.createDataFrame(rows, "key string, title string, layout string")
