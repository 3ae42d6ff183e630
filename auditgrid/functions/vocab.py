"""The closed finding vocabulary, as fixed values, dimension tables and expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels in canonical order, with display names.
DISPLAY_NAMES = {
    "pleural_effusion": "Pleural effusion",
    "pneumothorax": "Pneumothorax",
    "lung_opacity_consolidation": "Lung opacity / consolidation",
    "nodule_mass": "Nodule / mass",
    "cardiomegaly": "Cardiomegaly (enlarged heart)",
    "no_finding": "No finding",
}
NO_FINDING = "no_finding"
CANONICAL = tuple(DISPLAY_NAMES)
POSITIVE = CANONICAL[:-1]
# Labels that always need review, and labels from most to least specific.
URGENT = ("pneumothorax", "nodule_mass")
MOST_SPECIFIC_FIRST = ("pneumothorax", "nodule_mass", "pleural_effusion", "cardiomegaly", "lung_opacity_consolidation")

# Native class names of the source datasets; None is known but ignored.
LABEL_MAPS: dict[str, dict[str, str | None]] = {
    "vindr": {
        "aortic enlargement": None,
        "atelectasis": None,
        "calcification": None,
        "cardiomegaly": "cardiomegaly",
        "consolidation": "lung_opacity_consolidation",
        "ild": None,
        "infiltration": "lung_opacity_consolidation",
        "lung opacity": "lung_opacity_consolidation",
        "nodule/mass": "nodule_mass",
        "other lesion": None,
        "pleural effusion": "pleural_effusion",
        "pleural thickening": None,
        "pneumothorax": "pneumothorax",
        "pulmonary fibrosis": None,
        "no finding": "no_finding",
    },
    "nih": {
        "atelectasis": None,
        "cardiomegaly": "cardiomegaly",
        "effusion": "pleural_effusion",
        "infiltrate": "lung_opacity_consolidation",
        "mass": "nodule_mass",
        "nodule": "nodule_mass",
        "pneumonia": "lung_opacity_consolidation",
        "pneumothorax": "pneumothorax",
    },
    "chestxdet": {
        "atelectasis": None,
        "calcification": None,
        "cardiomegaly": "cardiomegaly",
        "consolidation": "lung_opacity_consolidation",
        "diffuse nodule": "nodule_mass",
        "effusion": "pleural_effusion",
        "emphysema": None,
        "fibrosis": None,
        "fracture": None,
        "mass": "nodule_mass",
        "nodule": "nodule_mass",
        "pleural thickening": None,
        "pneumothorax": "pneumothorax",
    },
    # names of a report labeler's conditions
    "chexpert": {
        "pleural effusion": "pleural_effusion",
        "pneumothorax": "pneumothorax",
        "consolidation": "lung_opacity_consolidation",
        "lung opacity": "lung_opacity_consolidation",
        "lung lesion": "nodule_mass",
        "cardiomegaly": "cardiomegaly",
        "no finding": "no_finding",
    },
}


def vocab(spark: SparkSession) -> DataFrame:
    """label, canonical_ord, is_positive, is_urgent, specificity_rank, display_name: six rows."""
    rows = [(x, i, x in POSITIVE, x in URGENT, MOST_SPECIFIC_FIRST.index(x) if x in MOST_SPECIFIC_FIRST else len(MOST_SPECIFIC_FIRST), DISPLAY_NAMES[x]) for i, x in enumerate(CANONICAL)]
    return spark.createDataFrame(rows, "label string, canonical_ord int, is_positive boolean, is_urgent boolean, specificity_rank int, display_name string")


def label_map(spark: SparkSession) -> DataFrame:
    """dataset, native_label, label (null: known but ignored)."""
    return spark.createDataFrame([(d, k, v) for d, m in LABEL_MAPS.items() for k, v in m.items()], "dataset string, native_label string, label string")


def labels(values=CANONICAL) -> Column:
    return F.array(*map(F.lit, values))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end (`trim` drops spaces alone).

    A text with visible ASCII at both ends needs no pattern.
    """
    bare = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(bare, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def is_canonical(c: Column) -> Column:
    return c.isin(*CANONICAL)


def is_urgent(c: Column) -> Column:
    return c.isin(*URGENT)


def _looked_up(c: Column, table: dict, otherwise) -> Column:
    pairs = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(pairs, c), otherwise)


def specificity_rank(c: Column) -> Column:
    return _looked_up(c, {x: i for i, x in enumerate(MOST_SPECIFIC_FIRST)}, F.lit(len(MOST_SPECIFIC_FIRST)))


def canonical_ord(c: Column) -> Column:
    """A label's place in the canonical order, from 0; others come last."""
    return _looked_up(c, {x: i for i, x in enumerate(CANONICAL)}, F.lit(len(CANONICAL)))


def display_name(c: Column) -> Column:
    """The label's display name, or its words with the first letter a capital."""
    words = F.replace(c, F.lit("_"), F.lit(" "))
    return _looked_up(c, DISPLAY_NAMES, F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substring(words, 2, 1 << 30))))


def normalized_finding(c: Column, strict: bool = False) -> Column:
    """A canonical label from loosely written text; null (or an error, if strict) else.

    A label that is canonical as it stands, or but for its case, needs no pattern.
    """
    folded = F.regexp_replace(F.lower(stripped(c)), r"(?U)[\s\-]+", "_")
    error = F.raise_error(F.concat(F.lit("not a canonical finding: "), F.coalesce(c, F.lit("null")))).cast("string")
    return F.when(is_canonical(c), c).when(is_canonical(F.lower(c)), F.lower(c)).when(is_canonical(folded), folded).otherwise(error if strict else F.lit(None))


def mapped_label(rows: DataFrame, native: str, dataset: str, out: str = "finding") -> DataFrame:
    """Add the canonical label of a native class name; unknown names give null."""
    if dataset not in LABEL_MAPS:
        raise KeyError(dataset)
    side = label_map(rows.sparkSession).filter(F.col("dataset") == dataset).select(F.col("native_label").alias("_native"), F.col("label").alias(out))
    return rows.join(F.broadcast(side), F.lower(stripped(F.col(native))) == F.col("_native"), "left").drop("_native")


def label_bit(c: Column) -> Column:
    """1, 2, 4, .. for the positive labels in canonical order, 0 for anything else: sets of labels as sums of bits."""
    bit = F.when(c == POSITIVE[0], 1)
    for i, x in enumerate(POSITIVE[1:], 1):
        bit = bit.when(c == x, 1 << i)
    return bit.otherwise(0)


def labels_of(bits: Column) -> Column:
    """The positive labels of a set of bits, in canonical order."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, x) for i, x in enumerate(POSITIVE)]))


def canonical_sorted(c: Column, among=CANONICAL) -> Column:
    """The distinct canonical labels of an array, in canonical order."""
    return F.filter(labels(among), lambda x: F.array_contains(c, x))
