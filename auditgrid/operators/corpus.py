"""Training records of images and findings, synthetic drafts and audit cases."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import as_list
from ..functions.json_lists import parsed_list
from ..functions.scalars import let
from ..functions.vocab import NO_FINDING, POSITIVE, URGENT, canonical_sorted, normalized_finding
from .sampling import seeded

# Sentences of a templated impression, three for each label in order.
PRESENT = {
    "pleural_effusion": (
        "Blunting of the costophrenic angle consistent with a pleural effusion.",
        "Layering pleural effusion.",
        "Pleural effusion is present.",
    ),
    "pneumothorax": (
        "Pneumothorax is present.",
        "Lucency with absent lung markings consistent with a pneumothorax.",
        "Apical pneumothorax.",
    ),
    "lung_opacity_consolidation": (
        "Airspace opacity consistent with consolidation.",
        "Focal consolidation is present.",
        "Patchy lung opacity.",
    ),
    "nodule_mass": (
        "A pulmonary nodule is present.",
        "Mass-like opacity consistent with a nodule or mass.",
        "Nodular opacity is seen.",
    ),
    "cardiomegaly": (
        "Cardiomegaly with an enlarged cardiac silhouette.",
        "The cardiac silhouette is enlarged consistent with cardiomegaly.",
        "Cardiomegaly is present.",
    ),
    "no_finding": (
        "No acute cardiopulmonary abnormality.",
        "Clear lung fields with a normal cardiomediastinal silhouette.",
        "No acute findings.",
    ),
}
RECORD = "struct<image_path:string,messages:array<struct<role:string,content:array<struct<type:string,text:string>>>>>"


def sentence(label: Column, id_col: Column, seed: int, salt: str) -> Column:
    """One of a label's sentences, chosen by the seed, the id, the label and a salt."""
    pick = F.conv(F.substring(seeded(seed, F.concat_ws("|", id_col.cast("string"), label, F.lit(salt))), 1, 4), 16, 10).cast("int") % 3
    table = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in PRESENT.items()))
    return F.get(F.try_element_at(table, label), pick)


def _or_none(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, F.array(F.lit(NO_FINDING))).otherwise(labels)


def draft_text(labels: Column, id_col: Column, seed: int = 0, salt: str = "text", paraphrase=None) -> Column:
    """An impression that names exactly the labels, in canonical order."""
    text = F.array_join(F.transform(_or_none(canonical_sorted(labels, POSITIVE)), lambda x: sentence(x, id_col, seed, salt)), " ")
    return paraphrase(text) if paraphrase else text


def audit_cases(sets: DataFrame, seed: int = 0, id_col: str = "image_id", paraphrase=None) -> DataFrame:
    """Up to three cases for each row of label_sets(): missing, unsupported and faithful.

    id, case_type, labels, draft_labels, corrupted_label, draft_text, draft_findings and
    the three expected flags.  The missing case leaves out the first present label, the
    unsupported one adds the first absent label; a case that cannot be made is left out.
    """
    kinds = F.array_compact(F.array(F.when(F.size("labels") > 0, "missing"), F.when(F.size("absent") > 0, "unsupported"), F.lit("faithful")))
    rows = sets.select(id_col, "labels", "absent", F.explode(kinds).alias("case_type"))
    kind = F.col("case_type")
    corrupted = F.when(kind == "missing", F.get("labels", F.lit(0))).when(kind == "unsupported", F.get("absent", F.lit(0)))
    said = F.when(kind == "missing", F.slice("labels", 2, 1 << 20)).when(kind == "unsupported", F.array_append("labels", F.get("absent", F.lit(0)))).otherwise(F.col("labels"))
    rows = rows.withColumn("corrupted_label", corrupted).withColumn("draft_labels", canonical_sorted(said, POSITIVE))
    found = F.transform(_or_none(F.col("draft_labels")), lambda x: F.struct(x.alias("finding"), F.lit("present").alias("status"), sentence(x, F.concat_ws("|", F.col(id_col).cast("string"), kind), seed, "span").alias("span")))
    text = draft_text(F.col("draft_labels"), F.concat_ws("|", F.col(id_col).cast("string"), kind), seed, "text", paraphrase)
    return rows.select(
        id_col,
        "case_type",
        "labels",
        "draft_labels",
        "corrupted_label",
        text.alias("draft_text"),
        found.alias("draft_findings"),
        canonical_sorted(F.array_except("labels", "draft_labels"), POSITIVE).alias("missing_findings"),
        canonical_sorted(F.array_except("draft_labels", "labels"), POSITIVE).alias("unsupported_claims"),
        canonical_sorted(F.array_intersect("labels", F.array(*map(F.lit, URGENT))), POSITIVE).alias("urgent_review_flags"),
    )


def case_records(cases: DataFrame, id_col: str = "image_id") -> DataFrame:
    """id, json: cases as JSON records."""
    return cases.select(id_col, F.to_json(F.struct(*[c for c in cases.columns])).alias("json"))


def target_element(finding: Column, b: Column, confidence: Column, evidence: Column) -> Column:
    """One JSON object of a target: box_2d is always there, the optional members only if set."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)  # noqa: E731  the array's end bracket is cut below
    text = lambda c: F.expr("''") if c is None else F.left(quoted(c), F.length(quoted(c)) - 1)
    parts = [F.concat(F.lit('"label": '), text(finding)), F.concat(F.lit('"box_2d": '), F.coalesce(F.when(b.isNotNull(), F.concat(F.lit("["), F.array_join(as_list(b).cast("array<string>"), ", "), F.lit("]"))), F.lit("null"))), F.concat(F.lit('"confidence": '), confidence.cast("string")), F.concat(F.lit('"evidence": '), text(evidence))]
    parts[3] = F.when(evidence.isNotNull(), parts[3])
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def target_text(ids: DataFrame, rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """id, target: the JSON list of an image's present positives, or of the sentinel alone."""
    mine = rows.filter((F.col("status") == "present") & F.col("finding").isin(*POSITIVE))
    one = F.struct("ord", target_element(F.col("finding"), F.col("box"), F.col("confidence"), F.col("evidence")).alias("x"))
    # one sort by id serves the lists and the choice of the row that keeps them
    turn = Window.partitionBy(id_col).orderBy("ord")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = mine.select(id_col, F.row_number().over(turn).alias("_turn"), F.array_sort(F.collect_list(one).over(whole)).alias("xs"))
    lists = gathered.filter("_turn = 1").drop("_turn")
    text = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda s: s["x"]), ", "), F.lit("]"))
    none = f'[{{"label": "{NO_FINDING}", "box_2d": null}}]'
    return ids.select(id_col).distinct().join(lists, id_col, "left").select(id_col, F.when(F.col("xs").isNull(), none).otherwise(text).alias("target"))


def chat_record(image_path: Column, prompt: Column, target: Column) -> Column:
    """The two-turn record of an image: an image part and the prompt, then the target."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    turn = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("content"))
    user = turn("user", F.array(part("image", F.lit(None)), part("text", prompt)))
    return F.struct(image_path.alias("image_path"), F.array(user, turn("assistant", F.array(part("text", target)))).alias("messages"))


def assistant_text(messages: Column) -> Column:
    """The first text part of the first assistant turn, wherever it stands."""
    turn = F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))
    return F.get(F.filter(turn["content"], lambda p: p["type"] == "text"), F.lit(0))["text"]


def has_image(messages: Column) -> Column:
    return F.exists(messages, lambda m: F.exists(m["content"], lambda p: p["type"] == "image"))


def record_error(record: Column) -> Column:
    """The first thing that is wrong with a record's shape, or null (targets: see validated)."""
    messages = record["messages"]
    user, other = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))

    def parts(turn: Column, role: str, image: bool) -> list[Column]:
        content = turn["content"]
        out = [
            F.when(content.isNull() | (F.size(content) == 0), f"{role} turn without parts"),
            F.when(F.exists(content, lambda p: ~F.coalesce(p["type"], F.lit("")).isin("image", "text")), f"{role} turn: a part is neither image nor text"),
            F.when(F.exists(content, lambda p: (p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) == "")), f"{role} turn: a text part says nothing"),
            F.when(~F.exists(content, lambda p: p["type"] == "text"), f"{role} turn lacks a text part"),
        ]
        return [*out[:3], F.when(~F.exists(content, lambda p: p["type"] == "image"), f"{role} turn lacks an image part"), out[3]] if image else out

    return F.coalesce(
        F.when(F.coalesce(record["image_path"], F.lit("")) == "", "no image_path"),
        F.when(messages.isNull() | (F.size(messages) != 2), "not a pair of turns"),
        F.when(F.coalesce(user["role"], F.lit("")) != "user", "turn 1 is not by the user"),
        F.when(F.coalesce(other["role"], F.lit("")) != "assistant", "turn 2 is not by the assistant"),
        *parts(user, "user", True),
        *parts(other, "assistant", False),
    )


def validated(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``error``: the first thing wrong with a record's shape, target or labels, or null.

    A target that is a JSON array of known labels as it stands is right; only others are
    scanned for what can be read of them.
    """
    shape = record_error(F.col(record))
    target = F.when(shape.isNull(), assistant_text(F.col(record)["messages"]))
    label = lambda v: F.try_variant_get(v, "$.label", "string")
    known = lambda v: let(label(v), lambda c: normalized_finding(c)).isNotNull()
    items = F.try_variant_get(F.try_parse_json("_target"), "$", "array<variant>")
    right = F.startswith("_target", F.lit("[")) & let(items, lambda xs: (F.size(xs) > 0) & F.forall(xs, known))
    rows = records.withColumn("_shape", shape).withColumn("_target", target).withColumn("_right", F.coalesce(right, F.lit(False)))
    rows = rows.withColumn("_parse", parsed_list(F.when(~F.col("_right"), F.coalesce("_target", F.lit("[]")))))
    wrong = F.exists(F.col("_parse.elements"), lambda e: ~known(F.try_parse_json(e)))
    error = F.coalesce(
        F.col("_shape"),
        F.when(~F.col("_parse.ok"), F.concat(F.lit("target: "), F.col("_parse.error"))),
        F.when(F.size("_parse.elements") == 0, "target: no finding"),
        F.when(wrong, "target: a label outside the vocabulary"),
    )
    return rows.withColumn("error", F.when(~F.col("_right"), error)).drop("_shape", "_target", "_right", "_parse")
