"""The audit: what an image shows against what a draft says, per image.

Every query is one aggregation by image (and label): the two sides are a union with a
side column, so the plan has one shuffle and no join.  A label counts once for each side:
a side's labels are a sum of bits, and ids that must have a row come as rows of no side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, iou
from ..functions.scalars import combined_label
from ..functions.vocab import DISPLAY_NAMES, NO_FINDING, POSITIVE, URGENT, canonical_ord, display_name, label_bit, labels_of

SIDES = ("image", "draft")
FLAGS = ("missing_findings", "unsupported_claims", "urgent_review_flags")


def sides(image: DataFrame, draft: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Both sides' findings as rows: id, side, ord, finding, status, box, span."""
    a = image.select(id_col, F.lit("image").alias("side"), "ord", "finding", "status", "box", F.lit(None).cast("string").alias("span"))
    b = draft.select(id_col, F.lit("draft").alias("side"), "ord", "finding", "status", F.lit(None).cast(image.schema["box"].dataType).alias("box"), "span")
    return a.unionByName(b)


def with_ids(rows: DataFrame, ids: DataFrame | None, id_col: str) -> DataFrame:
    """The rows and one of nulls for each of ``ids``, with ``_asked``: whether a row is such a one, or ids are not given.

    A group of an id is asked for if one of its rows is; null ids match no rows.
    """
    if ids is None:
        return rows.withColumn("_asked", F.lit(True))
    known = rows.filter(F.col(id_col).isNotNull()).withColumn("_asked", F.lit(False))
    return known.unionByName(ids.select(id_col, F.lit(True).alias("_asked")), allowMissingColumns=True)


def _held(side: str) -> Column:
    return (F.col("side") == side) & (F.col("status") == "present") & F.col("finding").isin(*POSITIVE)


def audit(rows: DataFrame, ids: DataFrame | None = None, id_col: str = "image_id", spans: bool = False) -> DataFrame:
    """id and the three flag arrays, in canonical order; a row for each of ``ids`` if given.

    With ``spans`` also ``unsupported_spans``: the words of the draft behind each unsupported
    claim (those of the label's first present row), null where it quotes none.
    """
    sets = [F.bit_or(F.when(_held(s), label_bit(F.col("finding")))).alias(s) for s in SIDES]
    first = [F.min(F.when(_held("draft") & (F.col("finding") == x), F.struct("ord", "span")))["span"] for x in POSITIVE] if spans else []
    used = rows.select(id_col, "side", "finding", "status", *(["ord", "span"] if spans else []))
    said = [c.alias(f"_span_{i}") for i, c in enumerate(first)]
    per = with_ids(used, ids, id_col).groupBy(id_col).agg(*sets, F.max("_asked").alias("_asked"), *said).filter("_asked")
    return per.select(id_col, *flags_of(F.col("image"), F.col("draft"), [F.col(f"_span_{i}") for i in range(len(first))]))


def flags_of(image: Column, draft: Column, spans: list[Column]) -> list[Column]:
    """The three flag arrays of both sides' sets of bits; with the draft's words for each positive label also unsupported_spans."""
    a, b = (F.coalesce(c, F.lit(0)) for c in (image, draft))
    urgent = sum(1 << POSITIVE.index(x) for x in URGENT)
    claims = labels_of(b.bitwiseAND(F.bitwise_not(a)))
    flags = [labels_of(a.bitwiseAND(F.bitwise_not(b))), claims, labels_of(a.bitwiseAND(F.lit(urgent)))]
    quoted = [F.transform(claims, lambda x: F.get(F.array(*spans), canonical_ord(x))).alias("unsupported_spans")] if spans else []
    return [*(c.alias(f) for c, f in zip(flags, FLAGS, strict=True)), *quoted]


def audit_detail(rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """A row for each flag: id, flag, finding, urgent, box (of the image), span (of the draft).

    The box and span are those of the label's first present row.
    """
    first = lambda side, col: F.min(F.when(_held(side), F.struct("ord", col)))
    per = rows.groupBy(id_col, "finding").agg(first("image", "box").alias("i"), first("draft", "span").alias("d"))
    has_i, has_d, urgent = F.col("i").isNotNull(), F.col("d").isNotNull(), F.col("finding").isin(*URGENT)
    flags = F.array_compact(F.array(F.when(has_i & ~has_d, "missing"), F.when(has_d & ~has_i, "unsupported"), F.when(has_i & urgent, "urgent")))
    out = per.select(id_col, "finding", urgent.alias("urgent"), F.col("i.box").alias("box"), F.col("d.span").alias("span"), F.explode(flags).alias("flag"))
    return out.select(id_col, "flag", "finding", "urgent", F.when(F.col("flag") != "unsupported", F.col("box")).alias("box"), F.when(F.col("flag") == "unsupported", F.col("span")).alias("span"), canonical_ord(F.col("finding")).alias("canonical_ord"))


def flag_rows(audits: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Audits as rows (id, flag, finding)."""
    maps = F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.col(f))])
    return audits.select(id_col, F.explode(maps).alias("flag", "findings")).select(id_col, "flag", F.explode(F.array_distinct("findings")).alias("finding"))


CATEGORIES = ("supported", "missing", "unsupported", "urgent")  # by severity


def evidence(rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Present image findings with a category: urgent over missing over supported."""
    drafted = F.max(_held("draft").cast("int"))
    said = rows.groupBy(id_col, "finding").agg(drafted.alias("said"))
    mine = rows.filter(_held("image")).join(said, [id_col, "finding"])
    category = F.when(F.col("finding").isin(*URGENT), "urgent").when(F.col("said") == 0, "missing").otherwise("supported")
    return mine.select(id_col, "ord", "finding", "box", category.alias("category"), F.col("finding").isin(*URGENT).alias("urgent"))


def overlay_regions(items: DataFrame, threshold: float = 0.9, id_col: str = "image_id") -> DataFrame:
    """Leader clusters: an item joins the first region whose first box it overlaps, else opens one.

    id, region (from 1), box, category (the most severe), labels (first seen first), urgent,
    label.  A fold over an image's items in order; the time grows with their square.
    """
    item = F.struct("ord", "finding", "box", severity_of(F.col("category")).alias("severity"), "urgent")
    lists = items.filter("box IS NOT NULL").groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("items"))
    regions = lists.select(id_col, F.posexplode(region_fold(F.col("items"), threshold)).alias("at", "r"))
    names = F.array(*map(F.lit, CATEGORIES))
    return regions.select(id_col, (F.col("at") + 1).cast("long").alias("region"), "r.box", F.element_at(names, F.col("r.severity")).alias("category"), "r.labels", "r.urgent", combined_label(F.col("r.labels"), F.col("r.urgent")).alias("label"))


def severity_of(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category).cast("int")


def region_fold(items: Column, threshold: float = 0.9) -> Column:
    """The regions (box, severity, labels, urgent) of an image's items (finding, box, severity, urgent), which are in order."""
    empty = F.array().cast("array<struct<box:struct<y0:double,x0:double,y1:double,x1:double>,severity:int,labels:array<string>,urgent:boolean>>")

    def region(box, severity, labels, urgent):
        return F.struct(box.alias("box"), severity.alias("severity"), labels.alias("labels"), urgent.alias("urgent"))

    def step(acc, x):
        at = F.array_position(F.transform(acc, lambda c: iou(c["box"], x["box"]) >= threshold), True)
        joined = F.transform(acc, lambda c, i: F.when(i + 1 == at, region(c["box"], F.greatest(c["severity"], x["severity"]), F.array_distinct(F.array_append(c["labels"], x["finding"])), c["urgent"] | x["urgent"])).otherwise(c))
        return F.when(at > 0, joined).otherwise(F.array_append(acc, region(x["box"], x["severity"], F.array(x["finding"]), x["urgent"])))

    return F.aggregate(items, empty, step)


def foci_counts(regions: DataFrame, id_col: str = "image_id") -> DataFrame:
    """How many regions each label of an image has."""
    return regions.select(id_col, F.explode("labels").alias("finding")).groupBy(id_col, "finding").agg(F.count(F.lit(1)).alias("foci"))


# The phrases of the findings table.
PHRASES = {"supported": "Supported by image", "missing": "Missing from draft", "urgent": "Urgent - review", "unsupported": "Unsupported claim"}


def findings_table(rows: DataFrame, ids: DataFrame, id_col: str = "image_id") -> DataFrame:
    """id, place, finding, source, status, audit_flag: image labels once each, then all draft rows.

    An image with neither has one row that says there is no finding.  Everything of an image
    is told from its one group: rows without an id belong to none.
    """
    used = with_ids(rows.select(id_col, "side", "ord", "finding", "status", "box"), ids, id_col)
    sets = [F.bit_or(F.when(_held(s), label_bit(F.col("finding")))).alias(s) for s in SIDES]
    mine = F.array_sort(F.collect_list(F.when(_held("image"), F.struct("ord", "finding", "box")))).alias("mine")
    claims = F.collect_list(F.when((F.col("side") == "draft") & (F.col("finding") != NO_FINDING), F.struct("ord", "finding", "status"))).alias("claims")
    per = used.groupBy(id_col).agg(*sets, mine, claims, F.max("_asked").alias("_asked"))

    held = lambda x, side: F.coalesce(F.col(side), F.lit(0)).bitwiseAND(label_bit(x)) != 0
    urgent = lambda x: x.isin(*URGENT)
    category = lambda x: F.when(urgent(x), "urgent").when(~held(x, "draft"), "missing").otherwise("supported")
    boxed = F.transform(F.filter("mine", lambda x: x["box"].isNotNull()), lambda x: F.struct(x["finding"].alias("finding"), x["box"].alias("box"), severity_of(category(x["finding"])).alias("severity"), urgent(x["finding"]).alias("urgent")))
    place = rows.schema["ord"].dataType
    phrase = lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in PHRASES.items() for y in kv]), category(x))

    def row(part: int, ord_: Column, *texts: Column) -> Column:
        named = zip(("finding", "source", "status", "audit_flag"), texts, strict=True)
        return F.struct(F.lit(part).alias("part"), ord_.cast(place).alias("ord"), *[t.alias(n) for n, t in named])

    def image(x: Column) -> Column:
        foci = F.size(F.filter("regions", lambda r: F.array_contains(r["labels"], x)))
        name = F.concat(display_name(x), F.when(foci > 1, F.concat(F.lit(" ("), foci.cast("string"), F.lit(" foci)"))).otherwise(""))
        first = F.array_min(F.transform(F.filter("mine", lambda y: y["finding"] == x), lambda y: y["ord"]))
        return row(0, first, name, F.lit("Image"), F.lit("Present"), phrase(x))

    def draft(x: Column) -> Column:
        wrong = (x["status"] == "present") & ~held(x["finding"], "image")
        return row(1, x["ord"], display_name(x["finding"]), F.lit("Draft"), F.initcap(x["status"]), F.when(wrong, PHRASES["unsupported"]).otherwise(""))

    none = F.array(row(0, F.lit(0), F.lit(DISPLAY_NAMES[NO_FINDING]), F.lit("Image"), F.lit("Present"), F.lit("")))
    drawn = per.withColumn("regions", region_fold(boxed))
    listed = F.concat(F.transform(F.array_distinct(F.transform("mine", lambda x: x["finding"])), image), F.transform("claims", draft))
    return drawn.select(id_col, "_asked", listed.alias("_listed")).select(id_col, F.inline(F.when((F.size("_listed") > 0) | ~F.col("_asked"), F.col("_listed")).otherwise(none)))


# The sentences of the panel.
PANEL_LEAD = "**How to read this:** this panel compares what the AI sees in the image against the draft text. It is a research aid, not a diagnosis - always confirm with a qualified radiologist."
PANEL_NOTE = ("**Draft not analyzed:** ", " This audit reflects the image only - re-check the draft text manually.")
PANEL_HEADS = {
    "urgent_review_flags": "### URGENT - needs radiologist review",
    "missing_findings": "### Missing from the draft",
    "unsupported_claims": "### Unsupported claims in the draft",
}
PANEL_LINES = {
    "urgent_review_flags": "is visible on the image and is a can't-miss finding - have a radiologist review it.",
    "missing_findings": "appears on the image but the draft does not report it.",
    "unsupported_claims": "is stated in the draft but the image does not support it",
}
PANEL_AGREE = "### No discrepancies found\nThe draft and the image findings agree across the finding set the tool checks."
DRAFT_NOTE = "The draft text could not be parsed; results show image findings only."
DISCLAIMER = "Research/educational QA only. NOT a medical device, NOT diagnosis, NOT for clinical use. Outputs are frequently wrong; always consult a qualified radiologist."
BOX_FORMAT = "normalized_y0x0y1x1"


def verdict_markdown(audits: DataFrame) -> DataFrame:
    """Add ``panel``: an audit as a short Markdown text, urgent flags first.

    A ``draft_note`` among the columns leads the text where it is not null; with
    ``unsupported_spans`` (see audit) the unsupported claims quote the draft.
    """

    def part(flag: str) -> Column:
        bullet = lambda x: F.concat(F.lit("- **"), display_name(x), F.lit(f"** {PANEL_LINES[flag]}"))
        lines = F.transform(flag, bullet)
        if flag == "unsupported_claims":
            quote = lambda span: F.when(F.coalesce(span, F.lit("")) != "", F.concat(F.lit(' (draft text: "'), span, F.lit('")'))).otherwise("")
            quoted = F.transform("unsupported_spans", quote) if "unsupported_spans" in audits.columns else F.transform(flag, lambda _: F.lit(""))
            lines = F.zip_with(lines, quoted, lambda line, q: F.concat(line, q, F.lit(".")))
        return F.when(F.size(flag) > 0, F.concat(F.lit(f"{PANEL_HEADS[flag]}\n"), F.array_join(lines, "\n")))

    note = F.concat(F.lit(PANEL_NOTE[0]), F.col("draft_note"), F.lit(PANEL_NOTE[1])) if "draft_note" in audits.columns else F.lit(None).cast("string")
    agree = F.when(F.size(F.concat(*FLAGS)) == 0, F.lit(PANEL_AGREE))
    return audits.withColumn("panel", F.concat_ws("\n\n", note, F.lit(PANEL_LEAD), *[part(f) for f in PANEL_HEADS], agree))


def result_json(rows: DataFrame, ids: DataFrame, id_col: str = "image_id", pretty: bool = True) -> DataFrame:
    """id, json: both sides' findings, the audit, the disclaimer and the box format.

    Members that are null are left out; lists are always there.  ``rows`` as of sides();
    ``confidence`` and ``evidence`` of image findings are taken if they are among its columns.
    """
    extra = [c for c in ("confidence", "evidence") if c in rows.columns]
    sides_box = F.when(F.col("box").isNotNull(), F.array(*[F.col(f"box.{n}") for n in AXES])).alias("box")
    shapes = {"image": F.struct("ord", "finding", "status", sides_box, *extra), "draft": F.struct("ord", "finding", "status", "span")}
    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == s, x))).alias(f"{s}_findings") for s, x in shapes.items()]
    found = rows.groupBy(id_col).agg(*lists)
    both = audit(rows, ids, id_col).join(found, id_col, "left")
    members = {"image": ("finding", "status", "box", *extra), "draft": ("finding", "status", "span")}

    def written(side: str) -> Column:
        items = F.transform(f"{side}_findings", lambda x: F.struct(*[x[n].alias(n) for n in members[side]]))
        return F.coalesce(items, F.from_json(F.lit("[]"), _list_type(rows, side, extra))).alias(f"{side}_findings")

    whole = F.struct(*map(written, SIDES), F.struct(*FLAGS).alias("audit"), F.lit(DISCLAIMER).alias("disclaimer"), F.lit(BOX_FORMAT).alias("box_format"))
    return both.select(id_col, F.to_json(whole, {"ignoreNullFields": "true", "pretty": str(pretty).lower()}).alias("json"))


def _list_type(rows: DataFrame, side: str, extra: list[str]) -> str:
    more = "".join(f",{c}:{rows.schema[c].dataType.simpleString()}" for c in extra)
    return {"image": f"array<struct<finding:string,status:string,box:array<double>{more}>>", "draft": "array<struct<finding:string,status:string,span:string>>"}[side]
