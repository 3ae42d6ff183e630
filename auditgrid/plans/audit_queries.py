"""Registered queries of audit, evidence and text rules, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vocab
from ..functions.geometry import AXES, from_pixels, to_pixels
from ..operators import audit, findings
from .derive import BOXES_SQL, POSITIVE_LIST, POSITIVES, boxes, images, iou_sql, side, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: str):
    return F.array_join(c, ",")


_AUDIT_SQL = f"""{BOXES_SQL}, held AS (SELECT DISTINCT image_id, side, finding FROM b WHERE status = 'present' AND finding IN {POSITIVES}),
sets AS (
  SELECT image_id, coalesce(list(finding) FILTER (WHERE side = 'image'), []) AS i, coalesce(list(finding) FILTER (WHERE side = 'draft'), []) AS d FROM held GROUP BY image_id
), audits AS (
  SELECT o_orderkey AS image_id,
         list_filter({POSITIVE_LIST}, lambda x: list_contains(coalesce(i, []), x) AND NOT list_contains(coalesce(d, []), x)) AS missing_findings,
         list_filter({POSITIVE_LIST}, lambda x: list_contains(coalesce(d, []), x) AND NOT list_contains(coalesce(i, []), x)) AS unsupported_claims,
         list_filter({POSITIVE_LIST}, lambda x: list_contains(coalesce(i, []), x) AND x IN ('pneumothorax', 'nodule_mass')) AS urgent_review_flags
  FROM orders LEFT JOIN sets ON image_id = o_orderkey
)"""


@query(f"""WITH {_AUDIT_SQL} SELECT image_id, array_to_string(missing_findings, ',') AS missing_findings,
array_to_string(unsupported_claims, ',') AS unsupported_claims, array_to_string(urgent_review_flags, ',') AS urgent_review_flags FROM audits""")
def audit_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.audit(boxes(spark, sf_dir), images(spark, sf_dir))
    return out.select("image_id", *[joined(f).alias(f) for f in audit.FLAGS])


def _flags(name: str, where: str):
    box = "" if name == "unsupported" else ", ".join(f"i.{a} AS {a}" for a in AXES)
    extra = "d.span AS span" if name == "unsupported" else box
    SQL[f"audit_{name}"] = f"""WITH {BOXES_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY image_id, side, finding ORDER BY ord) AS n FROM b WHERE status = 'present' AND finding IN {POSITIVES}),
i AS (SELECT * FROM p WHERE n = 1 AND side = 'image'), d AS (SELECT * FROM p WHERE n = 1 AND side = 'draft')
SELECT coalesce(i.image_id, d.image_id) AS image_id, coalesce(i.finding, d.finding) AS finding, {extra}
FROM i FULL JOIN d ON i.image_id = d.image_id AND i.finding = d.finding WHERE {where}"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = audit.audit_detail(boxes(spark, sf_dir)).filter(F.col("flag") == name)
        return rows.select("image_id", "finding", *(["span"] if name == "unsupported" else [f"box.{a}" for a in AXES]))

    QUERIES[f"audit_{name}"] = run


_flags("missing", "d.image_id IS NULL")
_flags("unsupported", "i.image_id IS NULL")
_flags("urgent", "i.finding IN ('pneumothorax', 'nodule_mass')")


@query(f"""WITH {BOXES_SQL} SELECT image_id, finding, status, ord FROM (
SELECT *, row_number() OVER (PARTITION BY image_id, finding, status ORDER BY ord) AS n FROM b WHERE side = 'draft') WHERE n = 1""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = side(boxes(spark, sf_dir), "draft")
    return findings.first_wins(rows, ["image_id", "finding", "status"], ["ord"]).select("image_id", "finding", "status", "ord")


_NATIVE = ("Pleural effusion", " NODULE/mass ", "No finding", "ILD", "lung-opacity", "Lung Opacity", "consolidation", "unknown")
_NATIVE_SQL = "[" + ", ".join(f"'{x}'" for x in _NATIVE) + "]"
_MAP_SQL = ", ".join("('{}', {})".format(k, f"'{v}'" if v else "NULL") for k, v in vocab.LABEL_MAPS["vindr"].items())


@query(f"""WITH m(k, v) AS (VALUES {_MAP_SQL}), p AS (SELECT p_partkey, {_NATIVE_SQL}[p_partkey % 8 + 1] AS native FROM part)
SELECT p_partkey, native, v AS finding, k IS NOT NULL AS known FROM p LEFT JOIN m ON lower(trim(native)) = k""")
def label_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = F.get(F.array(*map(F.lit, _NATIVE)), (F.col("p_partkey") % len(_NATIVE)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", native.alias("native"))
    known = F.lower(vocab.stripped(F.col("native"))).isin(*vocab.LABEL_MAPS["vindr"])
    return vocab.mapped_label(rows, "native", "vindr").withColumn("known", known)


_WRITTEN = ("Pleural Effusion", " nodule-mass", "NO  FINDING", "cardio megaly", "lung opacity - consolidation", "Pneumothorax\t", "")


@query(
    """WITH p AS (SELECT p_partkey, ['Pleural Effusion', ' nodule-mass', 'NO  FINDING', 'cardio megaly', 'lung opacity - consolidation', 'Pneumothorax' || chr(9), ''][p_partkey % 7 + 1] || CASE WHEN p_size > 45 THEN p_type ELSE '' END AS s FROM part),
n AS (SELECT p_partkey, regexp_replace(lower(regexp_replace(s, '^\\s+|\\s+$', '', 'g')), '[\\s\\-]+', '_', 'g') AS f FROM p)
SELECT p_partkey, CASE WHEN f IN ('pleural_effusion', 'pneumothorax', 'lung_opacity_consolidation', 'nodule_mass', 'cardiomegaly', 'no_finding') THEN f END AS finding FROM n"""
)
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.get(F.array(*map(F.lit, _WRITTEN)), (F.col("p_partkey") % len(_WRITTEN)).cast("int")), F.when(F.col("p_size") > 45, F.col("p_type")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", vocab.normalized_finding(text).alias("finding"))


@query(
    f"""WITH {BOXES_SQL} SELECT DISTINCT finding, {{}} FROM b""".format(
        "CASE finding " + " ".join(f"WHEN '{x}' THEN '{n}'" for x, n in vocab.DISPLAY_NAMES.items()) + " END AS display_name, "
        "CASE finding " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(vocab.MOST_SPECIFIC_FIRST)) + " ELSE 5 END AS specificity_rank, "
        "CASE finding " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(vocab.CANONICAL)) + " END AS canonical_ord, finding IN ('pneumothorax', 'nodule_mass') AS is_urgent"
    )
)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("finding")
    return boxes(spark, sf_dir).select("finding").distinct().select("finding", vocab.display_name(f).alias("display_name"), vocab.specificity_rank(f).alias("specificity_rank"), vocab.canonical_ord(f).alias("canonical_ord"), vocab.is_urgent(f).alias("is_urgent"))


@query(f"""WITH {BOXES_SQL} SELECT image_id, ord, round(x0 * 1024, 6) AS x_min, round(y0 * 2048, 6) AS y_min, round(x1 * 1024, 6) AS x_max, round(y1 * 2048, 6) AS y_max FROM b""")
def box_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = to_pixels(F.col("box"), F.lit(1024), F.lit(2048))
    return boxes(spark, sf_dir).select("image_id", "ord", *[F.round(p[n], 6).alias(n) for n in ("x_min", "y_min", "x_max", "y_max")])


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
round(greatest(0, least(1, l_quantity * 10 / CAST(400 AS DOUBLE))), 6) AS y0, round(greatest(0, least(1, (l_discount * 1000 - 20) / CAST(60 AS DOUBLE))), 6) AS x0,
round(greatest(0, least(1, l_quantity * 12 / CAST(400 AS DOUBLE))), 6) AS y1, round(greatest(0, least(1, (l_discount * 1000 + 20) / CAST(60 AS DOUBLE))), 6) AS x1 FROM lineitem"""
)
def pixels_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    b = from_pixels(d * 1000 - 20, q * 10, d * 1000 + 20, q * 12, F.lit(60), F.lit(400))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *[F.round(b[n], 6).alias(n) for n in AXES])


_HELD = f"""held AS (SELECT image_id, list(DISTINCT finding) AS h FROM b WHERE status = 'present' AND finding IN {POSITIVES} GROUP BY image_id),
sets AS (SELECT o_orderkey AS image_id, list_filter({POSITIVE_LIST}, lambda x: list_contains(coalesce(h, []), x)) AS labels,
  CASE WHEN len(coalesce(h, [])) = 0 THEN 'no_finding' ELSE array_to_string(list_sort(h), '+') END AS signature, len(coalesce(h, [])) = 0 AS is_normal FROM orders LEFT JOIN held ON image_id = o_orderkey)"""


@query(f"WITH {BOXES_SQL}, {_HELD} SELECT image_id, array_to_string(labels, ',') AS labels, signature, is_normal FROM sets")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.label_sets(images(spark, sf_dir), boxes(spark, sf_dir)).select("image_id", joined("labels").alias("labels"), "signature", "is_normal")


_EVIDENCE_SQL = f"""drafted AS (SELECT DISTINCT image_id, finding FROM b WHERE side = 'draft' AND status = 'present'),
ev AS (SELECT b.*, CASE WHEN finding IN ('pneumothorax', 'nodule_mass') THEN 3 WHEN drafted.image_id IS NULL THEN 1 ELSE 0 END AS sev
  FROM b LEFT JOIN drafted USING (image_id, finding) WHERE side = 'image' AND status = 'present' AND finding IN {POSITIVES})"""


@query(f"""WITH {BOXES_SQL}, {_EVIDENCE_SQL} SELECT image_id, ord, finding, ['supported', 'missing', 'unsupported', 'urgent'][sev + 1] AS category FROM ev""")
def image_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.evidence(boxes(spark, sf_dir)).select("image_id", "ord", "finding", "category")


# Leaders come from a fold over an image's items; each item belongs to the first leader that it overlaps.
_REGIONS_SQL = f"""{_EVIDENCE_SQL}, e AS (SELECT *, {{'y0': y0, 'x0': x0, 'y1': y1, 'x1': x1}} AS bx FROM ev WHERE y0 IS NOT NULL),
leaders AS (SELECT image_id, list_reduce(list([bx] ORDER BY ord), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: {iou_sql("a", "x[1]")} >= 0.9)) > 0 THEN acc ELSE list_concat(acc, x) END) AS ls FROM e GROUP BY image_id),
assigned AS (SELECT e.*, ls, list_filter(range(1, len(ls) + 1), lambda k: {iou_sql("ls[k]", "bx")} >= 0.9)[1] AS region FROM e JOIN leaders USING (image_id))"""
_NAMES_SQL = "map {" + ", ".join(f"'{x}': '{n}'" for x, n in vocab.DISPLAY_NAMES.items()) + "}"


@query(f"""WITH {BOXES_SQL}, {_REGIONS_SQL}, named AS (SELECT image_id, region, finding, min(ord) AS first FROM assigned GROUP BY ALL),
texts AS (SELECT image_id, region, string_agg(finding, ',' ORDER BY first) AS labels, string_agg({_NAMES_SQL}[finding], ' / ' ORDER BY first) AS names FROM named GROUP BY image_id, region),
r AS (SELECT image_id, region, any_value(ls[region]) AS bx, max(sev) AS sev, bool_or(finding IN ('pneumothorax', 'nodule_mass')) AS urgent FROM assigned GROUP BY image_id, region)
SELECT image_id, region, bx.y0 AS y0, bx.x0 AS x0, bx.y1 AS y1, bx.x1 AS x1, ['supported', 'missing', 'unsupported', 'urgent'][sev + 1] AS category, labels, urgent, names || CASE WHEN urgent THEN ' (URGENT)' ELSE '' END AS label FROM r JOIN texts USING (image_id, region)""")
def overlay_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.overlay_regions(audit.evidence(boxes(spark, sf_dir)))
    return out.select("image_id", "region", *[F.col(f"box.{a}") for a in AXES], "category", joined("labels").alias("labels"), "urgent", "label")


@query(f"WITH {BOXES_SQL}, {_REGIONS_SQL} SELECT image_id, finding, count(DISTINCT region) AS foci FROM assigned GROUP BY image_id, finding")
def foci_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.foci_counts(audit.overlay_regions(audit.evidence(boxes(spark, sf_dir))))


@query(f"""WITH {BOXES_SQL}, {_REGIONS_SQL}, foci AS (SELECT image_id, finding, count(DISTINCT region) AS n FROM assigned GROUP BY ALL),
one AS (SELECT image_id, finding, min(ord) AS ord, max(sev) AS sev FROM ev GROUP BY image_id, finding),
img AS (SELECT one.image_id, 0 AS part, ord, {_NAMES_SQL}[one.finding] || CASE WHEN n > 1 THEN ' (' || n || ' foci)' ELSE '' END AS finding, 'Image' AS source, 'Present' AS status, ['Supported by image', 'Missing from draft', '', 'Urgent - review'][sev + 1] AS audit_flag
  FROM one LEFT JOIN foci ON foci.image_id = one.image_id AND foci.finding = one.finding),
seen AS (SELECT DISTINCT image_id, finding FROM b WHERE side = 'image' AND status = 'present'),
dr AS (SELECT b.image_id, 1 AS part, b.ord, {_NAMES_SQL}[b.finding] AS finding, 'Draft' AS source, CASE status WHEN 'present' THEN 'Present' ELSE 'Absent' END AS status, CASE WHEN status = 'present' AND s.image_id IS NULL THEN 'Unsupported claim' ELSE '' END AS audit_flag
  FROM b LEFT JOIN seen s ON s.image_id = b.image_id AND s.finding = b.finding WHERE side = 'draft' AND b.finding <> 'no_finding'),
listed AS (SELECT * FROM img UNION ALL SELECT * FROM dr)
SELECT * FROM listed UNION ALL SELECT DISTINCT o_orderkey, 0, 0, 'No finding', 'Image', 'Present', '' FROM orders WHERE o_orderkey NOT IN (SELECT image_id FROM listed)""")
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings_table(boxes(spark, sf_dir), images(spark, sf_dir))


@query(f"""WITH {BOXES_SQL}, drafts AS (SELECT * FROM b WHERE side = 'draft' AND finding <> 'no_finding'),
seen AS (SELECT DISTINCT image_id, finding FROM b WHERE side = 'image' AND status = 'present')
SELECT d.image_id, d.ord, d.finding, d.status, CASE WHEN d.status = 'present' AND s.image_id IS NULL THEN 'Unsupported claim' ELSE '' END AS audit_flag
FROM drafts d LEFT JOIN seen s ON s.image_id = d.image_id AND s.finding = d.finding""")
def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    raw = side(rows, "draft").filter(F.col("finding") != "no_finding").select("image_id", "ord", "finding", "status")
    flagged = audit.findings_table(rows, images(spark, sf_dir)).filter("source = 'Draft'").select("image_id", "ord", "audit_flag")
    return raw.join(flagged, ["image_id", "ord"])


_q = lambda text: text.replace("'", "''")
_LINES_SQL = "list_transform({0}, lambda x: '- **' || " + _NAMES_SQL + "[x] || '** {1}')"


def _part_sql(flag: str) -> str:
    lines = _LINES_SQL.replace("{0}", flag).replace("{1}", _q(audit.PANEL_LINES[flag]))
    if flag == "unsupported_claims":
        span = "map_extract(spans, x)[1]"
        lines = lines[:-1] + f" || CASE WHEN coalesce({span}, '') <> '' THEN ' (draft text: \"' || {span} || '\")' ELSE '' END || '.')"
    return f"CASE WHEN len({flag}) > 0 THEN '{_q(audit.PANEL_HEADS[flag])}' || chr(10) || array_to_string({lines}, chr(10)) END"


_PANEL_SQL = f"""concat_ws(chr(10) || chr(10), CASE WHEN image_id % 4 = 0 THEN '{audit.PANEL_NOTE[0]}{audit.DRAFT_NOTE}{audit.PANEL_NOTE[1]}' END, '{_q(audit.PANEL_LEAD)}',
{", ".join(_part_sql(f) for f in audit.PANEL_HEADS)}, CASE WHEN len(missing_findings) + len(unsupported_claims) + len(urgent_review_flags) = 0 THEN replace('{_q(audit.PANEL_AGREE)}', chr(92) || 'n', chr(10)) END)"""


@query(f"""WITH {_AUDIT_SQL}, first AS (SELECT image_id, finding, arg_min(coalesce(CASE WHEN ord % 3 <> 0 THEN span END, ''), ord) AS span FROM b WHERE side = 'draft' AND status = 'present' GROUP BY image_id, finding),
said AS (SELECT image_id, map(list(finding), list(span)) AS spans FROM first GROUP BY image_id)
SELECT a.image_id, {_PANEL_SQL.replace("image_id % 4", "a.image_id % 4")} AS panel FROM audits a LEFT JOIN said ON said.image_id = a.image_id""")
def verdict_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels with quotes; every third draft row quotes nothing, every fourth image has an unread draft's note."""
    rows = boxes(spark, sf_dir).withColumn("span", F.when(F.col("ord") % 3 != 0, F.col("span")))
    audits = audit.audit(rows, images(spark, sf_dir), spans=True)
    noted = audits.withColumn("draft_note", F.when(F.col("image_id") % 4 == 0, audit.DRAFT_NOTE))
    return audit.verdict_markdown(noted).select("image_id", "panel")


@query(f"""WITH {_AUDIT_SQL}, n AS (SELECT image_id, count(*) FILTER (WHERE side = 'image') AS n_image, count(*) FILTER (WHERE side = 'draft') AS n_draft,
count(y0) FILTER (WHERE side = 'image') AS n_boxes, coalesce(string_agg(finding || ' ' || status, ',' ORDER BY ord) FILTER (WHERE side = 'image'), '') AS image_findings,
coalesce(string_agg(finding || ' ' || status || ' ' || span, ',' ORDER BY ord) FILTER (WHERE side = 'draft'), '') AS draft_findings, round(sum(y0 + x0 + y1 + x1) FILTER (WHERE side = 'image'), 6) AS sides FROM b GROUP BY image_id)
SELECT a.image_id, 'audit,box_format,disclaimer,draft_findings,image_findings' AS members, coalesce(n_image, 0) AS n_image, coalesce(n_draft, 0) AS n_draft, coalesce(n_boxes, 0) AS n_boxes, coalesce(image_findings, '') AS image_findings,
coalesce(draft_findings, '') AS draft_findings, sides, array_to_string(missing_findings, ',') AS missing_findings, array_to_string(unsupported_claims, ',') AS unsupported_claims,
array_to_string(urgent_review_flags, ',') AS urgent_review_flags, '{audit.DISCLAIMER}' AS disclaimer, '{audit.BOX_FORMAT}' AS box_format FROM audits a LEFT JOIN n ON n.image_id = a.image_id""")
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole results written as JSON and read back member by member; `n_boxes` counts the boxes that are written."""
    written = audit.result_json(boxes(spark, sf_dir), images(spark, sf_dir))
    kinds = "image_findings array<struct<finding:string,status:string,box:array<double>>>, draft_findings array<struct<finding:string,status:string,span:string>>"
    flags = ",".join(f"{f}:array<string>" for f in audit.FLAGS)
    r = F.from_json("json", f"{kinds}, audit struct<{flags}>, disclaimer string, box_format string")
    rows = written.withColumn("r", r)
    found = F.filter("r.image_findings", lambda x: x["box"].isNotNull())
    total = F.aggregate(F.flatten(F.transform(found, lambda x: x["box"])), F.lit(0.0), lambda acc, v: acc + v)
    said = lambda x, *names: F.concat_ws(" ", *[x[n] for n in names])
    return rows.select(
        "image_id",
        F.array_join(F.array_sort(F.json_object_keys("json")), ",").alias("members"),
        F.size("r.image_findings").cast("long").alias("n_image"),
        F.size("r.draft_findings").cast("long").alias("n_draft"),
        F.size(found).cast("long").alias("n_boxes"),
        joined(F.transform("r.image_findings", lambda x: said(x, "finding", "status"))).alias("image_findings"),
        joined(F.transform("r.draft_findings", lambda x: said(x, "finding", "status", "span"))).alias("draft_findings"),
        F.when(F.size(found) > 0, F.round(total, 6)).alias("sides"),
        *[joined(f"r.audit.{f}").alias(f) for f in audit.FLAGS],
        "r.disclaimer",
        "r.box_format",
    )


@query(
    """WITH e AS (SELECT doc_id, replace(replace(replace(replace(replace('**' || source || '** `' || coalesce(lang, '?') || '` ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(t, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g'), '`([^`]+)`', '<code>\\1</code>', 'g') AS html FROM e"""
)
def html_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("**"), "source", F.lit("** `"), F.coalesce("lang", F.lit("?")), F.lit("` "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.inline_html(text).alias("html"))


_TITLES = ("ZeroGPU quota exceeded", "ZeroGPU worker error", "Quota reached", "", "ZeroGPU queue timeout")
_BODIES = ("GPU task aborted", "SchemaParseError", "over quota", "ValueError")
_CLASSES = ("Error", "RuntimeError", "Error", "SchemaParseError")


@query(
    """WITH e AS (SELECT event_id, ['Error', 'RuntimeError', 'Error', 'SchemaParseError'][event_id % 4 + 1] AS c,
['ZeroGPU quota exceeded', 'ZeroGPU worker error', 'Quota reached', '', 'ZeroGPU queue timeout'][user_id % 5 + 1] AS t,
['GPU task aborted', 'SchemaParseError', 'over quota', 'ValueError'][event_id // 4 % 4 + 1] AS b FROM events)
SELECT event_id, CASE WHEN c = 'SchemaParseError' THEN 'parse'
WHEN c = 'Error' AND (t IN ('ZeroGPU quota exceeded', 'ZeroGPU illegal duration', 'ZeroGPU pending credits exceeded', 'ZeroGPU queue timeout', 'ZeroGPU client error') OR lower(t) LIKE '%quota%' OR lower(b) LIKE '%quota%') THEN 'quota'
WHEN c = 'Error' AND b LIKE '%GPU task aborted%' THEN 'interrupted' WHEN c = 'Error' AND t = 'ZeroGPU worker error' AND b = 'SchemaParseError' THEN 'parse' ELSE 'other' END AS category FROM e"""
)
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", pick(_CLASSES, i % 4).alias("c"), pick(_TITLES, F.col("user_id") % 5).alias("t"), pick(_BODIES, F.floor(i / 4) % 4).alias("b"))
    return rows.select("event_id", scalars.error_category(F.col("c"), F.col("t"), F.col("b")).alias("category"))


@query(
    """SELECT event_id, CASE WHEN value IS NULL THEN 'n/a' ELSE printf('%.3f', value) END AS metric,
CASE WHEN event_id % 3 = 0 THEN 'present' WHEN event_id % 3 = 1 THEN 'absent' END AS labeler,
CASE WHEN lower(event_type) = 'click' THEN 'absent' ELSE 'present' END AS status,
CASE WHEN value BETWEEN 0 AND 1 THEN value END AS confidence FROM events"""
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(F.lit("1"), F.lit("0"), F.lit("-1")), (F.col("event_id") % 3).cast("int"))
    status = F.when(F.lower("event_type") == "click", " ABSENT\t").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", scalars.formatted_metric(F.col("value")).alias("metric"), scalars.labeler_status(code).alias("labeler"), scalars.coerced_status(status).alias("status"), scalars.coerced_confidence(F.col("value").cast("string")).alias("confidence"))
