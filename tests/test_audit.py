from __future__ import annotations

import pytest
from auditgrid.functions.geometry import BOX
from auditgrid.operators import audit, findings
from pyspark.sql import functions as F

from helpers import rows

ROWS = f"image_id int, side string, ord int, finding string, status string, box {BOX}, span string"


def table(spark, items):
    return spark.createDataFrame([(i, s, o, f, st, b, sp) for i, s, o, f, st, b, sp in items], ROWS)


# image status, draft status, is it missing, is it unsupported
MATRIX = [
    ("present", None, True, False), ("present", "present", False, False), ("present", "absent", True, False),
    ("absent", None, False, False), ("absent", "present", False, True), ("absent", "absent", False, False),
    (None, "present", False, True), (None, "absent", False, False), (None, None, False, False),
]


def test_status_matrix_and_urgency(spark):
    items, ids = [], []
    for label_no, label in enumerate(("cardiomegaly", "pneumothorax")):
        for n, (i, d, _, _) in enumerate(MATRIX):
            key = label_no * 100 + n
            ids.append((key,))
            items += [(key, s, 0, label, st, None, None) for s, st in (("image", i), ("draft", d)) if st]
    for parts in (1, 7, 64):
        out = {r["image_id"]: r for r in audit.audit(table(spark, items).repartition(parts), spark.createDataFrame(ids, "image_id int")).collect()}
        assert len(out) == len(ids)
        for label_no, label in enumerate(("cardiomegaly", "pneumothorax")):
            for n, (i, _, missing, unsupported) in enumerate(MATRIX):
                r = out[label_no * 100 + n]
                assert (r["missing_findings"] == [label]) == missing
                assert (r["unsupported_claims"] == [label]) == unsupported
                assert r["urgent_review_flags"] == ([label] if label == "pneumothorax" and i == "present" else [])


def test_sentinel_is_never_a_claim_and_lists_are_in_canonical_order(spark):
    items = [(1, "draft", 0, "no_finding", "present", None, None), (1, "image", 0, "cardiomegaly", "present", None, None), (1, "image", 1, "pleural_effusion", "present", None, None), (1, "image", 2, "cardiomegaly", "present", None, None)]
    r = audit.audit(table(spark, items)).head()
    assert r["missing_findings"] == ["pleural_effusion", "cardiomegaly"] and r["unsupported_claims"] == []


def test_detail_takes_the_first_box_and_span(spark):
    b = lambda x: (0.0, 0.0, x, x)
    items = [(1, "image", 2, "nodule_mass", "present", b(0.5), None), (1, "image", 1, "nodule_mass", "present", b(0.25), None), (1, "draft", 5, "cardiomegaly", "present", None, "second"), (1, "draft", 4, "cardiomegaly", "present", None, "first")]
    got = {(r["flag"], r["finding"]): r for r in audit.audit_detail(table(spark, items)).collect()}
    assert set(got) == {("missing", "nodule_mass"), ("urgent", "nodule_mass"), ("unsupported", "cardiomegaly")}
    assert got["missing", "nodule_mass"]["box"]["y1"] == 0.25
    assert got["unsupported", "cardiomegaly"]["span"] == "first"


def test_leader_clusters_are_not_components(spark):
    # the second box overlaps the first and the third, the third does not overlap the first
    boxes = [(0.0, 0.0, 1.0, 0.90), (0.0, 0.0, 1.0, 0.95), (0.0, 0.0, 1.0, 1.0)]
    items = [(1, "image", i, f, "present", b, None) for i, (f, b) in enumerate(zip(("cardiomegaly", "nodule_mass", "cardiomegaly"), boxes, strict=True))]
    got = audit.overlay_regions(audit.evidence(table(spark, items)), 0.94).orderBy("region").collect()
    assert [r["labels"] for r in got] == [["cardiomegaly", "nodule_mass"], ["cardiomegaly"]]
    assert got[0]["category"] == "urgent" and got[0]["urgent"] and got[0]["label"].endswith("(URGENT)")


def test_findings_table_of_a_clear_and_a_busy_image(spark):
    far = [(0.0, 0.0, 0.1, 0.1), (0.5, 0.5, 0.9, 0.9)]
    items = [(2, "image", i, "cardiomegaly", "present", b, None) for i, b in enumerate(far)] + [(2, "draft", 0, "no_finding", "present", None, None), (2, "draft", 1, "pneumothorax", "present", None, None), (2, "draft", 2, "pneumothorax", "absent", None, None)]
    got = audit.findings_table(table(spark, items), spark.createDataFrame([(1,), (2,)], "image_id int"))
    assert rows(got, ["image_id", "finding", "source", "status", "audit_flag"]) == [
        (1, "No finding", "Image", "Present", ""),
        (2, "Cardiomegaly (enlarged heart) (2 foci)", "Image", "Present", "Missing from draft"),
        (2, "Pneumothorax", "Draft", "Absent", ""),
        (2, "Pneumothorax", "Draft", "Present", "Unsupported claim"),
    ]


def test_merged_sources_add_only_what_is_new(spark):
    schema = f"image_id int, ord int, finding string, box {BOX}"
    b = (0.0, 0.0, 0.5, 0.5)
    base = spark.createDataFrame([(1, 0, "cardiomegaly", None), (1, 1, "nodule_mass", b)], schema)
    more = spark.createDataFrame([(1, 0, "cardiomegaly", None), (1, 1, "nodule_mass", None), (1, 2, "nodule_mass", None), (1, 3, None, b), (9, 0, "cardiomegaly", None)], schema)
    got = findings.merged_findings(base, more)
    assert rows(got, ["image_id", "ord", "finding", "source"]) == [(1, 0, "cardiomegaly", 0), (1, 1, "nodule_mass", 0), (1, 1, "nodule_mass", 1)]


@pytest.mark.parametrize("empty", [True, False])
def test_empty_inputs(spark, empty):
    rows_ = table(spark, [])
    ids = spark.createDataFrame([] if empty else [(1,)], "image_id int")
    assert audit.audit(rows_, ids).count() == (0 if empty else 1)
    assert audit.findings_table(rows_, ids).count() == (0 if empty else 1)
    assert audit.audit_detail(rows_).count() == 0


def test_stream_of_cases(spark, tmp_path):
    from auditgrid.streaming import audit_stream

    found = F.array(F.struct(F.lit("image").alias("side"), F.lit(0).alias("ord"), F.lit("cardiomegaly").alias("finding"), F.lit("present").alias("status"), F.lit(None).cast(BOX).alias("box"), F.lit(None).cast("string").alias("span")))
    spark.range(3).select(F.col("id").alias("image_id"), found.alias("findings")).write.parquet(str(tmp_path / "in"))
    q = audit_stream.start(spark.readStream.schema(audit_stream.CASE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert {tuple(r["missing_findings"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("cardiomegaly",)}
