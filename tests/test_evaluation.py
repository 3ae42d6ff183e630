from __future__ import annotations

import json

import pytest
from auditgrid.functions import prompts, strict
from auditgrid.operators import evaluation
from auditgrid.sources.readers import FINDING, FLAGS
from pyspark.sql import functions as F


def test_image_and_audit_reports(spark):
    f = lambda x, box=None, status="present": (x, status, box, None, None)
    b = [0.1, 0.1, 0.5, 0.5]
    cases = spark.createDataFrame([("a", [f("Nodule Mass", b)], [f("nodule_mass", b)]), ("b", [], [f("pneumothorax", b)])], f"image_id string, predicted array<{FINDING}>, expected array<{FINDING}>")
    report = evaluation.image_report(cases)
    got = {r["finding"]: r for r in report["presence"].collect()}
    assert (got["nodule_mass"]["tp"], got["pneumothorax"]["fn"]) == (1, 1)
    total = report["localization"].filter("finding IS NULL AND threshold = 0.5").head()
    assert (total["tp"], total["fn"], total["mean_iou"]) == (1, 1, 1.0)
    assert {r["recall"] for r in report["urgent"].collect()} == {0.0, 1.0}
    lines = [r["line"] for r in evaluation.metric_lines(report["presence"], "finding").collect()]
    assert any("n/a" in x for x in lines) and all("tp=" in x for x in lines)
    flags = spark.createDataFrame([("x", (["cardiomegaly"], [], []), (["cardiomegaly"], ["pneumothorax"], []))], f"case_id string, predicted {FLAGS}, expected {FLAGS}")
    got = {r["flag"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.audit_report(flags).collect()}
    assert got == {"missing_findings": (1, 0, 0), "unsupported_claims": (0, 0, 1)}


def test_models_are_held_against_the_same_cases(spark):
    pred = spark.createDataFrame([("m1", "a", "cardiomegaly", "present"), ("m2", "b", "cardiomegaly", "present")], "model_id string, image_id string, finding string, status string")
    gold = spark.createDataFrame([("a", "cardiomegaly", "present")], "image_id string, finding string, status string")
    got = {r["model_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.model_report(pred, gold).filter("finding = 'cardiomegaly'").collect()}
    assert got == {"m1": (1, 0, 0), "m2": (0, 1, 1)}


def test_alignment_labelers_and_composition(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "case_id int, p string"), spark.createDataFrame([(1, "z")], "case_id int, e string")
    assert evaluation.aligned(a.limit(1), b).count() == 1
    with pytest.raises(Exception, match="without a partner"):
        evaluation.aligned(a, b).collect()
    rows = spark.createDataFrame([(1, 0, "Consolidation", "1"), (1, 1, "Lung Opacity", "0"), (1, 2, "Cardiomegaly", "-1"), (1, 3, "Fracture", "1")], "image_id int, ord int, condition string, code string")
    assert [tuple(r) for r in evaluation.labeler_findings(rows).collect()] == [(1, "lung_opacity_consolidation", "absent")]
    sets = spark.createDataFrame([(["pneumothorax"],), ([],)], "labels array<string>")
    assert tuple(evaluation.composition(sets).head())[:3] == (2, 1, 1)


F1 = {"finding": "Pleural Effusion", "box": [0.1, "0.2", 0.3, 0.4]}
STRICT = [
    ({}, None), ({"image_findings": [F1]}, None), ({"image_findings": [{**F1, "box": None, "confidence": None, "status": "absent"}]}, None),
    ({"audit": {"missing_findings": ["any text"]}, "draft_findings": [{"finding": "pneumothorax", "span": "x"}]}, None),
    ({"image_findings": [F1, {**F1, "box": [0.1, 0.2, 0.3]}]}, "box"), ({"image_findings": [{**F1, "box": [0.1, 0.2, 0.3, 1.5]}]}, "box"), ({"image_findings": [{**F1, "box": [0.5, 0.2, 0.3, 0.4]}]}, "box"),
    ({"image_findings": [{**F1, "box": "all"}]}, "box"), ({"image_findings": [{**F1, "confidence": 1.5}]}, "confidence"), ({"image_findings": [{**F1, "confidence": "much"}]}, "confidence"),
    ({"image_findings": [{**F1, "status": "maybe"}]}, "status"), ({"image_findings": [{**F1, "status": None}]}, "status"), ({"image_findings": [{**F1, "evidence": 3}]}, "evidence"), ({"image_findings": [{**F1, "location": "left"}]}, "location"),
    ({"image_findings": [{"box": None}]}, "finding: missing"), ({"image_findings": [{"finding": "tumour"}]}, "canonical"), ({"image_findings": [{"finding": 4}]}, "string"), ({"image_findings": [None]}, "object"), ({"image_findings": ["x"]}, "object"),
    ({"image_findings": {}}, "list"), ({"draft_findings": [{"finding": "pneumothorax", "box": None}]}, "box"), ({"audit": None}, "object"), ({"audit": {"more": []}}, "more"), ({"audit": {"missing_findings": [1]}}, "string"), ({"disclaimer": None}, "string"), ({"x": 1}, "x"),
]


def test_strict_results(spark):
    texts = [f"so: {json.dumps(v)} done" for v, _ in STRICT] + ["none", '{"a": 1,}', None, '{"image_findings": [{"finding": "pneumothorax", "confidence": NaN}]}', '{"audit": {}, "audit": {"x": 1}}']
    wrong = [w for _, w in STRICT] + ["no JSON", "invalid", "no text", "confidence", "x"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strict.strict_result(F.col("t"), "D", "B").alias("r")).orderBy("i").collect()
    for text, why, r in zip(texts, wrong, got, strict=True):
        assert r["r"]["ok"] == (why is None), (text, r["r"])
        assert why is None or why in r["r"]["error"], (text, r["r"]["error"])
        assert (r["r"]["result"] is None) == (why is not None)
    bare, one = got[0]["r"]["result"], got[1]["r"]["result"]
    assert (bare["image_findings"], bare["draft_findings"], tuple(bare["audit"]), bare["disclaimer"], bare["box_format"]) == ([], [], ([], [], []), "D", "B")
    assert tuple(one["image_findings"][0]) == ("pleural_effusion", "present", [0.1, 0.2, 0.3, 0.4], None, None)
    assert got[3]["r"]["result"]["audit"]["missing_findings"] == ["any text"]


def test_prompts(spark):
    drafts = spark.createDataFrame([(" Clear. ", 2)], "d string, n int")
    text = drafts.select(prompts.attempt_prompt(prompts.draft_prompt(F.col("d")), F.col("n"))).head()[0]
    assert "\nClear.\n" in text and "cardiomegaly" in text and text.endswith("alone.")
    with pytest.raises(Exception, match="must not be empty"):
        drafts.select(prompts.draft_prompt(F.lit("  "))).collect()
