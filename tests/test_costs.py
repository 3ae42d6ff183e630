"""Plans of queries whose cost a row or memory a task was too high at size."""

from __future__ import annotations

import re

import pytest
from auditgrid.plans import registry
from pyspark.sql import functions as F

from helpers import duck, rows

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_pixels_are_made_and_summed_without_patterns(spark):
    text = plan(spark, "windowed_images")
    assert "regexp_replace" not in text and "split(" not in text


def test_presence_reads_labels_and_no_boxes(spark):
    assert "box_2d" not in plan(spark, "model_presence")
    out = registry.QUERIES["model_urgent_recall"](spark, SF)
    assert out.count() == 6


def test_findings_are_dealt_by_image_once(spark):
    from auditgrid.plans.derive import boxes

    rows = boxes(spark, SF).groupBy("image_id").agg({"ord": "max"})
    physical = rows._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_labels_as_they_stand_or_in_another_case_and_by_pattern(spark):
    from auditgrid.functions.vocab import normalized_finding, stripped

    texts = ["cardiomegaly", "CARDIOMEGALY", " Nodule-Mass ", "x", "", None, "pleural  effusion"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in rows.select(normalized_finding(rows.t), stripped(rows.t)).collect()]
    assert got == [("cardiomegaly", "cardiomegaly"), ("cardiomegaly", "CARDIOMEGALY"), ("nodule_mass", "Nodule-Mass"), (None, "x"), (None, ""), (None, None), ("pleural_effusion", "pleural  effusion")]


def test_boxes_of_an_image_are_read_once(spark):
    for name in ("merge_same_label_boxes", "cross_label_resolution"):
        assert plan(spark, name).count("Window [row_number()") == 1


def test_images_go_to_workers_in_small_batches(spark):
    plan(spark, "published_images")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_an_audit_needs_no_join_and_keeps_ids_without_rows(spark):
    from auditgrid.operators.audit import audit

    assert "Join" not in plan(spark, "audit_flag_metrics") and "collect_set" not in plan(spark, "label_sets")
    rows = spark.createDataFrame([(1, "image", "nodule_mass", "present"), (1, "draft", "cardiomegaly", "present"), (2, "image", "cardiomegaly", "present"), (None, "image", "cardiomegaly", "present")], "image_id int, side string, finding string, status string")
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "image_id int")
    got = {r[0]: tuple(map(tuple, r[1:])) for r in audit(rows, ids).collect()}
    assert got == {1: (("nodule_mass",), ("cardiomegaly",), ("nodule_mass",)), 3: ((), (), ()), None: ((), (), ())}


@pytest.fixture
def dealt(monkeypatch):
    from auditgrid.plans import derive

    monkeypatch.setattr(derive, "DEALT_FROM", 0)
    monkeypatch.setattr(derive, "TASK_ROWS", 500)  # 12 tasks for some 6000 rows


def physical(spark, name: str) -> str:
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_large_tables_get_a_bounded_number_of_findings(spark, dealt):
    text = physical(spark, "audit_flag_metrics")
    # findings and ids are dealt once, by the size of the table, and never by the session's number of partitions
    assert re.findall(r"hashpartitioning\(image_id#\d+L?, (\d+)\)", text) == ["12", "12"] and "ENSURE_REQUIREMENTS" not in text.split("HashAggregate(keys=[image_id")[1]


def test_a_table_of_findings_is_made_within_images(spark, dealt):
    text = physical(spark, "findings_table")
    assert re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\)", text) == ["12", "12"] and "Exchange hashpartitioning" in text and "Join" not in text


@pytest.mark.parametrize("name", ["audit_flag_metrics", "label_sets", "audit_by_image", "raw_text_audit", "findings_table", "draft_rows", "training_targets", "written_records"])
def test_dealt_rows_give_the_same_results(spark, dealt, name):
    assert rows(registry.QUERIES[name](spark, SF)) == rows(duck(SF).sql(registry.SQL[name]).df())


def test_flags_of_cases_count_as_their_rows_do(spark):
    from auditgrid.operators import metrics

    items = [(1, (["a", "b"], ["a"]), (["b", "c", "c"], [])), (2, ([], None), (None, [])), (3, (["x", None], []), ([None], [])), (None, (["a"], []), (["a"], []))]
    kind = "struct<f:array<string>,g:array<string>>"
    cases = spark.createDataFrame(items, f"image_id int, predicted {kind}, expected {kind}")
    flat = lambda side: F.explode(F.map_from_arrays(F.array(F.lit("f"), F.lit("g")), F.array(f"{side}.f", f"{side}.g"))).alias("flag", "xs")
    by_rows = metrics.flag_metrics(*[cases.select("image_id", flat(s)).select("image_id", "flag", F.explode("xs").alias("finding")) for s in ("predicted", "expected")])
    got = metrics.flag_metrics_of_cases(cases, ("f", "g"))
    assert rows(got) == rows(by_rows) and got.columns == by_rows.columns and got.count() == 2


def test_written_lines_are_not_dealt_one_by_one(spark):
    text = physical(spark, "written_records")
    assert "distinct" not in text and "line#" not in "".join(re.findall(r"hashpartitioning\\([^)]*\\)", text)) and "SortMergeJoin" not in text


def test_right_targets_are_not_scanned_and_others_keep_their_errors(spark):
    from auditgrid.operators import corpus

    one, odd = '{"label": "cardiomegaly", "box_2d": null}', "target: a label outside the vocabulary"
    targets = {f"[{one}]": None, f"[{one}] and more": None, f"```json\n[{one}]\n```": None, one: None, f" [{one}]": None, '[{"label": "x", "label": "Nodule-Mass"}]': None, f"[{one}, {{": None, f"[{one}, 5]": "target: JSON array element is not an object", "[]": "target: no finding", '[{"label": "x"}]': odd, "[{}]": odd, '[{"label": 5}]': odd, "[nothing": "target: no balanced JSON array", "prose": "target: no JSON object"}
    rows_ = spark.createDataFrame([(t,) for t in targets], "t string").select("t", corpus.chat_record(F.lit("a.png"), F.lit("List."), F.col("t")).alias("record"))
    assert {r["t"]: r["error"] for r in corpus.validated(rows_).collect()} == targets
    assert corpus.validated(rows_).columns == ["t", "record", "error"]
    right = corpus.validated(rows_)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN NOT _right" in right
