"""Whole runs and layout on small worked cases, odd input among them."""

from __future__ import annotations

import random

import pytest
from auditgrid.functions.geometry import BOX, PIXELS
from auditgrid.functions.json_lists import parsed_list
from auditgrid.operators import audit, evaluation, findings, layout, metrics, sampling, whole
from pyspark.sql import functions as F

from helpers import rows

NONE = '[{"label": "no_finding", "box_2d": null}]'


def parsed(spark, items):
    return spark.createDataFrame(items, "image_id int, text string").select("image_id", F.when(F.col("text").isNotNull(), parsed_list(F.col("text"))).alias("parse"))


def test_unread_drafts_leave_the_audit_to_the_image(spark):
    mine = '[{"label": "Pneumothorax", "box_2d": [0, 0, 1, 1]}]'
    said = '[{"label": "cardiomegaly", "span": "big \\"heart\\""}, {"label": "cardiomegaly", "span": "later"}]'
    grounded = parsed(spark, [(1, mine), (2, mine), (3, "nothing"), (4, mine), (5, "[]")])
    out = {r["image_id"]: r for r in whole.audits_of(grounded, parsed(spark, [(1, said), (2, "no list"), (3, said), (4, None)])).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5]
    assert out[1]["unsupported_spans"] == ['big "heart"'] and out[1]["missing_findings"] == ["pneumothorax"] and out[1]["draft_note"] is None
    assert out[2]["draft_note"] == audit.DRAFT_NOTE and out[2]["unsupported_claims"] == [] and out[2]["urgent_review_flags"] == ["pneumothorax"]
    assert not out[3]["ok"] and out[3]["missing_findings"] is None and out[3]["draft_note"] is None
    assert out[4]["draft_note"] is None and out[4]["missing_findings"] == ["pneumothorax"]
    assert out[5]["ok"] and out[5]["missing_findings"] == []
    assert whole.audits_of(grounded).filter("draft_note IS NOT NULL").count() == 0


ODD = '[{"label": 5}, {"label": "Nodule-Mass", "status": " ABSENT ", "span": "no"}, {"label": "nodule mass", "status": null, "span": 7}, {"label": ["cardiomegaly"]}, {"label": "nodule_mass", "span": "late"}, {"label": "cardiomegaly", "status": ["absent"], "span": {"a": 1}}, {"label": "pneumothorax", "span": "a, \\"b\\" \u00e9"}]'


def test_claims_within_a_row_are_those_of_the_findings_and_need_one_shuffle(spark):
    grounded, drafted = parsed(spark, [(1, ODD), (1, "nothing"), (2, "[]"), (None, ODD), (4, ODD)]), parsed(spark, [(1, ODD), (1, '[{"label": "pleural_effusion", "span": "x"}]'), (2, ODD), (3, ODD), (None, ODD), (4, "prose")])
    out = whole.audits_of(grounded.withColumn("n", F.lit(7)), drafted, keep=("n",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # as from findings that are exploded and deduplicated first
    sides = audit.sides(findings.image_findings(grounded), findings.draft_findings(drafted))
    by_rows = {r["image_id"]: r for r in audit.audit(sides, grounded, spans=True).collect()}
    got = out.collect()
    assert sorted((r["image_id"], r["ok"], r["n"]) for r in got) == [(1, False, 7), (1, True, 7), (2, True, 7), (4, True, 7)]
    for r in got:
        assert all(r[c] == (by_rows[r["image_id"]][c] if r["ok"] else None) for c in (*audit.FLAGS, "unsupported_spans"))
    two = next(r for r in got if r["image_id"] == 2)
    assert two["unsupported_claims"] == ["pneumothorax", "nodule_mass", "cardiomegaly"] and two["unsupported_spans"] == ['a, "b" \u00e9', None, None]
    assert [r["draft_note"] for r in got if r["image_id"] == 4] == [audit.DRAFT_NOTE]


def test_panel_leads_with_the_note_and_quotes(spark):
    flags = "missing_findings array<string>, unsupported_claims array<string>, urgent_review_flags array<string>, unsupported_spans array<string>, draft_note string"
    items = [(["cardiomegaly"], ["pneumothorax", "nodule_mass"], [], ["said so", None], "Unread."), ([], [], [], [], None)]
    busy, clear = (r["panel"] for r in audit.verdict_markdown(spark.createDataFrame(items, flags)).collect())
    assert busy.startswith(audit.PANEL_NOTE[0] + "Unread.") and audit.PANEL_LEAD in busy
    assert '(draft text: "said so").' in busy and "does not support it.\n" not in busy.split("said so")[0] and busy.endswith("does not support it.")
    assert clear == audit.PANEL_LEAD + "\n\n" + audit.PANEL_AGREE


def test_a_model_is_called_again_only_for_what_failed(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def model(prompts, attempts):
        import pandas as pd

        calls.add(int(prompts.notna().sum()))
        return pd.Series([None if p is None else NONE if n >= 2 else "prose" for p, n in zip(prompts, attempts, strict=True)])

    ids = spark.createDataFrame([(1, "text"), (2, "  "), (3, None)], "image_id int, draft string").repartition(3)
    out = {r["image_id"]: r for r in whole.drafts_read(ids, lambda p, n: model(p, F.lit(n)), attempts=4).collect()}
    assert out[1]["parse"]["ok"] and out[1]["attempt"] == 2
    assert out[2]["parse"] is None and out[3]["parse"] is None and out[2]["attempt"] is None
    assert calls.value == 2


def test_a_whole_audit_asks_for_each_image_and_attempt_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def model(prompts, ids, attempts):
        import pandas as pd

        asked.add(int(prompts.notna().sum()))
        return pd.Series([None if p is None else f'[{{"label": "pneumothorax", "box_2d": [0, 0, 0.5, 0.{n + 4}]}}]' if i % 3 < n else "prose" for p, i, n in zip(prompts, ids, attempts, strict=True)])

    generate = lambda p, n: model(p, "image_id", F.lit(n))
    images = spark.range(30).select(F.col("id").alias("image_id"), F.lit("Some text.").alias("draft")).repartition(4)
    grounded, drafted = whole.images_read(images, generate), whole.drafts_read(images, generate)
    assert asked.value == 30 + 20 + 10 + 30 + 20  # 10 more can be read each time
    out = whole.audits_of(grounded, drafted).join(grounded.select("image_id", "attempt"), "image_id")
    assert out.count() == 30 and out.filter("ok AND draft_note IS NOT NULL").count() == 10 and grounded.filter("NOT parse.ok").count() == 0
    assert asked.value == 110
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "udf" not in plan


def test_reports_of_models_read_their_texts_once(spark):
    outputs = spark.createDataFrame([("a", 1, '[{"label": "cardiomegaly", "box_2d": [0, 0, 1, 1]}]'), ("b", 1, "prose")], "model_id string, image_id int, raw_text string")
    gold = spark.createDataFrame([(1, 0, "cardiomegaly", "present", (0.0, 0.0, 1.0, 1.0))], f"image_id int, ord int, finding string, status string, box {BOX}")
    out = evaluation.evaluate_models(outputs, gold)
    assert all("EvalPython" not in t._jdf.queryExecution().optimizedPlan().toString() for t in out.values())
    got = {r["model_id"]: r for r in out["samples"].collect()}
    assert [f["finding"] for f in got["a"]["predicted"]] == ["cardiomegaly"] and got["b"]["predicted"] == [] and not got["b"]["ok"]
    assert all([f["finding"] for f in r["expected"]] == ["cardiomegaly"] for r in got.values())


def test_counts_of_outputs_alone_settle_nothing(spark, monkeypatch):
    outputs = spark.createDataFrame([("a", 1, NONE), ("a", 2, "prose"), ("b", 1, None)], "model_id string, image_id int, raw_text string")
    monkeypatch.setattr(evaluation, "settled", lambda *_: pytest.fail("settled"))
    out = evaluation.evaluate_models(outputs, None, only=("outputs",))
    assert list(out) == ["outputs"] and rows(out["outputs"], ["model_id", "outputs", "failures"]) == [("a", 2, 1), ("b", 1, 1)]


def test_curation_merges_resolves_and_keeps_bare_labels(spark):
    b = lambda y, x: (y, y, x, x)
    items = [(1, 0, "nodule_mass", b(0.0, 0.5)), (1, 1, "nodule_mass", b(0.0, 0.52)), (1, 2, "lung_opacity_consolidation", b(0.0, 0.5)), (1, 3, "pleural_effusion", None), (1, 4, "pleural_effusion", None), (2, 0, "cardiomegaly", b(0.1, 0.9)), (2, 1, "cardiomegaly", None)]
    table = spark.createDataFrame(items, f"image_id int, ord int, finding string, box {BOX}")
    for parts in (1, 7):
        got = whole.curated_findings(table.repartition(parts)).orderBy("image_id", "ord").collect()
        assert [(r["image_id"], r["finding"], r["box"] is None) for r in got] == [(1, "pleural_effusion", True), (1, "nodule_mass", False), (2, "cardiomegaly", False)]
        assert got[1]["box"]["y1"] == pytest.approx(0.51)
    assert whole.curated_findings(table.limit(0)).count() == 0


def test_curated_corpus_fails_on_an_unreadable_target(spark):
    ids = spark.createDataFrame([(1,)], "id int")
    path, prompt = F.lit("a.png"), F.lit("List.")
    good = whole.training_rows(ids, spark.createDataFrame([], f"id int, ord int, finding string, box {BOX}"), path, prompt, "id")
    out = whole.curated_corpus(good, prompt, ratio=1.0, id_col="id")
    assert out.columns == ["id", "split", "signature", "record"] and out.count() == 0  # no positive, so no normal is kept
    bad = good.withColumn("record", whole.chat_record(path, prompt, F.lit("prose")))
    with pytest.raises(Exception, match="target of 1"):
        whole.curated_corpus(bad, prompt, id_col="id").collect()


def test_models_that_say_nothing_still_have_their_rows(spark):
    outputs = spark.createDataFrame([("a", 1, '[{"label": "cardiomegaly", "box_2d": [0, 0, 1, 1]}]'), ("b", 1, "prose"), ("c", 1, None)], "model_id string, image_id int, raw_text string")
    gold = spark.createDataFrame([(1, 0, "cardiomegaly", "present", (0.0, 0.0, 1.0, 1.0)), (9, 0, "cardiomegaly", "present", (0.0, 0.0, 1.0, 1.0))], f"image_id int, ord int, finding string, status string, box {BOX}")
    out = evaluation.evaluate_models(outputs, gold)
    assert rows(out["outputs"], ["model_id", "outputs", "failures"]) == [("a", 1, 0), ("b", 1, 1), ("c", 1, 1)]
    seen = {r["model_id"]: (r["tp"], r["fp"], r["fn"]) for r in out["presence"].filter("finding = 'cardiomegaly'").collect()}
    assert seen == {"a": (1, 0, 0), "b": (0, 0, 1), "c": (0, 0, 1)}
    assert rows(out["mean_iou"].filter("threshold < 0.1"), ["model_id", "n_pairs", "mean_iou"]) == [("a", 1, 1.0), ("b", 0, None), ("c", 0, None)]
    assert out["localization"].filter("finding IS NULL AND threshold = 0.5").count() == 3
    with pytest.raises(ValueError, match="scorer"):
        evaluation.external_scores(outputs, None, "raw_text", "raw_text")


def test_one_fold_serves_every_threshold(spark):
    rng = random.Random(3)
    box = lambda: (y := rng.random() / 2, x := rng.random() / 2, y + 0.3, x + 0.3)
    items = [(i % 3, i, "nodule_mass", "present", box()) for i in range(24)]
    kind = f"image_id int, ord int, finding string, status string, box {BOX}"
    p, g = spark.createDataFrame(items[:12], kind), spark.createDataFrame(items[12:], kind)
    cuts = (0.1, 0.3, 0.5)
    both = {r["threshold"]: r["n_pairs"] for r in metrics.mean_iou(p, g, cuts).collect()}
    alone = {t: metrics.mean_iou(p, g, (t,)).head()["n_pairs"] for t in cuts}
    assert both == alone and both[0.1] > 0


def test_union_of_pools_is_one_row_a_content(spark):
    pools = spark.createDataFrame([("h", 2, 1, ["pneumothorax"]), ("h", 1, 5, []), ("h", 1, 4, ["nodule_mass"]), (None, 1, 6, [])], "h string, pool_ord int, id int, labels array<string>")
    kept = sampling.pool_union(pools, "h", ["id"])
    assert kept.columns == pools.columns and rows(kept, ["h", "id"]) == [("h", 4), (None, 6)]
    report = sampling.pool_report(pools.withColumn("pool", F.concat(F.lit("p"), F.col("pool_ord"))), "h", ["id"])
    assert rows(report, ["pool", "raw", "kept", "within_pool", "cross_pool", "urgent_nodule_mass", "urgent_pneumothorax"]) == [("p1", 3, 2, 1, 0, 1, 0), ("p2", 1, 0, 0, 1, 0, 0)]


# What each label of an image asks for as (left, top, bottom of its box) with bands of 40 by 20,
# the canvas's height, and the tops that the labels get.
PLACED = {
    "alone": (200, [(0, 50, 100)], [50]),
    "under the box, then further down": (200, [(0, 50, 100)] * 4, [50, 100, 120, 140]),
    "further up, as the canvas ends": (100, [(0, 60, 95)] * 4, [60, 80, 40, 20]),
    "side by side": (200, [(0, 50, 100), (40, 50, 100)], [50, 50]),
    "touching is free": (200, [(0, 50, 100), (0, 70, 100)], [50, 70]),
    "no room: the last place tried": (20, [(0, 0, 20)] * 3, [0, 0, 0]),
}


def test_bands_are_placed(spark):
    items = [(name, n, (float(x), float(y), x + 40.0, y + 20.0), (float(x), float(y), x + 30.0, float(low)), height) for name, (height, asked, _) in PLACED.items() for n, (x, y, low) in enumerate(asked)]
    table = spark.createDataFrame(items, f"image_id string, region int, band {PIXELS}, box {PIXELS}, height int")
    got = layout.placed_bands(table.repartition(7)).collect()
    tops = {name: [r["band"]["y_min"] for r in sorted(got, key=lambda r: r["region"]) if r["image_id"] == name] for name in PLACED}
    assert tops == {name: want for name, (_, _, want) in PLACED.items()}


def test_bands_move_only_from_taken_places_and_stay_on_the_canvas(spark):
    rng = random.Random(5)
    asked = []
    for n in range(40):
        x, y = float(rng.randrange(60)), float(rng.randrange(180))
        asked.append((1, n, (x, y, x + 40.0, y + 20.0), (x, y, x + 30.0, min(200.0, y + 35.0)), 200))
    got = [tuple(r["band"]) for r in layout.placed_bands(spark.createDataFrame(asked, f"image_id int, region int, band {PIXELS}, box {PIXELS}, height int")).orderBy("region").collect()]
    overlap = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    for n, (_, _, want, _, _) in enumerate(asked):
        assert (got[n][0], got[n][2], got[n][3] - got[n][1]) == (want[0], want[2], 20.0)
        assert got[n][1] >= 0 and got[n][3] <= 200
        assert got[n] == want or any(overlap(want, p) for p in got[:n])


@pytest.mark.parametrize(("size", "canvas", "font"), [((100, 50), (100, 50), 14), ((1280, 1), (1280, 1), 27), ((2560, 1), (1280, 1), 27), ((3000, 2000), (1280, 853), 27), ((1000, 960), (1000, 960), 21)])
def test_canvas_and_font(spark, size, canvas, font):
    r = spark.createDataFrame([size], "w int, h int").select(*[layout.canvas_side(F.col(c), F.col("w"), F.col("h")).alias(c) for c in ("w", "h")]).withColumn("f", layout.font_size(F.col("w"), F.col("h"))).head()
    assert tuple(r) == (*canvas, font)
