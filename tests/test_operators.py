from __future__ import annotations

import json
import random

import pytest
from auditgrid.functions import json_lists, scalars, vocab
from auditgrid.functions.geometry import BOX, from_pixels, iou, to_pixels, valid_box
from auditgrid.operators import corpus, findings, matching, metrics, sampling
from pyspark.sql import functions as F

from helpers import rows

BOXES = f"image_id int, finding string, ord int, box {BOX}"


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def boxlit(b):
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(b, ("y0", "x0", "y1", "x1"), strict=True)])


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 1, 1), (0, 0, 1, 1), 1.0), ((0, 0, 0.5, 1), (0.5, 0, 1, 1), 0.0), ((0, 0, 1, 0.5), (0, 0.25, 1, 0.75), 1 / 3), ((0.2, 0.2, 0.2, 0.8), (0, 0, 1, 1), 0.0)])
def test_iou(spark, a, b, want):
    assert one(spark, iou(boxlit(a), boxlit(b)).alias("v"))["v"] == pytest.approx(want)


def test_pixels_and_back_swap_axes_and_clamp(spark):
    p = one(spark, to_pixels(boxlit((0.1, 0.2, 0.3, 0.4)), F.lit(100), F.lit(1000)).alias("p"))["p"]
    assert tuple(p) == pytest.approx((20, 100, 40, 300))
    b = one(spark, from_pixels(F.lit(-5), F.lit(100), F.lit(400), F.lit(300), F.lit(100), F.lit(1000)).alias("b"))["b"]
    assert tuple(b) == pytest.approx((0.1, 0.0, 0.3, 1.0))
    assert one(spark, from_pixels(F.lit(1), F.lit(1), F.lit(2), F.lit(2), F.lit(None).cast("int"), F.lit(5)).alias("b"))["b"] is None


@pytest.mark.parametrize(("values", "ok"), [([0.1, 0.2, 0.3, 0.4], True), ([0.1, 0.2, 0.1, 0.2], True), ([0.3, 0.2, 0.1, 0.4], False), ([0.1, 0.2, 0.3], False), ([0.1, 0.2, 0.3, 1.4], False), ([0.1, float("nan"), 0.3, 0.4], False), ([0.1, None, 0.3, 0.4], False)])
def test_valid_box(spark, values, ok):
    assert (spark.createDataFrame([(values,)], "v array<double>").select(valid_box(F.col("v")).alias("b")).head()["b"] is not None) == ok


def test_scalars(spark):
    texts = spark.createDataFrame([(" Pleural  Effusion ",), ("nodule-mass",), (" cardiomegaly\t",), ("tumour",), (None,)], "s string")
    assert [r[0] for r in texts.select(vocab.normalized_finding(F.col("s"))).collect()] == ["pleural_effusion", "nodule_mass", "cardiomegaly", None, None]
    with pytest.raises(Exception, match="not a canonical finding"):
        texts.select(vocab.normalized_finding(F.col("s"), strict=True)).collect()
    r = one(spark, vocab.display_name(F.lit("some_other_thing")).alias("a"), scalars.formatted_size(F.lit(1536)).alias("b"), scalars.f1(F.lit(0.0), F.lit(0.0)).alias("c"), scalars.ratio(F.lit(1), F.lit(0)).alias("d"), scalars.without_reasoning(F.lit("<THINK>a\nb</think> c ")).alias("e"), scalars.without_fence(F.lit("```json\n[1]\n```")).alias("f"))
    assert tuple(r) == ("Some other thing", "1.5 KB", 0.0, None, "c", "[1]")
    with pytest.raises(KeyError):
        vocab.mapped_label(texts, "s", "unknown")


LISTS = [
    ('[{"label": "a"}, {"label": "b"}]', 2), ('noise [{"a": "]}"}] tail', 1), ('{"label": "a"} [1]', 1), ("```json\n[{}]\n```", 1),
    ('[{"a": 1}, {"b": 2}, {"c"', 2), ('[{"a": 1} {"b": 2}]', 2), ('[{"a": 1}, 3]', None), ("[]", 0), ("no json", None), ("[", None), ('{"a": ', None), ("", None), (None, None),
    ('[{"a": "\\"]"}, {"b": [1, {"c": 2}]}]', 2), ("[" + '{"a": 1}, ' * 100, 64), ('[{"a": NaN, "a": 2}]', 1),
]


def test_tolerant_lists(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LISTS)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", json_lists.parsed_list(F.col("t")).alias("p")).collect()}
    for i, (text, n) in enumerate(LISTS):
        assert got[i]["ok"] == (n is not None), text
        assert len(got[i]["elements"]) == (n or 0), text
        assert all(isinstance(json.loads(e), dict) for e in got[i]["elements"])


def test_parsed_findings_coerce_and_keep_the_first(spark):
    text = json.dumps([{"label": "Cardiomegaly", "box_2d": ["0.1", 0.2, 0.3, 0.4], "confidence": 2, "evidence": 5}, {"label": "cardiomegaly", "box_2d": [0.1, 0.2, 0.3, 0.4]}, {"label": 7}, {"label": "pneumothorax", "box_2d": "x", "status": "Absent "}, {"label": "pneumothorax"}])
    parsed = findings.parsed_outputs(spark.createDataFrame([(1, text), (2, "nothing")], "image_id int, raw_text string"))
    got = findings.image_findings(parsed).orderBy("ord").collect()
    assert [(r["ord"], r["finding"], r["box"] is None, r["confidence"], r["evidence"]) for r in got] == [(0, "cardiomegaly", False, None, None), (3, "pneumothorax", True, None, None)]
    assert rows(findings.draft_findings(parsed), ["ord", "finding", "status"]) == [(0, "cardiomegaly", "present"), (3, "pneumothorax", "absent"), (4, "pneumothorax", "present")]
    assert [r["image_id"] for r in findings.quarantine(parsed).collect()] == [2]
    assert tuple(metrics.parse_failures(parsed).head()) == (2, 1)


def random_boxes(seed, n, labels=("cardiomegaly",)):
    rng, out = random.Random(seed), []
    for i in range(n):
        y, x = rng.random() * 0.5, rng.random() * 0.5
        out.append((1 + i % 3, rng.choice(labels), i, (y, x, y + 0.2 + rng.random() * 0.3, x + 0.2 + rng.random() * 0.3)))
    return out


def py_iou(a, b):
    h, w = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return h * w / (area(a) + area(b) - h * w) if h * w else 0.0


def test_greedy_matches_equal_brute_force(spark):
    pred, gold = random_boxes(1, 24), random_boxes(2, 24)
    want = []
    for image in (1, 2, 3):
        pairs = sorted((-py_iou(p[3], g[3]), p[2], g[2]) for p in pred for g in gold if p[0] == g[0] == image and py_iou(p[3], g[3]) >= 0.3)
        used_p, used_g = set(), set()
        for _, i, j in pairs:
            if i not in used_p and j not in used_g:
                want.append((image, i, j))
                used_p.add(i)
                used_g.add(j)
    p, g = (spark.createDataFrame(x, BOXES) for x in (pred, gold))
    for parts in (1, 7):
        assert rows(matching.matched(p.repartition(parts), g, 0.3), ["image_id", "i", "j"]) == sorted(want, key=repr)
    assert matching.matched(p, g, 0.3, scope="pooled").count() > 0


def test_clusters_are_components_and_boxes_their_mean(spark):
    chain = [(1, "cardiomegaly", i, (0.0, 0.1 * i, 1.0, 0.1 * i + 0.4)) for i in range(4)] + [(1, "cardiomegaly", 9, (0.0, 0.9, 0.1, 1.0)), (1, "pneumothorax", 5, None)]
    got = matching.merged_boxes(spark.createDataFrame(chain, BOXES), 0.5).orderBy("cluster").collect()
    assert [(r["cluster"], r["n"]) for r in got] == [(0, 4), (9, 1)]
    assert got[0]["box"]["x0"] == pytest.approx(0.15)


def test_cross_labels_keep_the_specific_and_removed_rows_still_remove(spark):
    b = (0.0, 0.0, 0.5, 0.5)
    items = [(1, "lung_opacity_consolidation", 0, b), (1, "nodule_mass", 1, b), (1, "pneumothorax", 2, b), (2, "cardiomegaly", 0, b), (2, "cardiomegaly", 1, b)]
    df = spark.createDataFrame(items, BOXES)
    assert rows(matching.cross_label_resolved(df, 0.6), ["image_id", "ord"]) == [(1, 2), (2, 0), (2, 1)]
    assert matching.cross_label_resolved(df, 0).count() == 5


def test_presence_macro_skips_undefined(spark):
    schema = "image_id int, finding string, status string"
    pred = spark.createDataFrame([(1, "cardiomegaly", "present"), (2, "cardiomegaly", "present"), (2, "no_finding", "present")], schema)
    gold = spark.createDataFrame([(1, "cardiomegaly", "present"), (1, "pneumothorax", "present"), (3, "nodule_mass", "absent")], schema)
    m = metrics.presence_metrics(pred, gold)
    got = {r["finding"]: r for r in m.collect()}
    assert len(got) == 5 and (got["cardiomegaly"]["tp"], got["cardiomegaly"]["fp"], got["pneumothorax"]["fn"]) == (1, 1, 1)
    assert got["pneumothorax"]["precision"] is None and got["pneumothorax"]["recall"] == 0.0
    assert tuple(metrics.macro(m).head()) == (pytest.approx(2 / 3), 1)
    with pytest.raises(Exception, match="not a canonical"):
        metrics.presence_metrics(spark.createDataFrame([(1, "tumour", "present")], schema), gold).collect()


def label_rows(spark, n=400):
    rng = random.Random(5)
    data = []
    for i in range(n):
        labels = [x for x in vocab.POSITIVE if rng.random() < 0.15]
        data.append((i, labels, [x for x in vocab.POSITIVE if x not in labels], "+".join(sorted(labels)) or "no_finding", not labels))
    return spark.createDataFrame(data, "image_id int, labels array<string>, absent array<string>, signature string, is_normal boolean"), data


def test_balance_split_and_subset(spark):
    df, data = label_rows(spark)
    normals = sum(d[4] for d in data)
    positives = len(data) - normals
    kept = sampling.balanced(df, 0.5).toPandas()
    assert (~kept["is_normal"]).sum() == positives and kept["is_normal"].sum() == min(normals, round(0.5 * positives))
    assert sampling.balanced(df, 100.0).count() == len(data)
    split = sampling.stratified_split(df.repartition(7), 0.1).toPandas()
    assert len(split) == len(data) and split["image_id"].is_unique
    for _, g in split.groupby("signature"):
        assert (g["split"] == "val").sum() == round(len(g) * 0.1)
    assert rows(sampling.stratified_split(df.repartition(3), 0.1), ["image_id", "split"]) == rows(split, ["image_id", "split"])
    subset = sampling.stratified_subset(df, 250).toPandas()
    urgent = {d[0] for d in data if set(d[1]) & set(vocab.URGENT)}
    assert len(subset) == max(250, len(urgent)) and urgent <= set(subset["image_id"]) and subset["image_id"].is_unique
    assert sampling.stratified_subset(df, 10_000).count() == len(data)


def test_pools_keep_the_first_and_count_duplicates(spark):
    pools = spark.createDataFrame([("h1", "a", 0, 1), ("h1", "a", 0, 2), ("h1", "b", 1, 3), ("h2", "b", 1, 4)], "h string, pool string, pool_ord int, id int")
    assert rows(sampling.pool_union(pools, "h", ["id"]), ["h", "id"]) == [("h1", 1), ("h2", 4)]
    assert rows(sampling.pool_report(pools, "h", ["id"]), ["pool", "raw", "kept", "within_pool", "cross_pool"]) == [("a", 2, 1, 1, 0), ("b", 2, 1, 0, 1)]


def test_targets_records_and_their_checks(spark):
    schema = f"image_id int, ord int, finding string, status string, box {BOX}, confidence double, evidence string"
    found = spark.createDataFrame([(1, 0, "cardiomegaly", "present", (0.1, 0.2, 0.3, 0.4), 0.5, 'a "b"'), (1, 1, "nodule_mass", "present", None, None, None), (1, 2, "pneumothorax", "absent", None, None, None)], schema)
    targets = {r["image_id"]: json.loads(r["target"]) for r in corpus.target_text(spark.createDataFrame([(1,), (2,)], "image_id int"), found).collect()}
    assert targets[1] == [{"label": "cardiomegaly", "box_2d": [0.1, 0.2, 0.3, 0.4], "confidence": 0.5, "evidence": 'a "b"'}, {"label": "nodule_mass", "box_2d": None}]
    assert targets[2] == [{"label": "no_finding", "box_2d": None}]
    made = spark.createDataFrame([(1, json.dumps(targets[1])), (2, "[]"), (3, "x"), (4, '[{"label": "tumour"}]')], "i int, target string").select("i", corpus.chat_record(F.lit("a.png"), F.lit("prompt"), F.col("target")).alias("record"))
    errors = {r["i"]: r["error"] for r in corpus.validated(made).collect()}
    assert errors[1] is None and all(errors[i] for i in (2, 3, 4))


def test_cases_expect_what_the_audit_says(spark):
    df, data = label_rows(spark, 60)
    for r in corpus.audit_cases(df).collect():
        image, said = set(r["labels"]), {f["finding"] for f in r["draft_findings"]} - {"no_finding"}
        assert set(r["missing_findings"]) == image - said and set(r["unsupported_claims"]) == said - image
        if r["case_type"] == "faithful":
            assert image == said and r["corrupted_label"] is None
        assert r["draft_text"]
