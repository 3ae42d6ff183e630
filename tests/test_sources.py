from __future__ import annotations

import json

import pytest
from auditgrid.functions.geometry import BOX
from auditgrid.operators import corpus
from auditgrid.sources import lines, readers, writers
from pyspark.sql import functions as F

from helpers import rows


def put(path, text):
    path.write_text(text)
    return str(path)


def test_vindr(spark, tmp_path):
    dims = put(tmp_path / "dims.csv", "image_id,dim0,dim1\na,1000,500\n")
    path = put(tmp_path / "boxes.csv", ",".join(readers.VINDR_COLUMNS) + "\na,Cardiomegaly,3,R1,50,100,250,500\na,Aortic enlargement,0,R1,1,1,2,2\nb,No finding,14,R2,,,,\nc,ILD,5,R2,1,2,3,4\n")
    got = {(r["image_id"], r["finding"]): r["box"] for r in readers.vindr_boxes(spark, path, readers.vindr_dims(spark, dims)).collect()}
    assert tuple(got["a", "cardiomegaly"]) == pytest.approx((0.1, 0.1, 0.5, 0.5))
    assert got["b", "no_finding"] is None and ("c", None) in got and len(got) == 3
    assert all(r["box"] is None for r in readers.vindr_boxes(spark, path).collect())
    with pytest.raises(ValueError, match="header"):
        readers.vindr_boxes(spark, dims)
    with pytest.raises(ValueError, match="dimension"):
        readers.vindr_dims(spark, path)


def test_vqa(spark, tmp_path):
    items = [{"image_id": "a" * 32, "gt_finding": "Nodule/Mass", "gt_location": [10, 20, 30, 40], "image_width": 100, "image_height": 200}, {"image_id": "b", "gt_finding": "Unheard of", "gt_location": None}]
    path = put(tmp_path / "vqa.json", json.dumps(items))
    got = readers.vqa_annotations(spark, path).orderBy("ord").collect()
    assert got[0]["finding"] == "nodule_mass" and tuple(got[0]["box"]) == pytest.approx((0.1, 0.1, 0.2, 0.3))
    assert got[1]["finding"] is None and got[1]["box"] is None
    assert readers.joined_to_images(readers.vqa_annotations(spark, path), spark.createDataFrame([("b",)], "image_id string")).count() == 1
    with pytest.raises(ValueError, match="array"):
        readers.vqa_annotations(spark, put(tmp_path / "o.json", "{}"))
    bad = put(tmp_path / "bad.json", json.dumps([{"image_id": "a", "gt_finding": "x", "gt_location": [1, 2]}]))
    with pytest.raises(Exception, match="four numbers"):
        readers.vqa_annotations(spark, bad).collect()


def test_nih(spark, tmp_path):
    path = put(tmp_path / "nih.csv", "Image Index,Finding Label,Bbox [x,y,w,h],,,\n1.png,Mass,0,512,512,512,,,\n2.png,Atelectasis,1,1,1,1,,,\n")
    got = readers.nih_boxes(spark, path).collect()
    assert [(r["image_id"], r["finding"], tuple(r["box"])) for r in got] == [("1.png", "nodule_mass", (0.5, 0.0, 1.0, 0.5))]
    path = put(tmp_path / "plain.csv", "image_id,finding,x,y,w,h\nimg1,Effusion,10,20,30,40\n")
    r = readers.nih_boxes(spark, path, 100, 100).head()
    assert r["finding"] == "pleural_effusion" and tuple(r["box"]) == pytest.approx((0.2, 0.1, 0.6, 0.4))
    with pytest.raises(ValueError, match="missing columns"):
        readers.nih_boxes(spark, put(tmp_path / "short.csv", "image_id,finding\nimg1,Effusion\n"))


def grid(n, cells):
    return [[cells.get((y, x), 255) for x in range(n)] for y in range(n)]


def test_chestxdet(spark, tmp_path):
    assert (readers.CHESTXDET_CATEGORIES[5], readers.CHESTXDET_CATEGORIES[2], len(readers.CHESTXDET_CATEGORIES)) == ("Effusion", "Cardiomegaly", 13)
    square = {(y, x): 6 for y in (1, 2) for x in (1, 2)}
    rgb = [[[v, v, v] for v in line] for line in grid(3, {(0, 0): 3})]
    items = [
        {"image_id": "block", "label": grid(4, square)},
        {"image_id": "fracture", "label": grid(3, {(0, 0): 9})},
        {"image_id": "two", "label": grid(4, {(0, 0): 10, (3, 3): 6})},
        {"image_id": "four", "label": grid(6, square | {(2, 4): 4, (3, 5): 4, (5, 0): 9})},
        {"image_id": "rgb", "label": rgb},
        {"image_id": "none"},
        {"label": grid(2, {(0, 0): 6})},
    ]
    path = put(tmp_path / "det.json", json.dumps(items))
    got = {}
    for r in readers.chestxdet_boxes(spark, path).orderBy("image_id", "ord").collect():
        got.setdefault(r["image_id"], []).append((r["finding"], r["native_label"], r["box"] and tuple(r["box"])))
    assert got["block"] == [("pleural_effusion", "Effusion", pytest.approx((0.25, 0.25, 0.75, 0.75)))]
    assert got["fracture"] == got["none"] == [(None, None, None)]
    assert [f for f, _, _ in got["two"]] == ["pleural_effusion", "nodule_mass"]
    assert {f for f, _, _ in got["four"]} == {"pleural_effusion", "lung_opacity_consolidation"}
    assert [f for f, _, _ in got["rgb"]] == ["cardiomegaly"] and [f for f, _, _ in got[""]] == ["pleural_effusion"]
    with pytest.raises(Exception, match="2-D"):
        readers.chestxdet_boxes(spark, put(tmp_path / "bad.json", json.dumps([{"image_id": "x", "label": [[[[1]]]]}]))).collect()


def test_open_reports(spark, tmp_path):
    path = put(tmp_path / "reports.json", json.dumps([{"uid": 7, "findings": None, "impression": "Clear.", "image": "text"}]))
    r = readers.open_reports(spark, path).head()
    assert (r["image_id"], r["findings_text"], r["impression_text"], r["image"]) == ("7", "", "Clear.", None)


def test_windowing(spark):
    df = spark.createDataFrame([(0.5,), (-3.0,), (9.0,)], "p double").select(readers.windowed(F.col("p"), F.lit(0.5), F.lit(1.0), F.lit(False)), readers.windowed(F.col("p"), F.lit(0.5), F.lit(1.0), F.lit(True)))
    assert [tuple(r) for r in df.collect()] == [(128, 127), (0, 255), (255, 0)]


def test_records_images_and_reports(spark, tmp_path):
    target = '[{"label": "no_finding", "box_2d": null}]'
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"bytes")
    listing = readers.images(spark, str(tmp_path / "img"))
    assert [(r["image_id"], bytes(r["bytes"])) for r in listing.collect()] == [("a", b"bytes")]
    path = listing.head()["path"]
    good = spark.createDataFrame([(path, target)], "p string, t string").select(corpus.chat_record(F.col("p"), F.lit("prompt"), F.col("t")).alias("record"))
    bad = good.unionByName(spark.createDataFrame([("b", "x")], "p string, t string").select(corpus.chat_record(F.col("p"), F.lit("prompt"), F.col("t")).alias("record")))
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="invalid record"):
        writers.write_records(bad, out)
    assert not (tmp_path / "out").exists()
    assert writers.write_records(good, out) == 1
    read = lines.training_records(spark, out).collect()
    assert [(r["line"], r["malformed"], r["record"]["image_path"]) for r in read] == [(1, False, path)]
    put(tmp_path / "broken.jsonl", '\n{"image_path": \n')
    assert [(r["line"], r["malformed"]) for r in lines.training_records(spark, str(tmp_path / "broken.jsonl")).collect()] == [(2, True)]
    assert writers.with_image_bytes(good, listing).head()["images"][0] == b"bytes"
    with pytest.raises(Exception, match="image not found"):
        writers.with_image_bytes(bad, listing).collect()
    assert tuple(writers.corpus_plan(bad, listing).head()) == (2, 2, 2, 1, 5)
    writers.write_report(spark.sql("SELECT 1 AS tp, CAST(NULL AS DOUBLE) AS f1"), str(tmp_path / "rep"), "t1")
    assert json.loads(spark.read.text(str(tmp_path / "rep/history/t1")).head()[0]) == {"tp": 1, "f1": None}


def test_eval_cases_and_catalog(spark, tmp_path):
    path = put(tmp_path / "e.json", json.dumps({"cases": [{"case_id": "x", "predicted": {"missing_findings": ["cardiomegaly"]}, "expected": {"missing_findings": []}}]}))
    r = readers.eval_cases(spark, path, "audit").head()
    assert r["case_id"] == "x" and r["predicted"]["missing_findings"] == ["cardiomegaly"]
    assert [r["key"] for r in readers.catalog(spark, ["nih", "vindr"]).collect()] == ["vindr", "nih"]
    assert readers.catalog(spark, ["all"]).count() == 5
    with pytest.raises(ValueError, match="unknown"):
        readers.catalog(spark, ["x"])
    assert readers.first_existing(spark, str(tmp_path), ["none", "e.json"]).endswith("e.json")
    assert readers.first_existing(spark, str(tmp_path), ["none"]) is None
    assert rows(spark.createDataFrame([(1,)], f"a int").withColumn("b", F.lit(None).cast(BOX)), ["a"]) == [(1,)]
