"""Images, numbered lines, staged writes and report documents."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from auditgrid.operators import corpus, sampling
from auditgrid.sources import datasets, lines, pixels, readers, writers
from pyspark.sql import functions as F

TARGET = '[{"label": "no_finding", "box_2d": null}]'


def chunk(name, body):
    return len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")


def encoded(image, kinds, colour, palette=b""):
    """A PNG whose line y is written with the filter kinds[y]."""
    height, width, step = image.shape
    out, zero = b"", np.zeros(width * step, int)
    flat = image.reshape(height, -1).astype(int)
    for y in range(height):
        line, up = flat[y], flat[y - 1] if y else zero
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        aim = left + up - corner
        far = np.abs(np.stack([aim - left, aim - up, aim - corner]))
        near = np.choose(far.argmin(axis=0), [left, up, corner])
        guess = (zero, left, up, (left + up) // 2, near)[kinds[y]]
        out += bytes([kinds[y]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes((8, colour, 0, 0, 0))
    extra = chunk(b"PLTE", palette) if palette else b""
    return pixels.SIGNATURE + chunk(b"IHDR", header) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "step"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_line_filter_is_read(colour, step):
    image = np.random.default_rng(colour).integers(0, 256, (10, 7, step), dtype=np.uint8)
    got = pixels.rgb(encoded(image, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], colour))
    want = image[:, :, :3] if step >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    assert (got == want).all()


def test_palette_and_bad_files():
    image = np.array([[[0], [1]], [[1], [2]]], np.uint8)
    got = pixels.rgb(encoded(image, [0, 2], 3, bytes(range(9))))
    assert got.tolist() == [[[0, 1, 2], [3, 4, 5]], [[3, 4, 5], [6, 7, 8]]]
    whole = encoded(image, [0, 0], 0)
    for bad in (b"", b"text", whole[:-30], pixels.SIGNATURE):
        with pytest.raises(ValueError):
            pixels.rgb(bad)
    with pytest.raises(ValueError, match="over 3 bytes"):
        pixels.rgb(whole, 3)


def grey(spark, values, centre=None, window=None, inverted=False, low=1.0, high=99.0):
    schema = "id int, pixels binary, centre double, window double, inverted boolean"
    rows = spark.createDataFrame([(1, np.array(values, "<u2").tobytes(), centre, window, inverted)], schema)
    return list(pixels.windowed_pixels(rows, low, high).head()["grey"])


def test_windows(spark):
    assert grey(spark, [100, 300, 500, 700, 900], 500.0, 400.0) == [0, 0, 128, 255, 255]
    assert grey(spark, [300, 500, 700], 500.0, 400.0, True) == [255, 127, 0]
    ramp = grey(spark, range(1000), low=0.0, high=100.0)
    assert ramp[0] == 0 and ramp[-1] == 255 and ramp == sorted(ramp)
    assert grey(spark, [0, 128, 255], 100.0, 0.0, low=0.0, high=100.0) == [0, 128, 255]
    assert grey(spark, [0, 128, 255], 100.0, -5.0, low=0.0, high=100.0) == [0, 128, 255]
    assert grey(spark, [700] * 16) == grey(spark, [700] * 16, inverted=True) == [0] * 16
    assert grey(spark, []) == []
    nothing = spark.createDataFrame([(None, None, None, None)], "pixels binary, centre double, window double, inverted boolean")
    assert pixels.windowed_pixels(nothing).head()["grey"] is None
    assert pixels.windowed_pixels(nothing.limit(0)).collect() == []


def test_large_images_leave_in_parts(spark):
    rows = spark.range(40, numPartitions=1).select(F.col("id"), F.expr("CAST(repeat('ab', 500000) AS BINARY)").alias("pixels"))
    rows = rows.selectExpr("id", "pixels", "double(1) AS centre", "double(9) AS window", "false AS inverted", "'kept' AS grey")
    got = pixels.windowed_pixels(rows).selectExpr("id", "length(grey) AS n").orderBy("id").collect()
    assert [(r["id"], r["n"]) for r in got] == [(i, 500000) for i in range(40)]


def folder_of(tmp_path, *names):
    folder = tmp_path / "img"
    folder.mkdir()
    for i, name in enumerate(names):
        (folder / name).write_bytes(pixels.png_file(bytes([i] * 6), 3, 2))
    return folder


def test_folder_sizes_and_missing_images(spark, tmp_path):
    folder = folder_of(tmp_path, "a.png", "b.png")
    (folder / "c.png").write_bytes(b"no image")
    listing = readers.images(spark, str(folder))
    assert sorted((r["image_id"], r["width"], r["height"]) for r in listing.collect()) == [("a", 3, 2), ("b", 3, 2), ("c", None, None)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")
    assert readers.images_of(ids("a", "a"), listing).count() == 1
    with pytest.raises(Exception, match="image not found: z"):
        readers.images_of(ids("a", "z"), listing).collect()


def records(spark, *paths, target=TARGET):
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    return rows.select(corpus.chat_record(F.col("p"), F.lit("prompt"), F.lit(target)).alias("record"))


def test_datasets(spark, tmp_path):
    folder = folder_of(tmp_path, "a.png", "b.png")
    out = str(tmp_path / "records")
    assert writers.write_records(records(spark, "b.png", f"{folder}/a.png", f"file:{folder}/b.png"), out) == 3
    got = datasets.image_dataset(spark, out, str(folder)).collect()
    assert sorted(bytes(r["images"][0]["rgb"])[0] for r in got) == [0, 1, 1]
    assert {(r["images"][0]["width"], r["images"][0]["height"], len(r["images"][0]["rgb"])) for r in got} == {(3, 2, 18)}
    assert all(r["messages"][1]["role"] == "assistant" for r in got)
    writers.write_records(records(spark, "gone.png"), out)
    with pytest.raises(Exception, match="image not found"):
        datasets.image_dataset(spark, out, str(folder)).collect()
    writers.write_records(records(spark), out)
    with pytest.raises(ValueError, match="no records"):
        datasets.image_dataset(spark, out, str(folder))
    published = str(tmp_path / "published")
    rows = datasets.with_files(records(spark, "a.png", "b.png"), str(folder))
    writers.write_splits(rows.withColumn("split", F.lit("train")), published)
    assert datasets.published_dataset(spark, published, "train").count() == 2
    writers.write_splits(rows.drop("messages").withColumn("split", F.lit("bad")), published)
    with pytest.raises(ValueError, match="messages"):
        datasets.published_dataset(spark, published, "bad")


def test_line_numbers_over_splits(spark, tmp_path):
    texts = {"x.jsonl": [f"{i}" * (i % 40) for i in range(5000)], "y.jsonl": ["", "a", "", "b"], "z.jsonl": []}
    (tmp_path / "in").mkdir()
    for name, rows in texts.items():
        (tmp_path / "in" / name).write_text("".join(f"{r}\r\n" if i % 2 else f"{r}\n" for i, r in enumerate(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.numbered_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        found = {}
        for r in got.collect():
            found.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line"]] = r["raw"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {n: dict(enumerate(rows, 1)) for n, rows in texts.items() if rows}


def test_checked_records_name_the_line(spark, tmp_path):
    out = str(tmp_path / "good")
    writers.write_records(records(spark, "a.png"), out)
    line = spark.read.text(out).head()[0]
    path = tmp_path / "r.jsonl"
    path.write_text(f"{line}\n\n{line}\n")
    assert [r["line"] for r in lines.checked_records(spark, str(path)).orderBy("line").collect()] == [1, 3]
    path.write_text(f"{line}\n\n{{broken\n")
    with pytest.raises(Exception, match="line 3 of .*no JSON"):
        lines.checked_records(spark, str(path)).collect()
    path.write_text(line + '\n{"image_path": "b"}\n')
    with pytest.raises(Exception, match="line 2 of .*pair of turns"):
        lines.checked_records(spark, str(path)).collect()
    assert lines.checked_records(spark, str(path), validate=False).count() == 2


def test_writes_replace_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "deep" / "out")
    assert writers.write_records(records(spark, "a.png", "b.png"), out) == 2
    with pytest.raises(ValueError, match="invalid record.*1 of 2"):
        writers.write_records(records(spark, "c.png").unionByName(records(spark, "d.png", target="x")), out)
    assert spark.read.text(out).count() == 2
    assert writers.write_records(records(spark, "e.png", target="x"), out, validate=False) == 1
    assert spark.read.text(out).count() == 1
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["out"]


def test_reports_are_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "long")
    report = spark.range(7, 8).select(seen("id").alias("tp"), F.lit(None).cast("double").alias("f1"))
    out = str(tmp_path / "rep")
    writers.write_report(report, out, "t1")
    assert calls.value == 1
    assert [json.loads(spark.read.text(f"{out}/{p}").head()[0]) for p in ("latest", "history/t1")] == [{"tp": 7, "f1": None}] * 2
    with pytest.raises(ValueError, match="t1"):
        writers.write_report(report.limit(0), out, "t1")
    assert spark.read.text(f"{out}/latest").count() == 1
    writers.write_report(report, out, "t2")
    assert sorted(p.name for p in (tmp_path / "rep" / "history").iterdir()) == ["t1", "t2"]


def test_report_document(spark, tmp_path):
    per = spark.sql("SELECT * FROM VALUES ('b', 1, CAST(NULL AS DOUBLE)), ('a\"x', 2, 0.5D) AS t(finding, tp, f1)")
    parts = [
        ("presence", spark.sql("SELECT 3 AS n_cases, CAST(NULL AS DOUBLE) AS macro_f1")),
        ("presence", per, "per_finding", "finding"),
        ("flags", per.limit(0), "by_flag", "finding"),
    ]
    made = writers.report_document("image", parts)
    text = made.head()["value"]
    want = {"mode": "image", "presence": {"n_cases": 3, "macro_f1": None, "per_finding": {'a"x': {"tp": 2, "f1": 0.5}, "b": {"tp": 1, "f1": None}}}, "flags": {"by_flag": {}}}
    assert json.loads(text) == want and list(json.loads(text)) == ["mode", "presence", "flags"]
    writers.write_report(made, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc/latest")).head()[0] == text
    with pytest.raises(Exception, match="more than one row"):
        writers.report_document("image", [("presence", per)]).collect()


def test_boxes_by_image(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 2, 'x', 'X'), ('a', 1, 'y', 'Y'), ('b', NULL, NULL, NULL) AS t(image_id, ord, finding, native_label)")
    got = {r["image_id"]: [b["finding"] for b in r["boxes"]] for r in readers.boxes_by_image(rows).collect()}
    assert got == {"a": ["y", "x"], "b": []}
    assert readers.default_path(spark, "/tmp", ["none-1", "none-2"]) == "/tmp/none-2"


def test_plan_summary_and_pool_pairs(spark):
    listing = spark.createDataFrame([("a.png", b"x" * 2048)], "path string, bytes binary")
    summed = lambda *p: writers.plan_summary(writers.corpus_plan(records(spark, *p), listing), "r.jsonl", "img", "set").head()["summary"]
    assert summed("a.png").split("\n")[2:] == ["published as: set, split train, private", "records: 1", "different images: 1", "images missing: 0", "image bytes: 2.0 KB"]
    assert summed("a.png", "b.png").endswith("warning: publishing would fail on 1 missing images")
    assert sampling.pool_pairs(name=["a", "b"], path=["x", "y"]) == [{"name": "a", "path": "x"}, {"name": "b", "path": "y"}]
    assert sampling.pool_pairs(name=[], path=[]) == []
    with pytest.raises(ValueError, match="differ"):
        sampling.pool_pairs(name=["a"], path=[])
