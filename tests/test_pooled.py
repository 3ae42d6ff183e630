"""Matches over all images of a label against a plain loop."""

from __future__ import annotations

import random

import pytest
from auditgrid.functions.geometry import BOX
from auditgrid.operators import metrics, pooled

KIND = f"image_id int, ord int, finding string, status string, box {BOX}"


def _iou(a, b):
    high, wide = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    inter = high * wide
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def greedy(p, g, threshold):
    out = []
    for label in {r[2] for r in p}:
        pairs = sorted((-x, a[:2], b[:2]) for a in p for b in g if a[2] == b[2] == label and a[4] and b[4] and (x := _iou(a[4], b[4])) >= threshold and x > 0)
        used: set = set()
        for less, i, j in pairs:
            if ("p", i) not in used and ("g", j) not in used:
                used |= {("p", i), ("g", j)}
                out.append((label, i, j, round(-less, 12)))
    return sorted(out)


def boxes(seed, n, steps):
    """Random boxes; on a coarse grid many are equal or overlap equally."""
    rng = random.Random(seed)
    at = (lambda: rng.randrange(steps) / (2 * steps)) if steps else (lambda: rng.random() / 2)
    rows = []
    for k in range(n):
        y, x = at(), at()
        size = rng.choice([0.25, 0.25, 0.5])
        rows.append((k % 7, k, rng.choice(["cardiomegaly", "nodule_mass"]), "present", None if k % 19 == 0 else (y, x, y + size, x + 0.25)))
    return rows


@pytest.mark.parametrize(("steps", "fold"), [(0, pooled.FOLD_PAIRS), (4, pooled.FOLD_PAIRS), (4, 40), (0, 25)])
def test_pooled_matches_equal_a_plain_loop(spark, steps, fold):
    p, g = boxes(1, 90, steps), boxes(2, 70, steps)
    tables = [spark.createDataFrame(x, KIND).repartition(3) for x in (p, g)]
    for threshold in (0.3, 0.0):
        got = sorted((r["finding"], tuple(r["i"]), tuple(r["j"]), round(r["iou"], 12)) for r in pooled.pooled_matches(*tables, threshold, fold_pairs=fold).collect())
        assert got == greedy(p, g, threshold)


def test_pooled_reports_and_empty_sides(spark):
    p, g = boxes(3, 40, 0), boxes(4, 40, 0)
    a, b = spark.createDataFrame(p, KIND), spark.createDataFrame(g, KIND)
    want = greedy(p, g, 0.3)
    total = metrics.localization(a, b, (0.3,), scope="pooled").filter("finding IS NULL").head()
    assert total["tp"] == len(want) and total["mean_iou"] == pytest.approx(sum(x[3] for x in want) / len(want))
    assert metrics.mean_iou(a, b, (0.3,), scope="pooled").head()["n_pairs"] == len(want)
    assert pooled.pooled_matches(a.limit(0), b, 0.3).count() == 0 and pooled.pooled_matches(a, b.limit(0), 0.3).count() == 0
    with pytest.raises(ValueError, match="one model"):
        metrics.mean_iou(a, b, by=["model"], scope="pooled")


def test_places_of_a_hot_key_span_ranges(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 4 = 0 THEN id % 8 ELSE 1 END AS k", "(id * 37) % 1000 AS v").repartition(5)
    got = pooled.numbered(rows, ["k"], ["v"], "n").toPandas().sort_values(["k", "v"])
    assert (got["n"] == got.groupby("k").cumcount() + 1).all() and len(got) == 1000


@pytest.mark.parametrize("fold", [pooled.FOLD_PAIRS, 3])
def test_copies_are_matched_as_queues_from_known_heads(spark, fold):
    # three sizes on a grid of four places: large classes of equal boxes whose pairs tie
    p, g = boxes(5, 60, 2), boxes(6, 75, 2)
    a, b = (spark.createDataFrame(x, KIND).repartition(5) for x in (p, g))
    for most in (6, 20):
        got = sorted((r["finding"], tuple(r["i"]), tuple(r["j"]), round(r["iou"], 12)) for r in pooled.pooled_matches(a, b, 0.1, fold_pairs=fold, fold_rows=most).collect())
        assert got == greedy(p, g, 0.1)


def test_pairs_are_of_classes_and_not_of_their_copies(spark):
    rows = spark.range(40_000).selectExpr("id AS image_id", "1 AS ord", "'cardiomegaly' AS finding", "'present' AS status", "named_struct('y0', 0.1D * (id % 4), 'x0', 0D, 'y1', 0.1D * (id % 4) + 0.5D, 'x1', 0.5D) AS box")
    out = pooled.pooled_overlaps(rows.filter("image_id % 8 < 3"), rows.filter("image_id % 8 >= 3"), 0.3)
    assert out.count() < 20 and out.agg({"n": "sum"}).head()[0] == 15_000
