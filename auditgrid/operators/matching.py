"""Box pairs, clusters and one-to-one matches within an image and label.

All pairs come from equi-joins on (image, label) or image, so work is linear in images
whatever the corpus; the pooled scope is in ``pooled``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, iou
from ..functions.scalars import let
from ..functions.vocab import specificity_rank


def same_label_pairs(boxes: DataFrame, threshold: float, id_col: str = "image_id") -> DataFrame:
    """id, finding, i < j (ords), iou of the boxes of one label that overlap so far."""
    rows = boxes.filter("box IS NOT NULL").select(id_col, "finding", "ord", "box")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.finding") == F.col("b.finding")) & (F.col("a.ord") < F.col("b.ord"))
    pairs = a.join(b, same).select(F.col(f"a.{id_col}").alias(id_col), F.col("a.finding").alias("finding"), F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), iou(F.col("a.box"), F.col("b.box")).alias("iou"))
    return pairs.filter(F.col("iou") >= threshold)


def merged_boxes(boxes: DataFrame, threshold: float = 0.5, id_col: str = "image_id") -> DataFrame:
    """id, finding, cluster (its first ord), n, box (the mean): connected boxes of a label merged.

    Two boxes are linked from the threshold on; a cluster is a connected component.  A fold
    over an image's label spreads least places along links, hands each to all boxes of the
    place that it reached, and jumps to the place's own: a few rounds, after which it only
    passes its result on.
    """
    item = F.struct("ord", "box")
    lists = boxes.filter("box IS NOT NULL").groupBy(id_col, "finding").agg(F.array_sort(F.collect_list(item)).alias("items"))
    linked = F.transform("items", lambda a, i: F.transform("items", lambda b, j: (i == j) | (iou(a["box"], b["box"]) >= threshold)))
    lists = lists.withColumn("linked", F.when(F.size("items") > 1, linked))
    start = F.struct(F.transform("items", lambda _, i: i).alias("at"), F.lit(False).alias("done"))
    places = F.sequence(F.lit(0), F.size("items") - 1)
    least = lambda rows, at: F.transform(rows, lambda row: F.array_min(F.zip_with(row, at, lambda on, x: F.when(on, x))))
    hooked = lambda at, near: F.transform(places, lambda p: F.array_min(F.zip_with(at, near, lambda x, n: F.when(x == p, n))))
    moved = lambda at, near: let(hooked(at, near), lambda to: F.transform(at, lambda x: F.get(to, x)))
    jumped = lambda at: F.transform(at, lambda x: F.get(at, x))
    following = lambda at: let(let(least("linked", at), lambda near: moved(at, near)), jumped)
    round_ = lambda s: let(following(s["at"]), lambda now: F.struct(now.alias("at"), (now == s["at"]).alias("done")))
    labels = F.aggregate("items", start, lambda s, _: F.when(s["done"], s).otherwise(round_(s)))["at"]
    # one read of the lists: a box alone is its own cluster
    rows = lists.withColumn("labels", F.when(F.size("items") > 1, labels).otherwise(F.array(F.lit(0)))).select(id_col, "finding", F.explode(F.arrays_zip("items", "labels")).alias("x"), "items")
    keyed = rows.select(id_col, "finding", F.element_at("items", F.col("x.labels") + 1)["ord"].alias("cluster"), F.col("x.items.box").alias("box"))
    mean = F.struct(*[F.avg(f"box.{n}").alias(n) for n in AXES])
    return keyed.groupBy(id_col, "finding", "cluster").agg(F.count(F.lit(1)).alias("n"), mean.alias("box"))


def cross_label_resolved(boxes: DataFrame, threshold: float = 0.6, id_col: str = "image_id") -> DataFrame:
    """Rows without the less specific of two overlapping boxes of different labels.

    Of equally specific labels the later row goes.  A row that goes still rules out others.
    An image's rows are one list, so that they are made and shuffled once; the time grows
    with the square of the boxes of one image.
    """
    if threshold <= 0:
        return boxes
    item = F.struct(*[c for c in boxes.columns if c != id_col], F.struct(specificity_rank(F.col("finding")), "ord").alias("_turn"))
    lists = boxes.groupBy(id_col).agg(F.collect_list(item).alias("items"))
    beats = lambda b, a: (a["_turn"] > b["_turn"]) & (a["finding"] != b["finding"]) & b["box"].isNotNull() & (iou(a["box"], b["box"]) >= threshold)
    stays = lambda a: F.col(id_col).isNull() | a["box"].isNull() | ~F.coalesce(F.exists("items", lambda b: beats(b, a)), F.lit(False))
    kept = lists.select(id_col, F.inline(F.filter("items", stays)))
    return kept.select(*boxes.columns)


def overlap_pairs(predicted: DataFrame, expected: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Pairs with their overlap: by, keys, i, j, iou - for all pairs that overlap at all.

    ``by`` are further columns of the predicted rows, such as the model that wrote them.
    """
    by = by or []
    p = predicted.filter("box IS NOT NULL").select(*by, *keys, F.col("ord").alias("i"), F.col("box").alias("p"))
    g = expected.filter("box IS NOT NULL").select(*keys, F.col("ord").alias("j"), F.col("box").alias("g"))
    return p.join(g, keys).select(*by, *keys, "i", "j", iou(F.col("p"), F.col("g")).alias("iou")).filter("iou > 0")


def greedy_matches(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, i, j, iou: taken from the largest overlap down while both ends are free.

    Ties go to the smaller i, then j.  A fold over the sorted pairs of each key.
    """
    item = F.struct((-F.col("iou")).alias("less"), "i", "j")
    lists = pairs.filter(F.col("iou") >= threshold).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    kind = pairs.select("i", "j").schema
    state = f"array<struct<less:double,i:{kind['i'].dataType.simpleString()},j:{kind['j'].dataType.simpleString()}>>"
    taken = lambda acc, x: F.exists(acc, lambda m: (m["i"] == x["i"]) | (m["j"] == x["j"]))
    fold = F.aggregate("pairs", F.array().cast(state), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, x)))
    return lists.select(*keys, F.explode(fold).alias("m")).select(*keys, "m.i", "m.j", (-F.col("m.less")).alias("iou"))


def matched(predicted: DataFrame, expected: DataFrame, threshold: float, scope: str = "image", id_col: str = "image_id") -> DataFrame:
    """Greedy matches by (image, label), or by label over all images (``scope='pooled'``)."""
    if scope == "image":
        return greedy_matches(overlap_pairs(predicted, expected, [id_col, "finding"]), [id_col, "finding"], threshold)
    from .pooled import pooled_matches

    return pooled_matches(predicted, expected, threshold, id_col)


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 columns of counts."""
    from ..functions.scalars import f1, ratio

    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]
