"""Evaluation: presence, localisation and flag metrics, as aggregates.

Undefined ratios are null, so averages skip them; ``n_defined`` tells over how many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import CANONICAL, POSITIVE, URGENT, canonical_ord
from .matching import greedy_matches, overlap_pairs, rates
from .pooled import pooled_overlaps


def checked_labels(rows: DataFrame, col: str = "finding") -> DataFrame:
    """The rows, failing on a label outside of the vocabulary."""
    wrong = F.raise_error(F.concat(F.lit("not a canonical finding: "), F.coalesce(F.col(col), F.lit("null")))).cast("string")
    return rows.withColumn(col, F.when(F.col(col).isin(*CANONICAL), F.col(col)).otherwise(wrong))


def _counts(pred: DataFrame, gold: DataFrame, keys: list[str], case: str) -> DataFrame:
    """tp, fp, fn by keys of two sets of (case, keys), in one shuffle."""
    rows = pred.select(case, *keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(case, *keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
    per = rows.groupBy(case, *keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    total = lambda c: F.sum(c.cast("long"))
    return per.groupBy(*keys).agg(total(F.col("p") * F.col("g")).alias("tp"), total(F.col("p") * (1 - F.col("g"))).alias("fp"), total((1 - F.col("p")) * F.col("g")).alias("fn"))


def _counts_of_each(pred: DataFrame, gold: DataFrame, by: list[str], case: str) -> DataFrame:
    """tp and fp by (by, finding), where only ``pred`` has the columns ``by``."""
    said = pred.select(*by, case, "finding").distinct()
    true = gold.select(case, "finding").distinct()
    hits = said.join(true.withColumn("hit", F.lit(1)), [case, "finding"], "left")
    per = hits.groupBy(*by, "finding").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("n"))
    return per.select(*by, "finding", "tp", (F.col("n") - F.col("tp")).alias("fp"))


def presence_metrics(pred: DataFrame, gold: DataFrame, case: str = "image_id", by: list[str] | None = None) -> DataFrame:
    """finding, tp, fp, fn, precision, recall, f1: a row for each positive label (of each ``by``).

    ``by`` are columns of ``pred`` alone: each of their values is held against all of the gold rows.
    """
    by = by or []
    held = lambda x: checked_labels(x.filter("status = 'present'")).filter(F.col("finding").isin(*POSITIVE))
    frame = pred.sparkSession.createDataFrame([(x,) for x in POSITIVE], "finding string")
    if by:
        # a value of `by` that says nothing present still has its rows
        frame = pred.select(*by).distinct().join(F.broadcast(frame))
        counts = _counts_of_each(held(pred), held(gold), by, case)
        n_gold = held(gold).select(case, "finding").distinct().groupBy("finding").agg(F.count(F.lit(1)).alias("n_gold"))
        out = frame.join(counts, [*by, "finding"], "left").join(n_gold, "finding", "left")
        out = out.fillna(0, ["tp", "fp", "n_gold"]).withColumn("fn", F.col("n_gold") - F.col("tp"))
    else:
        out = frame.join(_counts(held(pred), held(gold), ["finding"], case), "finding", "left").fillna(0, ["tp", "fp", "fn"])
    return out.select(*by, "finding", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """macro_f1 over the labels where it is defined, and how many those are."""
    return metrics.groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"), F.count("f1").alias("n_defined"))


def urgent_recall(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("finding").isin(*URGENT)).select("finding", "tp", "fn", "recall")


def _boxed(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("status") == "present") & F.col("finding").isin(*POSITIVE) & F.col("box").isNotNull())


def _matches(p: DataFrame, g: DataFrame, threshold: float, id_col: str, by: list[str], scope: str) -> DataFrame:
    if scope == "pooled" and by:
        raise ValueError("the pooled scope takes one model at a time")
    if scope == "pooled":
        return pooled_overlaps(p, g, threshold, id_col)
    return greedy_matches(overlap_pairs(p, g, [id_col, "finding"], by), [*by, id_col, "finding"], threshold).withColumn("n", F.lit(1))


def _at_thresholds(matches: DataFrame, thresholds, keys: list[str]) -> DataFrame:
    """threshold, keys, tp, iou (their sum) of matches (n of each row) found at the least of the thresholds.

    Matches are taken from the largest overlap down, so those of a higher threshold are
    the ones that reach it: one join and one fold serve all thresholds.
    """
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("iou") >= t)
    rows = matches.withColumn("threshold", F.explode(reached))
    return rows.groupBy("threshold", *keys).agg(F.sum("n").alias("tp"), F.sum(F.col("iou") * F.col("n")).alias("iou"))


def localization(pred: DataFrame, gold: DataFrame, thresholds=(0.3, 0.5), id_col: str = "image_id", by: list[str] | None = None, scope: str = "image") -> DataFrame:
    """threshold, finding (null: all), tp, fp, fn, precision, recall, f1, mean_iou (of each ``by``).

    Boxes of present positive findings, matched within an image and label, or by label over
    all images (``scope='pooled'``, for one model).  Labels without any box have no row of their own.  ``by`` are columns of ``pred`` alone: each of their
    values is held against all of the gold rows.
    """
    by = by or []
    p, g = _boxed(pred), _boxed(gold)
    matches = _matches(p, g, min(thresholds), id_col, by, scope)
    found = _at_thresholds(matches, thresholds, [*by, "finding"])
    frame = pred.sparkSession.createDataFrame([(x, float(t)) for x in POSITIVE for t in thresholds], "finding string, threshold double")
    if by:
        frame = pred.select(*by).distinct().join(F.broadcast(frame))
    n_pred = p.groupBy(*by, "finding").agg(F.count(F.lit(1)).alias("n_pred"))
    n_gold = g.groupBy("finding").agg(F.count(F.lit(1)).alias("n_gold"))
    per = frame.join(n_pred, [*by, "finding"], "left").join(n_gold, "finding", "left").join(found, ["threshold", *by, "finding"], "left")
    per = per.fillna(0, ["n_pred", "n_gold", "tp"]).filter("n_pred + n_gold > 0")
    sums = [F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold", "iou")]
    keys = ["threshold", *by]
    total = per.groupingSets([[*keys, "finding"], keys], *keys, "finding").agg(F.grouping("finding").alias("whole"), *sums)
    total = total.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("tp"))
    finding = F.when(F.col("whole") == 0, F.col("finding")).alias("finding")
    mean = F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).alias("mean_iou")
    return total.select(*by, "threshold", finding, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), mean)


#: The least overlap that counts at all.
ANY_OVERLAP = 1e-9


def mean_iou(pred: DataFrame, gold: DataFrame, thresholds=(0.3, ANY_OVERLAP), id_col: str = "image_id", by: list[str] | None = None, scope: str = "image") -> DataFrame:
    """threshold, n_pairs, mean_iou of the matched boxes (of each ``by``); null without a pair."""
    by = by or []
    found = _at_thresholds(_matches(_boxed(pred), _boxed(gold), min(thresholds), id_col, by, scope), thresholds, by)
    frame = pred.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    if by:
        frame = pred.select(*by).distinct().join(F.broadcast(frame))
    out = frame.join(found, ["threshold", *by], "left")
    return out.select(*by, "threshold", F.coalesce("tp", F.lit(0)).alias("n_pairs"), (F.col("iou") / F.col("tp")).alias("mean_iou"))


def flag_metrics(pred: DataFrame, gold: DataFrame, case: str = "image_id") -> DataFrame:
    """flag, tp, fp, fn, precision, recall, f1 over rows (case, flag, finding)."""
    rows = [x.select(case, "flag", "finding").distinct().select(F.struct(case, "finding").alias("at"), "flag") for x in (pred, gold)]
    c = _counts(*rows, ["flag"], "at")
    return c.select("flag", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def flag_metrics_of_cases(cases: DataFrame, flags: tuple[str, ...], pred: str = "predicted", gold: str = "expected") -> DataFrame:
    """flag_metrics() of a row for each case, with two structs of an array of labels for each flag.

    Nothing is dealt by case: the sets of a case are compared within its row.  A flag that no
    case has, on either side, has no row.
    """
    size = lambda x: F.size(x).cast("long")
    sets = {f: [F.coalesce(F.array_distinct(F.col(f"{side}.{f}")), F.array().cast("array<string>")) for side in (pred, gold)] for f in flags}
    counts = [F.struct(F.lit(f).alias("flag"), size(F.array_intersect(p, g)).alias("tp"), size(F.array_except(p, g)).alias("fp"), size(F.array_except(g, p)).alias("fn")) for f, (p, g) in sets.items()]
    per = cases.select(F.inline(F.array(*counts))).groupBy("flag").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).filter("tp + fp + fn > 0")
    return per.select("flag", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def distribution(sets: DataFrame) -> DataFrame:
    """total, normal, positive and a map of images by label, of label_sets() rows."""
    per = [F.sum(F.array_contains("labels", x).cast("long")).alias(x) for x in POSITIVE]
    out = sets.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("is_normal").cast("long")).alias("normal"), *per)
    return out.select("total", "normal", (F.col("total") - F.col("normal")).alias("positive"), F.create_map(*[x for y in POSITIVE for x in (F.lit(y), F.coalesce(F.col(y), F.lit(0)))]).alias("per_label"))


def label_counts(sets: DataFrame) -> DataFrame:
    """finding, images: every positive label, in canonical order of its number."""
    d = distribution(sets).select(F.explode("per_label").alias("finding", "images"))
    return d.withColumn("canonical_ord", canonical_ord(F.col("finding")))


def parse_failures(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count(F.lit(1)).alias("outputs"), F.count_if(~F.col("parse.ok")).alias("failures"))
