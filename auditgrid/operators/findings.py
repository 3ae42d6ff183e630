"""Tables of findings: parsed model output, first-wins rules, label sets.

Image findings: image_id, ord, finding, status, box, confidence, evidence.
Draft findings: image_id, ord, finding, status, span.
``ord`` gives the order in which they were written; no rule here depends on the order of
partitions.  Equal ``ord`` of one image are told apart by the other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..functions.json_lists import parsed_list
from ..functions.scalars import coerced_confidence, coerced_status, let, without_reasoning
from ..functions.vocab import NO_FINDING, POSITIVE, label_bit, labels_of, normalized_finding


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order; null keys are equal to each other."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def parsed_outputs(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``parse`` (ok, error, elements) of model text; the text stays, so failures can be kept apart."""
    return raw.withColumn("parse", parsed_list(without_reasoning(F.col(text))))


def quarantine(parsed: DataFrame, text: str = "raw_text", limit: int = 2000) -> DataFrame:
    """The failures, with the head of their text."""
    return parsed.filter(~F.col("parse.ok")).withColumn("error", F.col("parse.error")).withColumn(text, F.left(F.col(text), F.lit(limit))).drop("parse")


def _string(v: Column, path: str) -> Column:
    """A member that is a JSON string; null for any other kind."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _label(v: Column) -> Column:
    """The canonical label of an element; one of another kind than a string is none in text form either."""
    return let(F.try_variant_get(v, "$.label", "string"), lambda c: normalized_finding(c))


def _read(parsed: DataFrame, ids: list[str], members: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """ids, ord and the members of each element of parsed output, without those of no known label.

    Members are read inside the array, so that a text is parsed once and not for every filter.
    """
    one = lambda e: let(F.try_parse_json(e), lambda v: F.struct(*[c.alias(n) for n, c in members(v).items()]))
    rows = parsed.select(*ids, F.posexplode_outer(F.transform("parse.elements", one)).alias("ord", "_f"))
    return rows.filter("_f.finding IS NOT NULL").select(*ids, "ord", "_f.*")


def image_findings(parsed: DataFrame, id_col: str | list[str] = "image_id", only: tuple[str, ...] = ()) -> DataFrame:
    """Canonical image findings of parsed output; an unreadable box becomes null, the finding stays.

    With ``only`` no other members are read than finding, status, box and these.
    """
    ids = [id_col] if isinstance(id_col, str) else id_col
    members = lambda v: {
        "finding": _label(v),
        "status": F.lit("present"),
        "box": let(F.try_variant_get(v, "$.box_2d", "array<double>"), valid_box),
        **{n: c for n, c in (("confidence", let(F.try_variant_get(v, "$.confidence", "double"), coerced_confidence)), ("evidence", _string(v, "$.evidence"))) if not only or n in only},
    }
    return first_wins(_read(parsed, ids, members), [*ids, "finding", "box"], ["ord"])


def image_labels(elements: Column) -> Column:
    """The canonical labels that image_findings() has for an output's elements, each once.

    A label of another kind than a string is none in text form either.
    """
    label = lambda e: let(F.get_json_object(e, "$.label"), lambda c: normalized_finding(c))
    return F.array_compact(F.array_distinct(F.transform(elements, label)))


def draft_findings(parsed: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Canonical draft findings of parsed output, the first of each label and status."""
    members = lambda v: {"finding": _label(v), "status": let(F.try_variant_get(v, "$.status", "string"), coerced_status), "span": _string(v, "$.span")}
    return first_wins(_read(parsed, [id_col], members), [id_col, "finding", "status"], ["ord"])


def first_claims(elements: Column) -> Column:
    """The first present row that draft_findings() has for each positive label of an output's elements: an array of (ord, span).

    Null stands for a label that is not claimed; the array is in canonical order.
    """
    member = lambda e, name, read: let(F.get_json_object(e, f"$.{name}"), read)
    one = lambda e, i: F.struct(i.alias("ord"), member(e, "label", lambda c: normalized_finding(c)).alias("finding"), member(e, "status", coerced_status).alias("status"), e.alias("e"))
    stated = lambda xs: F.filter(xs, lambda x: x["finding"].isin(*POSITIVE) & (x["status"] == "present"))
    first = lambda xs, label: F.get(F.filter(xs, lambda x: x["finding"] == label), F.lit(0))
    # only the claim that stands is read for its words, whose kind matters
    claim = lambda y: F.when(y.isNotNull(), F.struct(y["ord"].alias("ord"), let(F.try_parse_json(y["e"]), lambda v: _string(v, "$.span")).alias("span")))
    return let(stated(F.transform(elements, one)), lambda xs: F.transform(F.array(*[first(xs, label) for label in POSITIVE]), claim))


def first_readable(attempts: DataFrame, id_col: str = "image_id") -> DataFrame:
    """For each id the first attempt that parses: attempt, elements (null if none does), tried."""
    ok = F.col("parse.ok")
    best = F.min(F.when(ok, F.struct("attempt", F.col("parse.elements").alias("elements")))).alias("best")
    return attempts.groupBy(id_col).agg(best, F.count(F.lit(1)).alias("tried")).select(id_col, F.col("best.attempt").alias("attempt"), F.col("best.elements").alias("elements"), "tried", F.col("best").isNotNull().alias("ok"))


def asserted(rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Present positive findings, the first of each label, with their other columns."""
    return first_wins(rows.filter((F.col("status") == "present") & F.col("finding").isin(*POSITIVE)), [id_col, "finding"], ["ord"])


def label_sets(ids: DataFrame, rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """id, labels (present positives in canonical order), absent, signature: a row for every id."""
    from .audit import with_ids

    held = F.bit_or(F.when(F.col("status") == "present", label_bit(F.col("finding"))))
    sets = with_ids(rows.select(id_col, "finding", "status"), ids, id_col).groupBy(id_col).agg(held.alias("held"), F.max("_asked").alias("_asked")).filter("_asked")
    joined = sets.select(id_col, F.coalesce("held", F.lit(0)).alias("held"))
    labels, none = labels_of(F.col("held")), F.col("held") == 0
    absent = labels_of(F.bitwise_not(F.col("held")))
    signature = F.when(none, NO_FINDING).otherwise(F.array_join(F.array_sort(labels), "+"))
    return joined.select(id_col, labels.alias("labels"), absent.alias("absent"), signature.alias("signature"), none.alias("is_normal"))


def merged_findings(grouped: DataFrame, extra: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Findings and, after them, those of a second source that are new by (finding, box).

    Ids that only the second source has, and its rows without a finding, are left out.
    """
    known = extra.filter("finding IS NOT NULL").join(grouped.select(id_col).distinct(), id_col, "left_semi")
    cols = [id_col, "ord", "finding", "box"]
    both = grouped.select(*cols, F.lit(0).alias("source")).unionByName(known.select(*cols, F.lit(1).alias("source")))
    kept = first_wins(both.filter("source = 1").join(grouped.select(id_col, "finding", "box"), _same(both, grouped, id_col), "left_anti"), [id_col, "finding", "box"], ["ord"])
    return both.filter("source = 0").unionByName(kept)


def _same(a: DataFrame, b: DataFrame, id_col: str) -> Column:
    return (a[id_col] == b[id_col]) & a["finding"].eqNullSafe(b["finding"]) & a["box"].eqNullSafe(b["box"])


def missing_files(paths: DataFrame, listing: DataFrame, col: str = "path") -> DataFrame:
    """Distinct paths that a listing of files does not have."""
    return paths.select(col).distinct().join(listing.select(col), col, "left_anti")
