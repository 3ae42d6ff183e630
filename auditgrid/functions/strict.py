"""Strict reading of a whole audit result: a schema of nested members walked over a VARIANT.

A rule gives, for a value and its path, the first error, or null where the value is valid.
A missing member takes its default, an unknown one is an error at every level.  Numbers may
be written as strings, and true and false count as 1 and 0; strings must be strings.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import valid_box
from .json_lists import parsed_object
from .scalars import let
from .vocab import normalized_finding

#: A rule: (value, path) -> error or null.
Rule = Callable[[Column, str], Column]
STATUSES = ("present", "absent")
FLAGS = ("missing_findings", "unsupported_claims", "urgent_review_flags")


class Member(NamedTuple):
    name: str
    rule: Rule
    required: bool = False


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _error(bad: Column, path: str, why: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), f"{path}: {why}")


def _value(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def optional(rule: Rule) -> Rule:
    """A rule that also takes null."""
    return lambda v, path: F.when(~F.is_variant_null(v), rule(v, path))


def string(v: Column, path: str) -> Column:
    return _error(_kind(v) != "STRING", path, "not a string")


def label(v: Column, path: str) -> Column:
    return F.coalesce(string(v, path), _error(let(_value(v, "string"), lambda c: normalized_finding(c)).isNull(), path, "not a canonical finding"))


def status(v: Column, path: str) -> Column:
    return F.coalesce(string(v, path), _error(~_value(v, "string").isin(*STATUSES), path, "neither present nor absent"))


def confidence(v: Column, path: str) -> Column:
    return _error(let(_value(v, "double"), lambda n: F.isnan(n) | ~n.between(0.0, 1.0)), path, "not a number in [0, 1]")


def box(v: Column, path: str) -> Column:
    return _error(let(_value(v, "array<double>"), valid_box).isNull(), path, "not a box of four ordered numbers in [0, 1]")


def items(rule: Rule) -> Rule:
    """A list whose items all follow a rule; the first one's error counts."""

    def check(v: Column, path: str) -> Column:
        first = lambda xs: F.get(F.filter(F.transform(xs, lambda x: rule(x, f"{path}[]")), lambda e: e.isNotNull()), F.lit(0))
        return let(_value(v, "array<variant>"), lambda xs: F.coalesce(F.when(xs.isNull(), f"{path}: not a list"), first(xs)))

    return check


def _checked(m: Member, at: str) -> Callable[[Column], Column]:
    absent = F.lit(f"{at}: missing") if m.required else F.lit(None).cast("string")
    return lambda x: F.when(x.isNull(), absent).otherwise(m.rule(x, at))


def members(*known: Member) -> Rule:
    """An object of known members."""

    def check(v: Column, path: str) -> Column:

        def first(held: Column) -> Column:
            extra = F.filter(F.map_keys(held), lambda k: ~k.isin(*[m.name for m in known]))
            unknown = let(extra, lambda e: F.when(F.size(e) > 0, F.concat(F.lit(f"{path}: unknown members "), F.array_join(F.array_sort(e), ", "))))
            errors = [let(F.try_element_at(held, F.lit(m.name)), _checked(m, f"{path}.{m.name}")) for m in known]
            return F.coalesce(F.when(held.isNull(), f"{path}: not an object"), unknown, *errors)

        return let(_value(v, "map<string,variant>"), first)

    return check


IMAGE_FINDING = members(Member("finding", label, True), Member("status", status), Member("box", optional(box)), Member("confidence", optional(confidence)), Member("evidence", optional(string)))
DRAFT_FINDING = members(Member("finding", label, True), Member("status", status), Member("span", optional(string)))
AUDIT = members(*[Member(f, items(string)) for f in FLAGS])
RESULT = members(Member("image_findings", items(IMAGE_FINDING)), Member("draft_findings", items(DRAFT_FINDING)), Member("audit", AUDIT), Member("disclaimer", string), Member("box_format", string))


def _filled(v: Column, disclaimer: str, box_format: str) -> Column:
    """The result of a valid value, with defaults in place and labels in canonical form."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    text = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    common = lambda x: [let(text(x, "finding"), lambda c: normalized_finding(c)).alias("finding"), F.coalesce(text(x, "status"), F.lit("present")).alias("status")]
    more = {
        "image_findings": lambda x: [F.try_variant_get(x, "$.box", "array<double>").alias("box"), F.try_variant_get(x, "$.confidence", "double").alias("confidence"), text(x, "evidence").alias("evidence")],
        "draft_findings": lambda x: [text(x, "span").alias("span")],
    }
    shapes = {"image_findings": "array<struct<finding:string,status:string,box:array<double>,confidence:double,evidence:string>>", "draft_findings": "array<struct<finding:string,status:string,span:string>>"}
    item = lambda n: lambda x: F.struct(*common(x), *more[n](x))
    lists = [F.coalesce(F.transform(get(f"$.{n}", "array<variant>"), item(n)), F.array().cast(k)).alias(n) for n, k in shapes.items()]
    flags = F.struct(*[F.coalesce(get(f"$.audit.{f}", "array<string>"), F.array().cast("array<string>")).alias(f) for f in FLAGS])
    return F.struct(*lists, flags.alias("audit"), F.coalesce(get("$.disclaimer", "string"), F.lit(disclaimer)).alias("disclaimer"), F.coalesce(get("$.box_format", "string"), F.lit(box_format)).alias("box_format"))


def strict_result(text: Column, disclaimer: str, box_format: str) -> Column:
    """(ok, error, result) of model text: the first JSON object in it as a valid audit result.

    ``error`` names the first member that is wrong; a text without a readable object has that
    as its error.  ``result`` is null where ok is false.
    """

    def read(parse: Column) -> Column:
        return let(F.try_parse_json(F.get(parse["elements"], F.lit(0))), lambda v: checked(parse, v))

    def checked(parse: Column, v: Column) -> Column:
        error = F.when(parse["ok"], F.coalesce(F.when(v.isNull(), F.lit("invalid JSON object")), RESULT(v, "result"))).otherwise(parse["error"])
        return let(error, lambda e: F.struct(e.isNull().alias("ok"), e.alias("error"), F.when(e.isNull(), _filled(v, disclaimer, box_format)).alias("result")))

    return let(parsed_object(text), read)
