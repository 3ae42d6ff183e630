"""Tolerant reading of JSON that models write: an Arrow UDF, as the scan is sequential.

A text becomes a struct (ok, error, elements): elements are JSON strings of the objects
found, re-written so that keys are unique (the last wins) and no number is NaN or infinite.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("elements", T.ArrayType(T.StringType()))])
MOST_SALVAGED = 64
_FENCED = re.compile(r"^\s*```(?:json)?\s*(.*?)\s*```\s*$", re.DOTALL)
_PAIRS = {"{": "}", "[": "]"}


_DECODER = json.JSONDecoder()
_ENCODER = json.JSONEncoder(ensure_ascii=False, allow_nan=False, check_circular=False)


class Unreadable(ValueError):
    pass


def _well_formed(text: str, start: int):
    """The JSON value that begins at ``start``, whatever follows it; None if it is broken."""
    try:
        return _DECODER.raw_decode(text, start)[0]
    except ValueError:
        return None


def closing(text: str, start: int) -> int:
    """Where the bracket at ``start`` is closed, outside of strings; -1 if nowhere."""
    opens, closes = text[start], _PAIRS[text[start]]
    depth, place = 0, start
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|$)|[' + re.escape(opens + closes) + "]", text[start:], re.DOTALL):
        place = start + m.start()
        depth += (m.group() == opens) - (m.group() == closes)
        if not depth:
            return place
    return -1


def unfenced(text: str) -> str:
    m = _FENCED.match(text)
    return m.group(1) if m else text


def first_object(text: str) -> dict:
    start = text.find("{")
    if start < 0:
        raise Unreadable("no JSON object")
    if (found := _well_formed(text, start)) is not None:
        return found
    end = closing(text, start)
    if end < 0:
        raise Unreadable("no balanced JSON object")
    try:
        found = json.loads(text[start : end + 1])
    except ValueError as e:
        raise Unreadable("invalid JSON object") from e
    return found


def salvaged(text: str) -> list[dict]:
    """The whole objects at the head of a broken array, up to MOST_SALVAGED."""
    out: list[dict] = []
    at = text.find("[") + 1
    while at and len(out) < MOST_SALVAGED:
        start = text.find("{", at)
        if start < 0 or "]" in text[at:start]:
            break
        try:
            found, at = _DECODER.raw_decode(text, start)
        except ValueError:
            break
        out.append(found)
    return out


def object_list(text: str) -> list[dict]:
    """The objects of the first array, or the first object alone if it comes before."""
    text = unfenced(text)
    array, single = text.find("["), text.find("{")
    if array < 0 or 0 <= single < array:
        return [first_object(text)]
    found = _well_formed(text, array)
    if found is None:
        found = salvaged(text)
        if not found:
            raise Unreadable("no balanced JSON array" if closing(text, array) < 0 else "invalid JSON array")
    if not all(isinstance(x, dict) for x in found):
        raise Unreadable("JSON array element is not an object")
    return found


def _finite(x, instead=None):
    if isinstance(x, float) and not math.isfinite(x):
        return instead
    if isinstance(x, dict):
        return {k: _finite(v, instead) for k, v in x.items()}
    return [_finite(v, instead) for v in x] if isinstance(x, list) else x


def _written(x, instead=None) -> str:
    try:
        return _ENCODER.encode(x)
    except ValueError:  # a number that JSON cannot hold
        return json.dumps(_finite(x, instead), ensure_ascii=False)


def _parsed(text: str | None, read, instead=None) -> tuple[bool, str | None, list[str]]:
    if text is None:
        return False, "no text", []
    try:
        return True, None, [_written(x, instead) for x in read(text)]
    except (Unreadable, RecursionError) as e:
        return False, str(e) or "too deep", []


def _rows(texts: pa.Array, read, instead=None) -> pa.Array:
    ok, errors, elements = zip(*[_parsed(t, read, instead) for t in texts.to_pylist()], strict=True) if len(texts) else ((), (), ())
    columns = [pa.array(ok, pa.bool_()), pa.array(errors, pa.string()), pa.array(elements, pa.list_(pa.string()))]
    return pa.StructArray.from_arrays(columns, names=PARSED.names)


@F.arrow_udf(PARSED)
def _list_udf(texts: pa.Array) -> pa.Array:
    return _rows(texts, object_list)


@F.arrow_udf(PARSED)
def _object_udf(texts: pa.Array) -> pa.Array:
    return _rows(texts, lambda t: [first_object(t)], "NaN")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _salvage_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [_written(x) for x in salvaged(unfenced(t or ""))])


# Not deterministic for Spark: a filter on the result then never runs the scan a second time.
_list_once, _object_once = _list_udf.asNondeterministic(), _object_udf.asNondeterministic()


def parsed_list(c: Column) -> Column:
    """The objects of the first array, or the first object alone if it comes before."""
    return _list_once(c)


def parsed_object(c: Column) -> Column:
    """The first object; a number that is NaN or infinite becomes the string NaN."""
    return _object_once(c)


def salvaged_list(c: Column) -> Column:
    return _salvage_udf(c)
