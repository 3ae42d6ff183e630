"""Scalar rules: statuses, ratios, text clean-up, messages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import display_name, stripped


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside lambdas Spark computes equal parts again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def coerced_status(c: Column) -> Column:
    """'absent' where it is written so, in any case; everything else is present."""
    return F.when(F.lower(stripped(c)) == "absent", "absent").otherwise("present")


def coerced_confidence(c: Column) -> Column:
    """A number in [0, 1], else null."""
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0), v)


def labeler_status(c: Column) -> Column:
    """1 is present, 0 absent; uncertain, blank and unreadable codes give null."""
    code = c.try_cast("int")
    return F.when(code == 1, "present").when(code == 0, "absent")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 (an undefined ratio, which averages skip)."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """Null if either is undefined, 0 if both are 0."""
    return F.when(precision.isNull() | recall.isNull(), F.lit(None).cast("double")).when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def without_reasoning(c: Column) -> Column:
    """Without complete <think> sections."""
    return stripped(F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, r"(?is)<think>.*?</think>", "")).otherwise(c))


def without_fence(c: Column) -> Column:
    """The inside of a text that is one fenced block as a whole."""
    pattern = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1)).otherwise(c)


def formatted_metric(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string("%.3f", c))


def formatted_size(c: Column) -> Column:
    """Bytes in the largest 1024-based unit that keeps the number at 1 or more."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string(f"%.1f {units[-1]}", c / F.lit(float(1024 ** (len(units) - 1))))
    for i in reversed(range(len(units) - 1)):
        out = F.when(c < 1024 ** (i + 1), F.format_string(f"%.1f {units[i]}", c / F.lit(float(1024**i)))).otherwise(out)
    return out


def valid_image_id(c: Column) -> Column:
    """32 hex digits, in either case."""
    return F.regexp_like(c, F.lit("^[0-9a-fA-F]{32}$"))


def html_escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def inline_html(c: Column) -> Column:
    """Escaped text whose **bold** and `code` spans are elements."""
    bold = F.regexp_replace(html_escaped(c), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(bold, "`([^`]+)`", "<code>$1</code>")


def light_ink(red: Column, green: Column, blue: Column) -> Column:
    """Whether dark text stands out on a colour: luminance over 140."""
    return 0.299 * red + 0.587 * green + 0.114 * blue > 140


def combined_label(names: Column, urgent: Column) -> Column:
    """Display names joined by ' / ', marked if urgent."""
    return F.concat(F.array_join(F.transform(names, display_name), " / "), F.when(urgent, " (URGENT)").otherwise(""))


@F.pandas_udf(T.StringType())
def thumbnail_hash(images: pd.Series) -> pd.Series:
    """SHA-1 of a 64 x 64 grey thumbnail of encoded images; null where one cannot be read."""
    import io

    from PIL import Image

    def one(raw: bytes | None) -> str | None:
        try:
            small = Image.open(io.BytesIO(raw)).convert("L").resize((64, 64), Image.BILINEAR)
        except (OSError, TypeError):
            return None
        return hashlib.sha1(small.tobytes()).hexdigest()

    return images.map(one)


def content_hash(text: Column) -> Column:
    """The hash of a text's words, for tables without pixels."""
    return F.sha1(F.lower(stripped(F.regexp_replace(text, r"(?U)\s+", " "))))


# Titles and texts of platform errors, and the messages they become.
QUOTA_TITLES = ("ZeroGPU quota exceeded", "ZeroGPU illegal duration", "ZeroGPU pending credits exceeded", "ZeroGPU queue timeout", "ZeroGPU client error")
WORKER_TITLE, ABORTED, PARSE_CLASS = "ZeroGPU worker error", "GPU task aborted", "SchemaParseError"
QUOTA_MESSAGE = "**GPU quota reached.** Free ZeroGPU time is temporarily exhausted, so this audit could not get a GPU slot - the image is not the problem. Wait a few minutes and press Run audit again."
INTERRUPTED_MESSAGE = "**GPU task was interrupted.** The platform cut the GPU run short before the audit finished. Please press Run audit again."
PARSE_MESSAGE = ("**Could not analyze this image.** The model returned output that could not be parsed (", "). Please try again, or use a clearer frontal chest X-ray.")
GENERIC_MESSAGE = ("**Audit failed.** An unexpected error occurred (", "). Please try again; if this keeps happening, check the Space logs.")


def error_category(class_name: Column, title: Column, body: Column) -> Column:
    """parse, quota, interrupted or other, of a logged error."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    platform = class_name == "Error"
    quota = title.isin(*QUOTA_TITLES) | F.contains(F.lower(title), F.lit("quota")) | F.contains(F.lower(body), F.lit("quota"))
    parse = (title == WORKER_TITLE) & (body == PARSE_CLASS)
    return F.when(class_name == PARSE_CLASS, "parse").when(platform & quota, "quota").when(platform & F.contains(body, F.lit(ABORTED)), "interrupted").when(platform & parse, "parse").otherwise("other")


def error_message(class_name: Column, title: Column, body: Column) -> Column:
    """The user-facing message of a logged error."""
    kind = error_category(class_name, title, body)
    own = F.when((class_name == "Error") & (title == WORKER_TITLE) & (F.coalesce(body, F.lit("")) != ""), body).otherwise(class_name)
    put = lambda m, name: F.concat(F.lit(m[0]), name, F.lit(m[1]))
    return F.when(kind == "quota", QUOTA_MESSAGE).when(kind == "interrupted", INTERRUPTED_MESSAGE).when(kind == "parse", put(PARSE_MESSAGE, own)).otherwise(put(GENERIC_MESSAGE, own))
