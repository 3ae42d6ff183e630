"""Prompt columns for models that ground an image or read a draft.

The default wording is this engine's own; a pinned wording goes in as ``template``, with
{labels} and {none} where the vocabulary stands, and {draft} in a draft's template.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import CANONICAL, NO_FINDING, stripped

GROUNDING = """List the findings that this chest X-ray shows, for research only. Use these labels alone: {labels}.
Answer with a JSON list of objects: "label", "box_2d" ([y0, x0, y1, x1] from 0 to 1, or null), "confidence" (0 to 1) and "evidence".
Without any finding, answer with one object whose label is "{none}"."""
DRAFT = """List what this draft says about findings, for research only. Use these labels alone: {labels}.
Answer with a JSON list of objects: "label", "status" ("present" or "absent") and "span" (the words of the draft). Leave out what is not mentioned.
A draft of a normal study gives one object whose label is "{none}".

Draft:
{draft}"""
AGAIN = "\n\nAnswer with the JSON list alone."


def _filled(template: str) -> str:
    return template.replace("{labels}", ", ".join(CANONICAL)).replace("{none}", NO_FINDING)


def grounding_prompt(template: str = GROUNDING) -> Column:
    return F.lit(_filled(template))


def draft_prompt(draft: Column, template: str = DRAFT) -> Column:
    """The prompt of a draft; an empty draft is an error."""
    text = stripped(draft)
    checked = F.when(text != "", text).otherwise(F.raise_error(F.lit("the draft must not be empty")).cast("string"))
    parts = [F.lit(part) for part in _filled(template).split("{draft}")]
    return F.concat(parts[0], *[c for part in parts[1:] for c in (checked, part)])


def attempt_prompt(prompt: Column, attempt: Column, suffix: str = AGAIN) -> Column:
    """The prompt of an attempt: from the second on it asks again for the list alone."""
    return F.when(attempt > 1, F.concat(prompt, F.lit(suffix))).otherwise(prompt)
