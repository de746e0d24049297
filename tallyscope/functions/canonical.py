"""Canonical JSON: one text for equal records, whose digest names them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _canonical(text: str | None, plain: bool) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if plain:
        return json.dumps(value, ensure_ascii=True, sort_keys=True)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_json(text: Column, plain: bool = False) -> Column:
    """A JSON text with its keys sorted at every depth and numbers in their shortest form: without blanks and with other
    scripts as they are, or, `plain`, with a blank after each separator and all beyond ASCII escaped. Null for what is no
    JSON. The order of keys and the form of numbers are those of Python's json, which to_json can't give; in Arrow
    batches."""

    @F.pandas_udf("string")
    def batches(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in values:
            yield own.map(lambda t: _canonical(t, plain), na_action="ignore")

    return batches(text)


def record_digest(text: Column, plain: bool = False) -> Column:
    """The SHA-256 of a record's canonical JSON."""
    return F.sha2(canonical_json(text, plain).cast("binary"), 256)
