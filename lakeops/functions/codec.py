"""Base64 and JSON payload expressions.

The reference uses ``btoa``/``atob`` (Latin-1 only); we encode UTF-8, so non-ASCII JSON
round-trips instead of failing. Spark's ``base64`` may wrap its output at 76 characters;
the line breaks are stripped so one payload is one unbroken string, as ``btoa`` gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def b64_encode(c: str | Column) -> Column:
    """UTF-8 text (or binary) to one-line base64 text."""
    return F.regexp_replace(F.base64(_c(c)), r"[\r\n]", "")


def try_b64_decode(c: str | Column) -> Column:
    """Base64 text to bytes; null instead of an error for malformed input."""
    return F.try_to_binary(_c(c), F.lit("base64"))


def b64_decode_text(c: str | Column) -> Column:
    """Base64 text to UTF-8 text; null for malformed base64 or invalid UTF-8."""
    return F.try_validate_utf8(try_b64_decode(c).cast("string"))
