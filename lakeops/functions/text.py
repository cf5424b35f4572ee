"""String and path expressions with the reference's JavaScript string semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_text(c: str | Column, term: str, case_sensitive: bool = False) -> Column:
    """``value.includes(term)``, lower-cased on both sides unless ``case_sensitive``.

    A literal substring test: ``%`` and ``_`` in ``term`` are ordinary characters. An empty
    term matches every non-null value. A null value gives false, never null, so negating the
    condition keeps null rows; written as ``IS NOT NULL AND ...`` so that the case-sensitive
    form reaches the Parquet scan as a pushed-down ``StringContains``.
    """
    col = _c(c)
    if case_sensitive:
        return col.isNotNull() & F.contains(col, F.lit(term))
    return col.isNotNull() & F.contains(F.lower(col), F.lower(F.lit(term)))


def equals_ci(c: str | Column, value: str | Column) -> Column:
    """Case-insensitive equality; null on either side gives false."""
    v = value if isinstance(value, Column) else F.lit(value)
    col = _c(c)
    return col.isNotNull() & v.isNotNull() & (F.lower(col) == F.lower(v))


def starts_with(c: str | Column, prefix: str | Column) -> Column:
    """Prefix test; null gives false. Pushed down to Parquet as ``StringStartsWith``."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    col = _c(c)
    return col.isNotNull() & p.isNotNull() & F.startswith(col, p)


def segments(c: str | Column) -> Column:
    """``path.split('/')``: keeps empty leading, inner and trailing segments."""
    return F.split(_c(c), "/", -1)


def last_segment(c: str | Column) -> Column:
    """Last element of ``split('/')``; empty when the path ends in ``/``."""
    return F.element_at(segments(c), -1)


def first_segment(c: str | Column) -> Column:
    return F.element_at(segments(c), 1)


def path_after_first(c: str | Column) -> Column:
    """``path.substring(parts[0].length + 1)``: everything after the first ``/``.

    A path without ``/`` yields the empty string, as in JavaScript.
    """
    return F.regexp_replace(_c(c), r"^[^/]*/?", "")
