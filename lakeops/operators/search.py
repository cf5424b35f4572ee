"""``search_catalog``: one pushed-down filter built from a list of condition forms.

The reference fetches whole listings and filters them in memory, one helper per case. Here
each case is a condition form returning a built-in ``Column``; ``search_catalog`` ANDs them
into a single ``where`` so Catalyst can push what it can into the scan.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.text import contains_text
from lakeops.functions.text import equals_ci as _equals_ci


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- condition forms

def filter_equals(c: str | Column, value) -> Column:
    """Exact equality on one column."""
    return _c(c) == F.lit(value)


def filter_equals_ci(c: str | Column, value: str) -> Column:
    """Equality after lower-casing both sides; null never matches."""
    return _equals_ci(c, value)


def filter_contains(c: str | Column, term: str, case_sensitive: bool = False) -> Column:
    """Literal substring (``%``/``_`` are plain characters); empty term matches all."""
    return contains_text(c, term, case_sensitive)


def filter_struct_field(field_path: str, value) -> Column:
    """Equality on a nested optional field such as ``recipient.userPrincipalName``; a
    missing field gives false. Parquet pushes nested-field filters down to the scan."""
    c = F.col(field_path)
    return c.isNotNull() & (c == F.lit(value))


# Tagged-union arms the reference can select by kind (only three of eight).
UNION_KIND_FIELDS = {"OneLake": "oneLake", "AdlsGen2": "adlsGen2", "S3": "amazonS3"}


def filter_union_kind(union_col: str, kind: str) -> Column:
    """Rows whose tagged-union arm for ``kind`` is present."""
    if kind not in UNION_KIND_FIELDS:
        raise ValueError(f"kind must be one of {sorted(UNION_KIND_FIELDS)}")
    return F.col(f"{union_col}.{UNION_KIND_FIELDS[kind]}").isNotNull()


def filter_array_any(c: str | Column, value: str, how: str = "equals") -> Column:
    """Any array element equals ``value`` (``how="equals"``) or contains it (``"contains"``,
    case-sensitive). A null array never matches."""
    arr = _c(c)
    if how == "equals":
        # array_contains compiles; it is null when the array holds a null and no match
        return arr.isNotNull() & F.coalesce(F.array_contains(arr, F.lit(value)), F.lit(False))
    if how == "contains":
        return arr.isNotNull() & F.exists(arr, lambda x: x.isNotNull() & F.contains(x, F.lit(value)))
    raise ValueError("how must be 'equals' or 'contains'")


def filter_flag(c: str | Column, negate: bool = False) -> Column:
    """A boolean column, or its negation; a missing flag is a flag that is not set."""
    v = _c(c)
    return (v.isNull() | ~v) if negate else (v.isNotNull() & v)


def filter_expired(c: str | Column, as_of) -> Column:
    """Parsed timestamp strictly before ``as_of``; null or unparsable is never expired.

    ``as_of`` is a parameter (timestamp, ISO string or Column) so results are repeatable.
    """
    limit = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    ts = _c(c).try_cast("timestamp")
    return ts.isNotNull() & (ts < limit)


def filter_roles_in(c: str | Column, roles: Sequence[str] | None) -> Column:
    """Role is one of ``roles``; an empty or missing list means no filter."""
    if not roles:
        return F.lit(True)
    col = _c(c)
    return col.isNotNull() & col.isin(list(roles))


# ---------------------------------------------------------------- operators

def search_catalog(df: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    """Keep rows meeting every condition; no conditions keeps everything."""
    conds = list(conditions)
    if not conds:
        return df
    return df.where(functools.reduce(operator.and_, conds))


def delete_by_pattern(df: DataFrame, name_col: str, pattern: str) -> DataFrame:
    """Remove rows whose name contains ``pattern`` case-insensitively; null names stay."""
    return df.where(~contains_text(name_col, pattern))


def first_match(df: DataFrame, key: str | Column, order_col: str,
                key_name: str = "key") -> DataFrame:
    """The first row (smallest ``order_col``) for each key value.

    One row per key: ``key_name`` plus every input column. Computed as a ``min`` over
    ``(order, row)``, so equal orders are broken by row content and a hot key is reduced
    map-side before the shuffle. Rows without an order come after all others.
    """
    k = _c(key)
    cols = df.columns
    best = (df.select(k.alias(key_name),
                    F.struct(F.col(order_col).isNull().alias("_none"), F.col(order_col).alias("_ord"), F.struct(*cols).alias("_row")).alias("_w"))
            .groupBy(key_name).agg(F.min("_w")["_row"].alias("_row")))
    return best.select(key_name, *[F.col("_row")[c].alias(c) for c in cols])


def find_first(df: DataFrame, requested: DataFrame, key: str | Column, order_col: str,
               req_col: str = "name", key_name: str = "key") -> DataFrame:
    """For each requested value, the first matching row, or nulls when nothing matches."""
    firsts = first_match(df, key, order_col, key_name)
    req = requested.select(F.col(req_col).alias(key_name)).distinct()
    return req.join(firsts, key_name, "left")


def limit_rows(df: DataFrame, n: int | None, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in ``order_by`` order; ``0`` or ``None`` means no limit.

    An order is required so the result is fixed. Plans as a per-partition top-n followed
    by one merge of at most ``n`` rows per partition.
    """
    if not order_by:
        raise ValueError("limit_rows needs an order so the result is repeatable")
    if not n:
        return df
    return df.orderBy(*order_by).limit(int(n))
