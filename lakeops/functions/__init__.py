"""Column-level helpers shared by the operators.

Every helper returns a built-in ``Column`` expression, so it stays inside whole-stage
codegen; none of them evaluates Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeops.functions.text import (  # noqa: F401
    contains_text,
    equals_ci,
    first_segment,
    last_segment,
    path_after_first,
    segments,
    starts_with,
)
from lakeops.functions.codec import b64_encode, b64_decode_text, try_b64_decode  # noqa: F401


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
