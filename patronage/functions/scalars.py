"""One-row statistics as literals.

A struct-valued scalar subquery is planned once per field reference (no
subquery reuse across references), so statistics used in several
expressions are computed once, eagerly, and inlined as literals: a few
numbers per column cross to the driver, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats_row(agg: DataFrame) -> dict:
    """Run a one-row aggregation and return its values by column name."""
    row = agg.first()
    return row.asDict(recursive=True) if row is not None else {}


def lit(v) -> Column:
    return F.lit(v)
