"""Cleaning, projection and filter operators.

All filters are deterministic column predicates, so Catalyst pushes them
below the whole-row distinct and into the Parquet scan where the source
columns allow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.scalars import stats_row
from patronage.session import stored

OUTLIER_COLUMNS = ["UnitPrice", "Quantity", "DiscountPct"]
WHITESPACE_EDGES = r"^\s+|\s+$"


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row distinct."""
    return df.dropDuplicates()


def drop_cancelled(df: DataFrame, id_col: str = "InvoiceID") -> DataFrame:
    """Drop invoices whose id starts with ``C``; a null id is kept."""
    return df.filter(~F.coalesce(F.col(id_col).startswith("C"), F.lit(False)))


def drop_blank_customers(df: DataFrame, cust_col: str = "CustomerID") -> DataFrame:
    """Drop null customers, strip surrounding whitespace, drop empty ids."""
    stripped = F.regexp_replace(F.col(cust_col), WHITESPACE_EDGES, "")
    return (df.filter(F.col(cust_col).isNotNull())
              .withColumn(cust_col, stripped)
              .filter(F.col(cust_col) != ""))


def positive_quantity(df: DataFrame, qty_col: str = "Quantity") -> DataFrame:
    """C4: keep Quantity > 0 (null dropped)."""
    return df.filter(F.col(qty_col) > 0)


def clean_data(df: DataFrame) -> DataFrame:
    """C1 -> C4 in this order."""
    return positive_quantity(drop_blank_customers(drop_cancelled(drop_duplicates(df))))


def iqr_bounds(df: DataFrame, c: str, k: float = 1.5, exact: bool = True, accuracy: int = 100_000, held: bool = False):
    """(lo, hi) fence literals for ``c`` from interpolated quartiles (pandas
    ``quantile``, DuckDB ``quantile_cont``): exact by ranked value counts, so no
    task holds the value set, or ``percentile_approx`` with ``exact=False``."""
    x = F.col(c).cast("double")
    if exact:
        from patronage.operators.ordered import column_quantiles
        q1, q3 = column_quantiles(df, [c], [0.25, 0.75], held)[c]
        if q1 is None:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        return F.lit(q1 - k * (q3 - q1)), F.lit(q3 + k * (q3 - q1))
    q = F.percentile_approx(x, [0.25, 0.75], accuracy).cast("array<double>")
    b = stats_row(df.agg((q[0] - k * (q[1] - q[0])).alias("lo"), (q[1] + k * (q[1] - q[0])).alias("hi")))
    return F.lit(b["lo"]), F.lit(b["hi"])


def handle_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 1.5,
                    exact: bool = True) -> DataFrame:
    """Per column, in sequence, keep rows inside the inclusive Tukey
    fences; each column's quartiles are taken over the rows the previous
    columns kept. Nulls fall out (comparisons with null are not true).
    Only these columns are written for the quartiles; rows of ``df`` meet the
    fences once, as literals."""
    cols = cols or OUTLIER_COLUMNS
    left, out = stored(df.select(*cols)), df
    for c in cols:
        lo, hi = iqr_bounds(left, c, k, exact, held=True)
        fence = (F.col(c) >= lo) & (F.col(c) <= hi)
        left, out = left.filter(fence), out.filter(fence)
    return out


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null numerics -> 0."""
    num = cols or numeric_columns(df)
    return df.na.fill(0, subset=num).na.fill(0.0, subset=num)


def persona_subset(df: DataFrame, persona: str, col: str = "Persona") -> DataFrame:
    """Rows of one persona."""
    return df.filter(F.col(col) == persona)


def highlight(df: DataFrame, persona: str, col: str = "Persona") -> DataFrame:
    """Flag rows of the chosen persona."""
    return df.withColumn("highlight", F.when(F.col(col) == persona, True).otherwise(False))


NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
ID_COLUMNS = ("CustomerID", "Cluster", "Persona", "PC1", "PC2")


def numeric_columns(df: DataFrame, exclude=ID_COLUMNS) -> list[str]:
    """Numeric columns except id / label columns, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]
