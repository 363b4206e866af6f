"""Scalar column expressions (E1-E16). All are built-in Spark expressions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def net_revenue(qty="Quantity", price="UnitPrice", disc="DiscountPct") -> Column:
    """Quantity * UnitPrice * (1 - DiscountPct/100)."""
    return col_(qty) * col_(price) * (1 - col_(disc) / 100)


def is_weekend(ts="InvoiceDate") -> Column:
    """Saturday or Sunday; ``weekday`` numbers Monday as 0."""
    return F.weekday(col_(ts)).isin(5, 6).cast("int")


def is_night(ts="InvoiceDate") -> Column:
    """Hour before 6."""
    return (F.hour(col_(ts)) < 6).cast("int")


def month_start(ts="InvoiceDate") -> Column:
    """First day of the month."""
    return F.trunc(col_(ts), "month")


def month_end(ts="InvoiceDate") -> Column:
    """Last day of the month."""
    return F.last_day(col_(ts))


def day_of_week(ts="InvoiceDate") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(ts))


def hour_of_day(ts="InvoiceDate") -> Column:
    return F.hour(col_(ts))


def whole_days(later, earlier) -> Column:
    """E5: number of whole 24-hour units between two timestamps (floor),
    the ``.days`` of a time difference; not ``datediff``, which counts
    midnights."""
    diff = F.unix_micros(col_(later).cast("timestamp")) - F.unix_micros(col_(earlier).cast("timestamp"))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("long")


def revenue_column(df: DataFrame) -> Column:
    """Revenue resolution by available columns: Monetary, else the line
    value, else TotalAmount, else Revenue."""
    cols = set(df.columns)
    if "Monetary" in cols:
        return F.col("Monetary")
    if {"Quantity", "UnitPrice"} <= cols:
        disc = F.col("DiscountPct") / 100.0 if "DiscountPct" in cols else F.lit(0.0)
        return F.col("Quantity") * F.col("UnitPrice") * (1.0 - disc)
    if "TotalAmount" in cols:
        return F.col("TotalAmount")
    if "Revenue" in cols:
        return F.col("Revenue")
    raise ValueError("no revenue column: need Monetary, Quantity+UnitPrice, TotalAmount or Revenue")


def risk_band(p) -> Column:
    """Probability to Low / Medium / High."""
    p = col_(p)
    return F.when(p < 0.3, "Low").when(p < 0.6, "Medium").otherwise("High")


def feature_hash(cols: list[str]) -> Column:
    """First 16 hex digits of sha256 over the JSON of the sorted features."""
    ordered = sorted(cols)
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in ordered])), 256), 1, 16)


# Source substring -> label, checked in this order.
SOURCE_LABELS = [
    ("customer_personas", "Customer Persona Profiles"),
    ("customer_features_scaled", "Scaled Customer Features"),
    ("customer_features", "Customer Features Data"),
    ("drift_baseline", "Drift Baseline Analysis"),
    ("pipeline", "Pipeline Report"),
    ("readme", "Project Documentation"),
    ("predictions", "Predictions"),
]
CONFIG_SOURCE = ("config", "Persona Configuration")


def friendly_source(src="source") -> Column:
    """Ordered substring rules on the lower-cased source; the exact
    value ``config`` gets its own label; anything else is returned as is."""
    s = col_(src)
    low = F.lower(s)
    expr = None
    for needle, label in SOURCE_LABELS:
        cond = low.contains(needle)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(s == CONFIG_SOURCE[0], CONFIG_SOURCE[1]).otherwise(s)


def signed_contribution(x) -> tuple[Column, Column]:
    """(importance = round(|x|, 6), direction)."""
    x = col_(x)
    return F.round(F.abs(x), 6), F.when(x > 0, "positive").otherwise("negative")


def minmax_norm(c, lo, hi) -> Column:
    """(x - min) / (max - min + 1e-9)."""
    return (col_(c) - lo) / (hi - lo + F.lit(1e-9))


def clip(c, lower=None, upper=None) -> Column:
    """Bound a column from below and/or above."""
    out = col_(c)
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return out


def recency_date(recency="Recency", ref=None) -> Column:
    """Approximate last purchase date = reference date - Recency days."""
    ref = F.current_date() if ref is None else col_(ref)
    return F.date_sub(ref, col_(recency).cast("int"))


def _profile_lines(profile_map: Column, n: int | None) -> Column:
    entries = F.array_sort(F.map_entries(profile_map))
    if n is not None:
        entries = F.slice(entries, 1, n)
    return entries


def narrative_text(persona, description, recommendations, profile_map=None, entries: int | None = None) -> Column:
    """Rule-based narrative: heading, description, strategies and the
    profile entries in key order, one line each; ``entries`` limits them."""
    recs = F.coalesce(col_(recommendations), F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.concat(F.lit("## "), col_(persona)), F.lit(""), F.coalesce(col_(description), F.lit("")),
                F.lit(""), F.lit("**Recommended Strategies:**")),
        F.transform(recs, lambda r: F.concat(F.lit("- "), r)),
    )
    if profile_map is not None:
        prof = F.transform(_profile_lines(col_(profile_map), entries),
                           lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string")))
        with_prof = F.concat(lines, F.array(F.lit(""), F.lit("**Profile Highlights:**")), prof)
        lines = F.when(F.coalesce(F.size(col_(profile_map)), F.lit(0)) > 0, with_prof).otherwise(lines)
    return F.array_join(lines, "\n")


def prompt_text(persona, profile_map=None) -> Column:
    """Prompt for a narrative, profile entries sorted by key."""
    head = F.concat(F.lit("Persona: "), col_(persona))
    tail = F.concat_ws("\n", F.lit(""), F.lit("Generate a detailed marketing persona narrative (2-3 paragraphs)."))
    if profile_map is None:
        return F.concat_ws("\n", head, tail)
    lines = F.transform(_profile_lines(col_(profile_map), None),
                        lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"].cast("string")))
    body = F.when(F.size(col_(profile_map)) > 0,
                  F.concat_ws("\n", F.lit("Behavioral Profile:"), F.array_join(lines, "\n")))
    return F.concat_ws("\n", head, body, tail)
