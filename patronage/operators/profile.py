"""Profiles, summaries, windows and ordering.

Whole-table statistics are computed as one wide aggregation (partial
aggregates per task, one small final merge) and unpivoted afterwards;
nothing is unpivoted before aggregating. Group shares divide by a scalar
subquery total rather than a window over the whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import expr as E
from patronage.functions.scalars import stats_row


def cluster_profiles(df: DataFrame, cols: list[str], by: str = "Cluster") -> DataFrame:
    """A3: mean of each feature by cluster / persona."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A4: count per value, descending (nulls are not counted)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def overview(df: DataFrame, feature_cols: list[str], cluster_col="Cluster", persona_col="Persona") -> DataFrame:
    """A5: customers, features, clusters, personas."""
    return df.agg(F.count(F.lit(1)).alias("n_customers"),
                  F.lit(len(feature_cols)).cast("long").alias("n_features"),
                  F.count_distinct(cluster_col).alias("n_clusters"),
                  F.count_distinct(persona_col).alias("n_personas"))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column, long form (column, n_null)."""
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return unpivot_one_row(wide, df.columns, "column", "n_null")


def data_quality(tx: DataFrame) -> DataFrame:
    """Duplicates, distinct ids, bad quantities and cancelled invoices."""
    n_distinct_rows = tx.dropDuplicates().agg(F.count(F.lit(1))).scalar()
    return tx.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - n_distinct_rows).alias("n_duplicate_rows"),
        F.count_distinct("InvoiceID").alias("n_invoices"),
        F.count_distinct("CustomerID").alias("n_customers"),
        F.count_distinct("ProductID").alias("n_products"),
        F.count(F.when(F.col("Quantity") < 0, 1)).alias("n_negative_qty"),
        F.count(F.when(F.col("Quantity") == 0, 1)).alias("n_zero_qty"),
        F.count(F.when(F.col("CustomerID").isNull(), 1)).alias("n_null_customers"),
        F.count(F.when(F.col("InvoiceID").startswith("C"), 1)).alias("n_cancelled"),
    )


def unpivot_one_row(wide: DataFrame, cols: list[str], name_col: str, value_col: str) -> DataFrame:
    return wide.unpivot([], cols, name_col, value_col)


DESCRIBE_STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles (interpolated), max per
    numeric column; one aggregation pass, then one row per column."""
    from patronage.operators.ordered import column_quantiles
    qs = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        q = [F.lit(v).cast("double") for v in qs[c]]
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("q25"),
            q[1].alias("q50"), q[2].alias("q75"), F.max(x).alias("max")).alias(c))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")


def describe_strings(df: DataFrame, col: str) -> DataFrame:
    """A7 for a text column: count, unique, top (most frequent, smallest on
    ties) and its frequency. Counting per value is a shuffle by value, so
    no single task holds the value set."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(col).alias("v")))
    return counts.agg(
        F.lit(col).alias("column"), F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        best["v"].alias("top"), (-best["neg"]).alias("freq"))


def customer_totals(tx: DataFrame) -> DataFrame:
    """EDA totals per customer."""
    return tx.groupBy("CustomerID").agg(
        F.sum("UnitPrice").alias("TotalSales"), F.count_distinct("InvoiceID").alias("OrderCount"),
        F.avg("Quantity").alias("AvgQty"), F.avg("UnitPrice").alias("AvgPrice"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; the last bin is closed.
    A constant column uses [x - 0.5, x + 0.5]. Empty bins count 0."""
    x = F.col(col).cast("double")
    r = stats_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    if r["lo"] is None:  # no values: bins without edges, all empty
        return df.sparkSession.range(bins).select(
            F.col("id").cast("int").alias("bin"), F.lit(None).cast("double").alias("bin_start"),
            F.lit(None).cast("double").alias("bin_end"), F.lit(0).cast("long").alias("count"))
    lo_v, hi_v = (r["lo"], r["hi"]) if r["hi"] > r["lo"] else (r["lo"] - 0.5, r["hi"] + 0.5)
    lo, hi = F.lit(float(lo_v)), F.lit(float(hi_v))
    idx = F.least(F.floor((x - lo) * F.lit(bins) / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / F.lit(bins)
    return (grid.join(F.broadcast(counts), "bin", "left")
                .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width)
                        .alias("bin_end"),
                        F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def box_summary(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """A10: quartiles, whiskers (most extreme points inside the 1.5 IQR
    fences) and the number of points outside the fences."""
    x = F.col(col).cast("double")
    from patronage.operators.ordered import column_quantiles
    q = [F.lit(v) for v in column_quantiles(df, [col], [0.25, 0.5, 0.75])[col]]
    iqr = q[2] - q[0]
    lo_f, hi_f = q[0] - k * iqr, q[2] + k * iqr
    return df.agg(
        F.lit(col).alias("column"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        iqr.alias("iqr"), F.min(F.when(x >= lo_f, x)).alias("whisker_low"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.count(F.when((x < lo_f) | (x > hi_f), 1)).alias("n_outliers"))


def pearson_matrix(df: DataFrame, cols: list[str]):
    """d x d Pearson matrix (numpy) over the rows where both columns have a
    value. Columns are centred on their means; each task folds its rows into
    one masked Gram matrix, so d x d sums a task are all that is shuffled. A
    constant column has no correlation (NaN), itself included."""
    d = len(cols)
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    st = stats_row(x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]))
    mean = np.array([st[f"m{i}"] or 0.0 for i in range(d)])

    def fold(it):
        g = np.zeros((3 * d, 3 * d))
        for pdf in it:
            v = pdf.to_numpy(dtype=float) - mean
            ok = ~np.isnan(v)
            v = np.where(ok, v, 0.0)
            z = np.hstack([ok.astype(float), v, v * v])
            g += z.T @ z
        i, j = np.indices(g.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": g.ravel()})

    rows = x.mapInPandas(fold, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    g = np.zeros((3 * d, 3 * d))
    for r in rows:
        g[r["i"], r["j"]] = r["s"]
    n, sx, sxx, sxy = g[:d, :d], g[d:2 * d, :d], g[2 * d:, :d], g[d:2 * d, d:2 * d]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sx.T / n
        var = np.maximum(sxx - sx ** 2 / n, 0.0)  # [i, j]: column i over the rows that have j
        var = np.where(var <= 1e-12 * sxx, 0.0, var)
        return np.clip(cov / np.sqrt(var * var.T), -1.0, 1.0)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair, both orders and the diagonal,
    as (col1, col2, corr) rows."""
    m = pearson_matrix(df, cols)
    rows = [(a, b, None if m[i, j] != m[i, j] else 1.0 if i == j else float(m[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, corr double")


def orders_by_weekday(tx: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Line count per weekday (Monday = 0), zero for missing days."""
    counts = tx.groupBy(E.day_of_week(ts).alias("day_of_week")).agg(F.count(F.lit(1)).alias("n_orders"))
    days = tx.sparkSession.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    return (days.join(F.broadcast(counts), "day_of_week", "left")
                .select("day_of_week", F.coalesce("n_orders", F.lit(0)).alias("n_orders")))


def orders_by_hour(tx: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Line count per hour present."""
    return tx.groupBy(E.hour_of_day(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n_orders"))


def monthly_sales(tx: DataFrame) -> DataFrame:
    """By calendar month: sum of UnitPrice and distinct invoices."""
    return tx.groupBy(E.month_start().alias("month")).agg(
        F.sum("UnitPrice").alias("Sales"), F.count_distinct("InvoiceID").alias("Orders"))


def monthly_by_group(df: DataFrame, group_col: str = "Persona", ts: str = "InvoiceDate",
                     min_points: int = 4) -> DataFrame:
    """Revenue per group and month end; months between a group's first
    and last month get 0; only groups with at least ``min_points`` months
    (more than 3) are kept. Output (group, ds date, y double)."""
    rev = E.revenue_column(df)
    sums = (df.filter(F.col(group_col).isNotNull() & F.col(ts).isNotNull())
              .groupBy(F.col(group_col).alias(group_col), F.last_day(ts).alias("ds"))
              .agg(F.sum(rev).alias("y")))
    span = sums.groupBy(group_col).agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    months = span.select(group_col, F.explode(F.sequence(
        F.trunc("first", "month"), F.trunc("last", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    filled = (months.select(group_col, F.last_day("m").alias("ds"))
                    .join(sums, [group_col, "ds"], "left")
                    .select(group_col, "ds", F.coalesce("y", F.lit(0.0)).alias("y")))
    keep = (span.withColumn("n", F.months_between(F.trunc("last", "month"), F.trunc("first", "month")) + 1)
                .filter(F.col("n") >= min_points).select(group_col))
    return filled.join(keep, group_col, "left_semi")


def headline(tx: DataFrame) -> DataFrame:
    """EDA headline figures."""
    missing = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in tx.columns), F.lit(0))
    return tx.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("CustomerID").alias("n_customers"),
        F.min("InvoiceDate").alias("first_date"), F.max("InvoiceDate").alias("last_date"),
        missing.alias("n_missing"), F.count_distinct("ProductCategory").alias("n_categories"),
        F.count_distinct("PaymentMethod").alias("n_payment_methods"),
        (F.avg(F.col("Returned").cast("double")) * 100).alias("return_rate_pct"),
        F.avg("UnitPrice").alias("avg_unit_price"))


def label_share(df: DataFrame, label: str = "ChurnLabel") -> DataFrame:
    """Share of positive labels."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("positive_rate"),
                  F.count(F.lit(1)).alias("n"))


def forecast_summary(fc: DataFrame, group_col: str = "Persona") -> DataFrame:
    """Per group: total predicted value, first lower and last upper bound."""
    return fc.groupBy(group_col).agg(
        F.sum("predicted_value").alias("total_predicted"),
        F.min_by("lower_bound", "date").alias("first_lower"),
        F.max_by("upper_bound", "date").alias("last_upper"))


def top_n(df: DataFrame, key: str, value: str, n: int = 10, agg: str = "sum") -> DataFrame:
    """Top ``n`` keys by aggregated value (ties by key)."""
    a = getattr(F, agg)(value).alias(f"{agg}_{value}")
    g = df.groupBy(key).agg(a)
    return g.orderBy(F.desc(f"{agg}_{value}"), F.asc(key)).limit(n)


def ranked_within(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in the given order."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def tail_per_group(df: DataFrame, group_col: str, order_col: str, n: int = 3) -> DataFrame:
    """Last ``n`` rows per group."""
    return ranked_within(df, [group_col], [F.desc(order_col)], n)


def share_of_total(counts: DataFrame, count_col: str = "count", out: str = "share_pct") -> DataFrame:
    """Count / total * 100, total as a scalar subquery."""
    total = counts.agg(F.sum(count_col)).scalar()
    return counts.withColumn(out, F.col(count_col) * 100.0 / total)


def best_by(df: DataFrame, score_col: str, tie_col: str) -> DataFrame:
    """The row with the highest score; ties go to the smallest ``tie_col``
    (the earlier entry)."""
    return df.orderBy(F.desc(score_col), F.asc(tie_col)).limit(1)


def head(df: DataFrame, order_cols: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order_cols).limit(n)


def order_by_date(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """W10."""
    return df.orderBy(ts)
