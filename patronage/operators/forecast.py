"""Revenue forecasts per group.

F1 is pure aggregation: slope and intercept of y on the month index come
from ``regr_slope`` / ``regr_intercept`` per group, residual spread from a
second grouped pass; future months are a three-element ``sequence``.
F2 fits trend + yearly Fourier terms per group with ``applyInPandas`` -
each group is one monthly series (a few hundred points at most), so a
group never grows with the transaction count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.profile import monthly_by_group

FORECAST_DAYS = 90
PERIODS = FORECAST_DAYS // 30
Z = 1.96


def month_index(df: DataFrame, group_col: str) -> DataFrame:
    """0-based month number from the group's first month (the series is
    gap-free after zero filling, so this equals its position)."""
    first = df.groupBy(group_col).agg(F.min("ds").alias("__first"))
    return (df.join(first, group_col)
              .withColumn("t", F.months_between(F.trunc("ds", "month"), F.trunc("__first", "month")).cast("int"))
              .drop("__first"))


def linear_forecast(series: DataFrame, group_col: str = "Persona", periods: int = PERIODS) -> DataFrame:
    """F1: least squares on the index, +-1.96 population std of residuals,
    floored at 0, 2 digits; dates are the following month ends; a group
    needs at least 2 points."""
    s = month_index(series, group_col)
    fit = s.groupBy(group_col).agg(
        F.regr_slope("y", "t").alias("b"), F.regr_intercept("y", "t").alias("a"),
        F.count(F.lit(1)).alias("n"), F.max("ds").alias("last_ds"))
    fit = fit.filter(F.col("n") >= 2)
    resid = (s.join(fit, group_col)
              .groupBy(group_col).agg(F.stddev_pop(F.col("y") - (F.col("a") + F.col("b") * F.col("t")))
                                      .alias("sd")))
    fut = (fit.join(resid, group_col)
              .select(group_col, "a", "b", "n", "sd", "last_ds",
                      F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h")))
    pred = F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("h"))
    return fut.select(
        group_col,
        F.last_day(F.add_months(F.trunc("last_ds", "month"), F.col("h"))).alias("date"),
        F.round(F.greatest(pred, F.lit(0.0)), 2).alias("predicted_value"),
        F.round(F.greatest(pred - Z * F.col("sd"), F.lit(0.0)), 2).alias("lower_bound"),
        F.round(F.greatest(pred + Z * F.col("sd"), F.lit(0.0)), 2).alias("upper_bound"))


SEASONAL_MIN_POINTS = 24  # two whole years, without which season and trend cannot be told apart


def _seasonal_fit(periods: int, group_col: str, min_points: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds").reset_index(drop=True)
        n = len(pdf)
        t = np.arange(n, dtype=float)
        y = pdf["y"].to_numpy(dtype=float)
        last = pd.Timestamp(pdf["ds"].iloc[-1])
        dates = [(last + pd.offsets.MonthEnd(h)).date() for h in range(1, periods + 1)]
        tf = np.arange(n, n + periods, dtype=float)
        model = "seasonal" if n >= min_points else "linear"
        if model == "seasonal":
            # multiplicative yearly season: linear model on log1p(y)
            def design(tt):
                month = (pd.DatetimeIndex(pdf["ds"]).month.to_numpy()[0] - 1 + tt) % 12
                cols = [np.ones_like(tt), tt]
                for k in (1, 2):
                    cols += [np.sin(2 * np.pi * k * month / 12), np.cos(2 * np.pi * k * month / 12)]
                return np.column_stack(cols)
            ly = np.log1p(np.clip(y, 0, None))
            coef, *_ = np.linalg.lstsq(design(t), ly, rcond=None)
            sd = np.std(ly - design(t) @ coef)
            mid = design(tf) @ coef
            pred, lo, hi = np.expm1(mid), np.expm1(mid - Z * sd), np.expm1(mid + Z * sd)
        elif n >= 2:
            b, a = np.polyfit(t, y, 1)
            sd = np.std(y - (a + b * t))
            pred = a + b * tf
            lo, hi = pred - Z * sd, pred + Z * sd
        else:
            return pd.DataFrame(columns=[group_col, "date", "predicted_value", "lower_bound", "upper_bound", "model"])
        clip = lambda v: np.round(np.maximum(v, 0.0), 2)
        return pd.DataFrame({group_col: pdf[group_col].iloc[0], "date": dates,
                             "predicted_value": clip(pred), "lower_bound": clip(lo), "upper_bound": clip(hi),
                             "model": model})
    return fit


def seasonal_forecast(series: DataFrame, group_col: str = "Persona", periods: int = PERIODS,
                      min_points: int = SEASONAL_MIN_POINTS) -> DataFrame:
    """trend + yearly multiplicative seasonality per group. A series of fewer than
    ``min_points`` months gets the linear trend (one of a single month none); ``model`` says which it was."""
    schema = f"`{group_col}` string, date date, predicted_value double, lower_bound double, upper_bound double, model string"
    return (series.select(F.col(group_col).cast("string").alias(group_col), "ds", "y")
                  .groupBy(group_col).applyInPandas(_seasonal_fit(periods, group_col, min_points), schema))


def forecast_all(tx_with_group: DataFrame, group_col: str = "Persona", periods: int = PERIODS,
                 seasonal: bool = False) -> DataFrame:
    """one forecast per group from transactions carrying a group column."""
    series = monthly_by_group(tx_with_group, group_col)
    return (seasonal_forecast if seasonal else linear_forecast)(series, group_col, periods)


def slug(c) -> F.Column:
    """S9 key: lower-case, spaces to underscores."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), " ", "_")


def save_forecast(fc: DataFrame, path: str, group_col: str = "Persona", metric: str = "monetary") -> None:
    """Keyed store by metric and group slug; rewriting one metric keeps
    the others (dynamic partition overwrite)."""
    (fc.withColumn("metric", F.lit(metric)).withColumn("slug", slug(group_col))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("metric", "slug").parquet(path))


def get_forecast(spark, path: str, persona: str, metric: str = "monetary") -> DataFrame:
    key = persona.lower().replace(" ", "_")
    df = spark.read.parquet(path)
    return df.filter((F.col("metric") == metric) & (F.col("slug") == key)).drop("metric", "slug")
