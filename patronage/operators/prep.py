"""Feature scaling, selection and reduction (M1-M8).

Statistics come from one aggregation each (partial per task); only a few
numbers per column reach the driver. PCA uses Spark ML, whose covariance
is a tree aggregation of d x d partial sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.scalars import stats_row

# Selection settings and the kept feature names.
CORRELATION_THRESHOLD = 0.85
VARIANCE_THRESHOLD = 0.01
PCA_VARIANCE_TARGET = 0.95
KEEP_COLS = ["Recency", "Frequency", "Monetary", "AvgBasketSize", "PurchaseInterval", "WeekendRatio",
             "NightRatio", "DiscountUsage", "ReturnRate", "ProductDiversity"]
ALWAYS_KEEP = ("Recency", "Frequency", "Monetary")
TIE_REL = 1e-9


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1: (x - mean) / population std; a constant column becomes 0."""
    st = stats_row(df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                           *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]))
    out = {}
    for i, c in enumerate(cols):
        m, s = F.lit(st[f"m{i}"]).cast("double"), st[f"s{i}"]
        out[c] = (F.col(c) - m) / F.lit(s) if s else F.col(c) - m
    return df.withColumns(out)


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """M2: (x - median) / IQR (IQR 0 -> divide by 1)."""
    from patronage.operators.ordered import column_quantiles
    st = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        q1, med, q3 = st[c]
        if med is None:  # no values: stays null
            continue
        iqr = (q3 - q1) or 1.0
        out[c] = (F.col(c) - F.lit(med)) / F.lit(iqr)
    return df.withColumns(out)


def correlation_drop(df: DataFrame, cols: list[str], threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """M3: for each pair (row before col in ``cols``) with |r| > threshold,
    drop the column with the smaller sample variance; on a tie (relative
    1e-9) the earlier column (``row``) is dropped. Returns (feature).
    The d x d correlations and d variances are aggregated on the cluster;
    the pair rule runs on those numbers."""
    from patronage.operators.profile import pearson_matrix
    r = pearson_matrix(df, cols)
    v = stats_row(df.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]))
    var = [v[f"v{i}"] for i in range(len(cols))]
    drop = set()
    for j, b in enumerate(cols):
        for i in range(j):
            a = cols[i]
            if abs(r[i, j]) > threshold:
                va, vb = var[i], var[j]
                tie = abs(va - vb) <= TIE_REL * max(abs(va), abs(vb))
                drop.add(b if (not tie and vb < va) else a)
    return df.sparkSession.createDataFrame([(c,) for c in cols if c in drop], "feature string")


def variance_select(df: DataFrame, cols: list[str], threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """M4: population variance per column and whether it is kept (> threshold)."""
    wide = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    return (wide.unpivot([], cols, "feature", "variance")
                .withColumn("kept", F.col("variance") > threshold))


def final_features_df(drop_df: DataFrame, present: list[str], keep=KEEP_COLS) -> DataFrame:
    """M5: the wanted features that were not dropped; recency, frequency and
    monetary value always stay."""
    spark = drop_df.sparkSession
    cand = spark.createDataFrame([(c,) for c in keep if c in present], "feature string")
    kept = cand.join(drop_df, "feature", "left_anti").unionByName(
        cand.filter(F.col("feature").isin(*ALWAYS_KEEP))).distinct()
    return kept


def fit_pca(df: DataFrame, cols: list[str], target=PCA_VARIANCE_TARGET, k: int | None = None,
            out="pca"):
    """M6: centred PCA keeping the fewest components whose cumulative
    explained-variance ratio exceeds ``target`` (or exactly ``k``).
    Returns (PipelineModel, ratios list, n_components, sign vector)."""
    d = len(cols)
    assembler = VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="keep")
    center = StandardScaler(inputCol="__x", outputCol="__xc", withMean=True, withStd=False)
    full = Pipeline(stages=[assembler, center, PCA(k=d, inputCol="__xc", outputCol=out)]).fit(df)
    ratios = full.stages[-1].explainedVariance.toArray()
    if k is None:
        k = int(np.searchsorted(np.cumsum(ratios), target, side="right") + 1)
        k = min(k, d)
    pcs = full.stages[-1].pc.toArray()[:, :k]
    # fix signs: the largest-magnitude loading of each component is positive
    signs = np.sign(pcs[np.argmax(np.abs(pcs), axis=0), np.arange(k)])
    signs[signs == 0] = 1.0
    model = Pipeline(stages=[assembler, center, PCA(k=k, inputCol="__xc", outputCol=out)]).fit(df)
    return model, list(map(float, ratios)), k, [float(s) for s in signs]


def pca_project(model, df: DataFrame, k: int, signs: list[float], prefix="PC", out="pca") -> DataFrame:
    """M6 / M7: PC1..PCk columns (sign-fixed) appended to ``df``."""
    t = model.transform(df).withColumn("__arr", vector_to_array(out))
    return t.select(*df.columns, *[(F.col("__arr")[i] * signs[i]).alias(f"{prefix}{i + 1}") for i in range(k)])


def projection_2d(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """M7: 2-D (or 3-D) display projection."""
    model, _, k, signs = fit_pca(df, cols, k=k)
    return pca_project(model, df, k, signs)


def scree_table(spark, ratios: list[float]) -> DataFrame:
    """M8 + W5: ratio per component, running total, and the first component
    index reaching 95%."""
    rows = [(i + 1, float(r)) for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "component int, ratio double")
    from pyspark.sql import Window
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cumulative", F.sum("ratio").over(w))
