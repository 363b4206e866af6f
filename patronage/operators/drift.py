"""Feature drift between a baseline and a new feature table.

Both tables are unpivoted to (feature, value) and counted by value in the map
tasks; that one written table feeds ranges, the bins of both divergences and the
two-sample KS statistic, whose exact running totals come from ``ordered``, so no
window runs over a whole feature in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.clean import numeric_columns
from patronage.operators.ordered import running_totals
from patronage.session import path_exists, stored
from patronage.sources.sinks import write_table

# Decision thresholds.
PSI_THRESHOLD = 0.25
KS_THRESHOLD = 0.05
KL_THRESHOLD = 0.1
PSI_BUCKETS = 10
KL_BUCKETS = 20
MIN_VALUES = 5
MIN_SPREAD = 1e-10

BASELINE_EXCLUDE = ("CustomerID", "Cluster", "Persona", "PC1", "PC2")


def _long(df: DataFrame, cols: list[str], side: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
              .filter(F.col("value").isNotNull() & ~F.isnan("value"))
              .withColumn("side", F.lit(side)))


def drift_features(baseline: DataFrame, new: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Numeric baseline columns that also exist in the new table."""
    base_cols = cols or numeric_columns(baseline, BASELINE_EXCLUDE)
    have = set(new.columns)
    return [c for c in base_cols if c in have]


def value_counts(baseline: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, m_e, m_a): how often each value stands on either side,
    combined in the map tasks. All statistics come from this table."""
    both = _long(baseline, cols, "e").unionByName(_long(new, cols, "a"))
    return both.groupBy("feature", "value").agg(
        F.count(F.when(F.col("side") == "e", 1)).alias("m_e"), F.count(F.when(F.col("side") == "a", 1)).alias("m_a"))


def feature_ranges(counts: DataFrame) -> DataFrame:
    """Joint range and row counts of each feature with enough values on both
    sides. One row a feature (bounded by the schema), so it may pass through the driver."""
    rows = counts.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("m_e").alias("n_e"), F.sum("m_a").alias("n_a")
    ).filter((F.col("n_e") >= MIN_VALUES) & (F.col("n_a") >= MIN_VALUES)).collect()
    return counts.sparkSession.createDataFrame(
        [tuple(r) for r in rows], "feature string, lo double, hi double, n_e long, n_a long")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def binned_divergences(counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """R1 + R2 in one pass: (feature, psi, kl_divergence) of features with a
    spread. Values are counted in the 20 bins of KL; two of them make a bin of PSI."""
    idx = F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(KL_BUCKETS) / (F.col("hi") - F.col("lo"))),
                  F.lit(KL_BUCKETS - 1)).cast("int")
    spread = ranges.filter(F.col("hi") - F.col("lo") >= MIN_SPREAD)
    bins = (counts.join(F.broadcast(spread), "feature")
                  .groupBy("feature", "lo", "hi", "n_e", "n_a", idx.alias("bin"))
                  .agg(F.sum("m_e").alias("c_e"), F.sum("m_a").alias("c_a")))
    cells = bins.groupBy("feature", "lo", "hi", "n_e", "n_a").agg(  # at most KL_BUCKETS entries
        F.map_from_entries(F.collect_list(F.struct("bin", "c_e"))).alias("in_e"),
        F.map_from_entries(F.collect_list(F.struct("bin", "c_a"))).alias("in_a"))

    def filled(c):
        return F.transform(F.sequence(F.lit(0), F.lit(KL_BUCKETS - 1)), lambda i: F.coalesce(F.col(c)[i], F.lit(0)))

    def coarse(c, n):
        step = KL_BUCKETS // PSI_BUCKETS
        return F.transform(F.sequence(F.lit(0), F.lit(PSI_BUCKETS - 1)), lambda i: F.least(F.greatest(F.aggregate(
            F.slice(F.col(c), i * step + 1, step), F.lit(0).cast("long"), lambda acc, x: acc + x) / F.col(n), F.lit(1e-10)), F.lit(1.0)))

    width = (F.col("hi") - F.col("lo")) / F.lit(KL_BUCKETS)
    cells = cells.select("feature", "n_e", "n_a", width.alias("width"), filled("in_e").alias("e"), filled("in_a").alias("a"))
    cells = cells.select("feature", coarse("e", "n_e").alias("pe"), coarse("a", "n_a").alias("pa"),
                         F.transform("e", lambda x: x / (F.col("n_e") * F.col("width")) + F.lit(1e-10)).alias("de"),
                         F.transform("a", lambda x: x / (F.col("n_a") * F.col("width")) + F.lit(1e-10)).alias("da"))
    cells = cells.withColumns({"se": _total(F.col("de")), "sa": _total(F.col("da"))})
    psi = _total(F.zip_with("pe", "pa", lambda e, a: (a - e) * F.log(a / e)))
    kl = _total(F.zip_with("de", "da", lambda e, a: e / F.col("se") * F.log((e / F.col("se")) / (a / F.col("sa")))))
    return cells.select("feature", psi.alias("psi"), kl.alias("kl_divergence"))


def ks_table(counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Two-sample KS statistic D and asymptotic p-value."""
    cum = running_totals(counts.join(F.broadcast(ranges.select("feature")), "feature", "left_semi"), ["feature"], "value",
                         ["m_e", "m_a"])
    d = (cum.join(F.broadcast(ranges.select("feature", "n_e", "n_a")), "feature")
            .groupBy("feature", "n_e", "n_a")
            .agg(F.max(F.abs(F.col("cum_m_e") / F.col("n_e") - F.col("cum_m_a") / F.col("n_a")))
                 .alias("ks_statistic")))
    return d.select("feature", "ks_statistic",
                    ks_pvalue(F.col("ks_statistic"), F.col("n_e"), F.col("n_a")).alias("ks_pvalue"))


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 20) -> Column:
    """Asymptotic Kolmogorov tail with effective size n1*n2/(n1+n2) and the
    Stephens small-sample correction. Large arguments use the alternating
    series, small ones its theta dual, so both converge in a few terms."""
    a, b = n1.cast("double"), n2.cast("double")
    en = F.sqrt(a * b / (a + b))
    lam = (en + 0.12 + 0.11 / en) * d
    ks = F.sequence(F.lit(1), F.lit(terms))
    far = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    near = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(
        -F.pow(2.0 * k - 1.0, F.lit(2.0)) * (math.pi ** 2) / (8.0 * lam * lam)))
    p = (F.when(lam < 0.2, F.lit(1.0)).when(lam < 1.18, 1.0 - math.sqrt(2 * math.pi) / lam * near)
          .otherwise(2.0 * far))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def detect_drift(baseline: DataFrame, new: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per feature PSI, KL, KS with flags; features with fewer than 5
    values on a side are skipped; a constant joint range gives PSI = KL = 0."""
    feats = drift_features(baseline, new, cols)
    counts = stored(value_counts(baseline, new, feats))
    ranges = feature_ranges(counts)
    out = (ranges.select("feature").join(F.broadcast(binned_divergences(counts, ranges)), "feature", "left")
                 .join(F.broadcast(ks_table(counts, ranges)), "feature", "left")
                 .select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"),
                         F.coalesce("kl_divergence", F.lit(0.0)).alias("kl_divergence"),
                         "ks_statistic", "ks_pvalue"))
    out = out.withColumns({
        "psi_drift": F.col("psi") > PSI_THRESHOLD,
        "ks_drift": F.col("ks_pvalue") < KS_THRESHOLD,
        "kl_drift": F.col("kl_divergence") > KL_THRESHOLD,
    })
    out = out.withColumn("drift_detected", F.col("psi_drift") | F.col("ks_drift") | F.col("kl_drift"))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in
                                   ("psi", "kl_divergence", "ks_statistic", "ks_pvalue")],
                      "psi_drift", "ks_drift", "kl_drift", "drift_detected")


def drift_overall(per_feature: DataFrame) -> DataFrame:
    """Features checked, with drift, any drift, ratio (4 digits)."""
    n = F.count(F.lit(1))
    k = F.count(F.when(F.col("drift_detected"), 1))
    return per_feature.agg(n.alias("features_checked"), k.alias("features_with_drift"),
                           (k > 0).alias("drift_detected"),
                           F.round(k / F.greatest(n, F.lit(1)), 4).alias("drift_ratio"))


def baseline_snapshot(df: DataFrame, id_col: str = "CustomerID") -> DataFrame:
    """Id + numeric features (the fallback baseline drops label and
    projection columns and keeps numerics only)."""
    return df.select(id_col, *numeric_columns(df, BASELINE_EXCLUDE))


def load_baseline(spark, path: str, personas_path: str | None = None, id_col: str = "CustomerID") -> DataFrame | None:
    """The stored baseline; without one the snapshot of the stored persona
    table, which becomes the baseline; None if neither exists."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    if personas_path and path_exists(spark, personas_path):
        write_table(baseline_snapshot(spark.read.parquet(personas_path), id_col), path)
        return spark.read.parquet(path)
    return None
