"""Inputs that once gave wrong answers or no answer."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from patronage.operators import churn as L
from patronage.operators import cluster as K
from patronage.operators import drift as D
from patronage.operators import evaluate as V
from patronage.operators import features as FT
from patronage.operators import prep as M
from patronage.operators import profile as P
from patronage.operators.ordered import column_quantiles
from patronage.sources.tables import TRANSACTION_SCHEMA


def test_customer_without_invoice_numbers(spark, raw_df):
    df = raw_df.withColumn("InvoiceID", F.when(F.col("CustomerID") == "C10", None).otherwise(F.col("InvoiceID")))
    r = FT.build_customer_features(df).filter("CustomerID = 'C10'").first()
    assert r["Frequency"] == 0 and r["AvgBasketSize"] is None and r["ReturnRate"] is None


def test_ks_of_near_identical_columns_is_one(spark):
    p = spark.range(1).select(D.ks_pvalue(F.lit(1e-6), F.lit(1_000_000), F.lit(1_000_000)).alias("a"),
                              D.ks_pvalue(F.lit(0.0), F.lit(50), F.lit(50)).alias("b"),
                              D.ks_pvalue(F.lit(0.5), F.lit(10**10), F.lit(10**10)).alias("c")).first()
    assert p["a"] == 1.0 and p["b"] == 1.0 and p["c"] == 0.0
    lam = np.linspace(0.3, 2.0, 18)
    en = np.sqrt(500.0)
    rows = spark.createDataFrame([(float(x / (en + 0.12 + 0.11 / en)), float(x)) for x in lam], "d double, l double")
    for r in rows.select("l", D.ks_pvalue(F.col("d"), F.lit(1000), F.lit(1000)).alias("p")).collect():
        k = np.arange(1, 2000)
        assert abs(r["p"] - 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * r["l"] ** 2))) < 1e-9


def test_one_class_ranking_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "label int, score double")
    r = L.ranking_metrics(df).first()
    assert r["roc_auc"] is None and r["avg_precision"] is None


def test_stratified_split_keeps_class_shares(spark):
    df = spark.createDataFrame([(str(i), int(i % 10 == 0)) for i in range(500)], "CustomerID string, ChurnLabel int")
    out = L.stratified_split(df).filter("is_test").groupBy("ChurnLabel").count().collect()
    assert {r["ChurnLabel"]: r["count"] for r in out} == {0: round(450 * L.TEST_SIZE), 1: round(50 * L.TEST_SIZE)}


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r["count"] for r in P.histogram(df, "a", 3).collect()] == [0, 0, 0]
    assert [r["a"] for r in M.robust_scale(df, ["a", "b"]).collect()] == [None, None]
    assert column_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.5]}


def test_correlation_uses_the_rows_of_each_pair(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 9, 2], "b": [2.0, None, 1, 5, None, 7], "c": [3.0, 1, None, 8, -4, 2],
                        "d": [4.0] * 6})
    got = {(r["col1"], r["col2"]): r["corr"] for r in P.correlation_matrix(spark.createDataFrame(
        pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double"),
        list("abcd")).collect()}
    want = pdf[["a", "b", "c"]].corr()
    for x in "abc":
        for y in "abc":
            assert abs(got[x, y] - want.loc[x, y]) < 1e-9
    assert got["d", "d"] is None and got["a", "d"] is None


def test_knn_with_too_few_points_ends(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 5.0), (4, None, 1.0)], "id long, x double, y double")
    got = {r["id"]: r["kdist"] for r in K.knn_distances(df, ["x", "y"], k=5).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=700).round(2), rng.integers(0, 5, 700).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    got = column_quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 0.9, 1.0], n_buckets=7)
    for c, x in (("v", v), ("w", w)):
        assert np.allclose(got[c], np.quantile(x, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_silhouette_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2)) + np.repeat([[0, 0], [4, 0], [0, 4]], 30, axis=0)
    lab = np.repeat([0, 1, 2], 30)
    df = spark.createDataFrame(pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "l": lab}))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(90):
        m = [d[i, lab == k].sum() / ((lab == k).sum() - (k == lab[i])) for k in range(3)]
        a, b = m[lab[i]], min(m[k] for k in range(3) if k != lab[i])
        want.append((b - a) / max(a, b))
    for block in (7, 1000):
        assert abs(V.silhouette_score(df, ["x", "y"], "l", block)[0] - np.mean(want)) < 1e-9


def test_explanations_name_the_personas_of_the_training_run(spark):
    from patronage.operators import explain as X
    from patronage.plans import training as TR
    from patronage.session import materialize
    from patronage.sources import tables as S
    feats = materialize(TR.prepare(S.transactions(spark, "/root/testdata/sf0.001")))
    res = TR.train_personas(feats, compare=False)
    at = [res["scale_cols"].index(c) for c in res["features"]]
    got = X.explain(feats, res["features"], [res["means"][i] for i in at], [res["scales"][i] for i in at],
                    np.array(res["centers"]), feats)
    both = got.select("CustomerID", F.col("persona").alias("p")).join(res["personas"], "CustomerID")
    assert both.count() == feats.count() and both.filter("p <> Persona").count() == 0


def test_schema_is_unchanged(raw_df):
    assert raw_df.schema == TRANSACTION_SCHEMA
