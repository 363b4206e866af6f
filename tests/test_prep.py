import numpy as np
import pandas as pd

from patronage.operators import prep as M
from patronage.operators import profile as P


def test_standard_scale_population_std(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2, 3, 4, 5], "b": [10.0, 20, 30, 40, 50]}))
    out = M.standard_scale(df, ["a", "b"]).toPandas()
    assert np.allclose(out.mean(), 0) and np.allclose(out.std(ddof=0), 1)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2, 3], "k": [7.0, 7, 7]}))
    assert (M.standard_scale(df, ["a", "k"]).toPandas()["k"] == 0).all()


def test_robust_scale(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 100]})
    out = M.robust_scale(spark.createDataFrame(pdf), ["a"]).toPandas()["a"]
    q1, med, q3 = pdf["a"].quantile([0.25, 0.5, 0.75])
    assert np.allclose(out, (pdf["a"] - med) / (q3 - q1))


def test_correlated_dropped(spark):
    a = np.arange(1, 6, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": 2 * a, "c": 6 - a}))
    dropped = [r[0] for r in M.correlation_drop(df, ["a", "b", "c"], 0.8).collect()]
    assert len(dropped) >= 1
    # b has the larger variance; a-b and a-c pairs drop a, b-c drops c
    assert set(dropped) == {"a", "c"}


def test_zero_variance_dropped(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2, 3, 4, 5], "b": [1.0] * 5}))
    v = M.variance_select(df, ["a", "b"]).toPandas().set_index("feature")
    assert bool(v.loc["a", "kept"]) and not bool(v.loc["b", "kept"])


def test_final_features_keeps_rfm(spark):
    drop = spark.createDataFrame([("Recency",), ("ReturnRate",)], "feature string")
    got = {r["feature"] for r in M.final_features_df(drop, M.KEEP_COLS).collect()}
    assert got == set(M.KEEP_COLS) - {"ReturnRate"}


def test_pca_variance_target(spark):
    rng = np.random.RandomState(0)
    z = rng.normal(size=(200, 1))
    X = np.hstack([z, 2 * z + 0.01 * rng.normal(size=(200, 1)), rng.normal(size=(200, 1)) * 0.5])
    df = spark.createDataFrame(pd.DataFrame(X, columns=["a", "b", "c"]))
    model, ratios, k, signs = M.fit_pca(df, ["a", "b", "c"])
    cum = np.cumsum(ratios)
    assert k == int(np.searchsorted(cum, 0.95, side="right") + 1)
    proj = M.pca_project(model, df, k, signs).toPandas()
    assert abs(proj["PC1"].mean()) < 1e-9          # centred
    scree = M.scree_table(spark, ratios).toPandas()
    assert np.allclose(scree["cumulative"], cum)


def test_correlation_matrix_matches_pandas(spark):
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame(rng.normal(size=(50, 3)) * [1, 1e6, 3] + [0, 5e6, 1], columns=["a", "b", "c"])
    got = P.correlation_matrix(spark.createDataFrame(pdf), ["a", "b", "c"]).toPandas()
    exp = pdf.corr()
    for _, r in got.iterrows():
        assert abs(r["corr"] - exp.loc[r["col1"], r["col2"]]) < 1e-9
