"""Shapley contributions: block form against the plain enumeration, sampled against exact."""

import numpy as np

from patronage.operators import explain as X


def model(d, k=4, n=40, seed=0, **more):
    rng = np.random.default_rng(seed)
    mean, scale = rng.normal(size=d), rng.uniform(0.5, 2, size=d)
    centers, background = rng.normal(size=(k, d)), rng.normal(size=(n, d)) * 2
    return (mean, scale, centers, background), X.Explainer(mean, scale, centers, background, **more), rng


def test_block_form_equals_plain_enumeration():
    (mean, scale, centers, background), m, rng = model(6)
    x = rng.normal(size=(25, 6)) * 2
    phi, error, base = m.explain(x)
    for row, p, b in zip(x, phi, base):
        want, start, full = X.shapley_values(row, background, lambda z: X._predict(z, mean, scale, centers))
        assert np.allclose(p, want) and abs(b - start) < 1e-12 and abs(p.sum() + b - full) < 1e-9
    assert not error.any() and m.method == "exact"


def test_sampled_is_near_exact_and_adds_up():
    args, exact, rng = model(8, seed=3)
    sampled = X.Explainer(*args, exact_features=4, pairs=300)
    assert sampled.method == "sampled"
    x = rng.normal(size=(30, 8)) * 2
    want, _, base = exact.explain(x)
    got, error, start = sampled.explain(x)
    assert np.allclose(base, start) and np.allclose(got.sum(axis=1), want.sum(axis=1))
    off = np.abs(got - want) / np.maximum(error, 1e-9)
    assert (np.abs(got - want)[error < 1e-9] < 1e-9).all()
    assert (off[error > 1e-9] < 4).mean() > 0.99 and off[error > 1e-9].max() < 6
    assert np.array_equal(got, X.Explainer(*args, exact_features=4, pairs=300).explain(x)[0])


def test_fourteen_features_and_nulls(spark):
    rng = np.random.default_rng(1)
    cols = [f"f{i}" for i in range(14)]
    rows = [(i, *[float(v) for v in rng.normal(size=14)]) for i in range(40)] + [(40, *[None] * 14)]
    df = spark.createDataFrame(rows, "CustomerID long, " + ", ".join(f"{c} double" for c in cols))
    got = X.explain(df, cols, [0.0] * 14, [1.0] * 14, rng.normal(size=(4, 14)), df, n_background=20, pairs=32).collect()
    assert len(got) == 41
    for r in got:
        assert r["method"] == "sampled" and r["background_rows"] == 20 and len(r["contributions"]) == 14
        assert abs(r["base_value"] + r["contribution_sum"] - r["cluster"]) < 1e-9
        assert all(c["standard_error"] >= 0 for c in r["contributions"])
    assert X.explain(df.limit(0), cols, [0.0] * 14, [1.0] * 14, rng.normal(size=(4, 14)), df).count() == 0


def test_many_background_rows_equal_centroids_and_ties():
    rng = np.random.default_rng(5)
    d = 5
    centers = rng.normal(size=(3, d))
    centers = np.concatenate([centers, centers[1:2]])           # the last is never the first nearest
    mean, scale, background = np.zeros(d), np.ones(d), rng.normal(size=(300, d))
    m = X.Explainer(mean, scale, centers, background)
    x = rng.normal(size=(20, d))
    v = m.values(x)
    for row, got in zip(x, v):
        z = np.where(m.masks[:, None, :], row, background[None])
        assert np.allclose(got, X._predict(z, mean, scale, centers).mean(axis=1))


def test_customers_are_dealt_to_tasks_whatever_wrote_them(spark):
    df = spark.range(2 * X.TASK_ROWS + 1).selectExpr("id CustomerID", "double(id % 7) a", "double(id % 5) b").coalesce(1)
    got = X.explain(df, ["a", "b"], [3.0, 2.0], [2.0, 1.0], np.array([[-1.0, 0.0], [1.0, 0.5]]), df)
    assert len(got.inputFiles()) == 3 and got.count() == 2 * X.TASK_ROWS + 1
