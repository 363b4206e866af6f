"""Property checks of the exact distributed running sums and quantiles."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from patronage.operators.ordered import exact_quantiles, running_totals

values = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, st.sampled_from([2, 3, 7]))
def test_running_totals_equal_cumsum(spark, xs, buckets):
    counts = pd.Series(xs).value_counts().sort_index()
    pdf = pd.DataFrame({"v": counts.index.astype(float), "c": counts.to_numpy()})
    got = running_totals(spark.createDataFrame(pdf), [], "v", ["c"], n_buckets=buckets).toPandas()
    got = got.sort_values("v")
    assert (got["cum_c"].to_numpy() == np.cumsum(pdf["c"].to_numpy())).all()
    desc = running_totals(spark.createDataFrame(pdf), [], "v", ["c"], n_buckets=buckets,
                          descending=True).toPandas().sort_values("v")
    assert (desc["cum_c"].to_numpy() == np.cumsum(pdf["c"].to_numpy()[::-1])[::-1]).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values)
def test_exact_quantiles_match_pandas(spark, xs):
    s = pd.Series(xs, dtype=float)
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": s})), "x", [0.05, 0.25, 0.5, 0.75])
    exp = s.quantile([0.05, 0.25, 0.5, 0.75]).to_numpy()
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-9, max_value=9)), max_size=80), st.sampled_from([1, 7]))
def test_column_quantiles_with_few_rows_on_the_driver(spark, xs, rows):
    from patronage.operators.ordered import column_quantiles
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(None if x is None else float(x), None, float(i)) for i, x in enumerate(xs)],
                               "a double, b double, c double")
    got = column_quantiles(df, ["a", "b", "c"], ps, accuracy=4, driver_rows=rows)
    some = [x for x in xs if x is not None]
    assert got["b"] == [None] * 6
    for name, v in (("a", some), ("c", range(len(xs)))):
        want = np.quantile(np.array(v, float), ps).tolist() if len(v) else [None] * 6
        assert got[name] == want or np.allclose(got[name], want, rtol=0, atol=1e-12)


def test_column_quantiles_of_many_values_take_few(spark):
    from pyspark.sql import functions as F
    from patronage.operators.ordered import column_quantiles
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("x"),
                                     F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("y"))
    pdf = df.toPandas()
    got = column_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], accuracy=100, driver_rows=50)
    for c in ("x", "y"):
        assert np.allclose(got[c], pdf[c].quantile([0.25, 0.5, 0.75]).to_numpy(), rtol=0, atol=1e-9)


def test_running_totals_by_key(spark):
    """Keys that share buckets, a null key, one key with most values, no rows."""
    rows = ([("hot", float(i % 40 - 20), i) for i in range(40)] + [("b", 1.5, 3), ("b", -1.5, 4), (None, 2.0, 5), (None, 9.0, 6)])
    df = spark.createDataFrame(rows, "k string, v double, c long")
    for n in (None, 1, 5):
        got = {(r["k"], r["v"]): r["cum_c"] for r in running_totals(df, ["k"], "v", ["c"], n_buckets=n).collect()}
        assert got == {(k, v): sum(c for k2, v2, c in rows if k2 == k and v2 <= v) for k, v, _ in rows}
    assert running_totals(df.limit(0), ["k"], "v", ["c"]).count() == 0
