"""Models, baselines and profile documents that are stored and read again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from patronage.operators import anomaly as N
from patronage.operators import churn as L
from patronage.operators import drift as R
from patronage.sources import personas as PD


@pytest.fixture
def customers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    x[:6] += 10
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf.insert(0, "CustomerID", [f"C{i}" for i in range(len(pdf))])
    pdf.loc[7, "b"] = None
    return spark.createDataFrame(pdf).selectExpr("CustomerID", "a", "if(isnan(b), null, b) AS b", "c", "'kept' AS note")


def test_forest_as_a_stage(spark, customers, tmp_path):
    fitted, summary = N.fit_isolation_forest(customers, ["a", "b", "c"], n_trees=30)
    s = summary.first()
    assert s["total_checked"] == 300 and s["anomaly_rate"] == pytest.approx(0.05, abs=0.01)
    model = N.IsolationForestModel(fitted)
    path = str(tmp_path / "forest")
    model.write().overwrite().save(path)
    model.write().overwrite().save(path)
    with pytest.raises(Exception):
        model.save(path)
    again = N.IsolationForestModel.load(path)
    cols = ["CustomerID", "anomaly_score", "is_anomaly", "reconstruction_error", "note"]
    first = model.transform(customers).select(*cols).orderBy("CustomerID").toPandas()
    pd.testing.assert_frame_equal(first, again.transform(customers).select(*cols).orderBy("CustomerID").toPandas())
    plain = N.decision(fitted, customers).orderBy("customer_id").toPandas()
    assert (plain["anomaly_score"] == first["anomaly_score"]).all() and (plain["is_anomaly"] == first["is_anomaly"]).all()
    assert first["note"].eq("kept").all()
    piped = PipelineModel(stages=[SQLTransformer(statement="SELECT * FROM __THIS__"), again])
    piped.write().overwrite().save(str(tmp_path / "pipe"))
    out = PipelineModel.load(str(tmp_path / "pipe")).transform(customers).select(*cols).orderBy("CustomerID").toPandas()
    pd.testing.assert_frame_equal(first, out)


def test_tree_sample_is_an_argument(spark, customers):
    fitted, _ = N.fit_isolation_forest(customers, ["a", "b", "c"], n_trees=10, max_samples=32)
    assert fitted["psi"] == 32 and all(t[4][0] == 32 for t in fitted["trees"])


def test_churn_forest_with_its_columns(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 200
    pdf = pd.DataFrame({"CustomerID": [f"C{i}" for i in range(n)], "Recency": rng.integers(0, 200, n),
                        "Frequency": rng.integers(1, 9, n), "Monetary": rng.uniform(1, 90, n)})
    df = spark.createDataFrame(pdf)
    path = str(tmp_path / "churn")
    model, cols = L.ensure_churn_model(path, df)
    again, names = L.ensure_churn_model(path, df.limit(0))       # read, not trained
    assert names == cols
    a = L.predict_churn(model, df, cols).orderBy("customer_id").collect()
    assert a == L.predict_churn(again, df, names).orderBy("customer_id").collect()


def test_baseline_falls_back_to_personas(spark, customers, tmp_path):
    base, pers = str(tmp_path / "base"), str(tmp_path / "personas")
    assert R.load_baseline(spark, base, pers) is None and R.load_baseline(spark, base) is None
    customers.selectExpr("*", "1 AS Cluster", "'x' AS Persona", "0.5D AS PC1", "0.5D AS PC2").write.parquet(pers)
    got = R.load_baseline(spark, base, pers)
    assert got.columns == ["CustomerID", "a", "b", "c"] and got.count() == 300
    customers.select("CustomerID", "a").limit(3).write.mode("overwrite").parquet(pers)
    assert R.load_baseline(spark, base, pers).count() == 300     # the stored one counts


def test_profile_documents(spark):
    df = spark.createDataFrame([("c1", 0, "P", 2.0, 20_000_000, None), ("c2", 0, "P", 3.5, 20_000_001, None),
                                ("c3", 1, None, 1.0, 1, 1.0), ("c4", 1, "Q", 0.1234, 7, -1.5)],
                               "CustomerID string, Cluster int, Persona string, f double, g long, h double")
    got = {r["Persona"]: r for r in PD.profile_documents(df, "customer_personas").collect()}
    assert got.keys() == {"P", "Q"}
    assert got["P"]["content"] == "Persona: P\nAverage feature profile: f: 2.75, g: 20000000.5, h: nan"
    assert got["Q"]["content"].endswith("f: 0.123, g: 7.0, h: -1.5")
    assert got["Q"]["metadata"] == {"source": "customer_personas", "type": "persona_profile", "persona": "Q"}
    assert PD.persona_documents(spark).filter("content LIKE 'Persona: %Recommendations: %'").count() == PD.persona_dim(spark).count()
