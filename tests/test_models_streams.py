import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from patronage.operators import anomaly as N
from patronage.operators import churn as L
from patronage.operators import drift as R
from patronage.operators import explain as X
from patronage.operators import features as FT
from patronage.operators import forecast as FC
from patronage.operators import retrieve as T
from patronage.operators import upsert as U
from patronage.sources import sinks as SK
from patronage.sources import tables as S
from patronage.streaming import transactions as ST
from tests.conftest import SF


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.RandomState(0)
    X = rng.normal(size=(300, 3))
    X[:5] += 12.0
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf["CustomerID"] = [f"C{i}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    model, summary = N.fit_isolation_forest(df, ["a", "b", "c"], n_trees=50)
    s = summary.first()
    assert s["total_checked"] == 300 and 10 <= s["anomalies_found"] <= 20
    flagged = {r["customer_id"] for r in N.decision(model, df).filter("is_anomaly").collect()}
    assert {f"C{i}" for i in range(5)} <= flagged


def test_shapley_additivity():
    rng = np.random.RandomState(1)
    C = rng.normal(size=(3, 4))
    bg = rng.normal(size=(20, 4))
    x = rng.normal(size=4) * 2
    pred = lambda Z: X._predict(Z, np.zeros(4), np.ones(4), C)
    phi, base, full = X.shapley_values(x, bg, pred)
    assert abs(phi.sum() - (full - base)) < 1e-9


def test_explain_rows(spark):
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame(rng.normal(size=(30, 3)), columns=["a", "b", "c"])
    pdf["CustomerID"] = [f"C{i}" for i in range(30)]
    df = spark.createDataFrame(pdf)
    out = X.explain(df, ["a", "b", "c"], [0, 0, 0], [1, 1, 1], rng.normal(size=(4, 3)), df,
                    n_background=10).toPandas()
    assert len(out) == 30
    assert all(len(c) == 3 for c in out["contributions"])


def test_drift_self_is_zero_and_shift_detected(spark):
    rng = np.random.RandomState(3)
    a = pd.DataFrame({"x": rng.normal(size=400), "k": np.ones(400)})
    b = pd.DataFrame({"x": rng.normal(loc=2.0, size=400), "k": np.ones(400)})
    da, db = spark.createDataFrame(a), spark.createDataFrame(b)
    same = R.detect_drift(da, da, ["x", "k"]).toPandas().set_index("feature")
    assert same.loc["x", "psi"] == 0 and same.loc["x", "ks_statistic"] == 0
    assert same.loc["k", "psi"] == 0 and not same.loc["k", "drift_detected"]
    moved = R.detect_drift(da, db, ["x"]).toPandas().set_index("feature")
    assert moved.loc["x", "drift_detected"] and moved.loc["x", "psi"] > 0.25
    # KS statistic against a direct two-sample computation
    xs, ys = np.sort(a["x"]), np.sort(b["x"])
    grid = np.concatenate([xs, ys])
    d = np.max(np.abs(np.searchsorted(xs, grid, "right") / 400 - np.searchsorted(ys, grid, "right") / 400))
    assert abs(moved.loc["x", "ks_statistic"] - round(d, 6)) < 1e-6


def test_ranking_metrics_match_brute_force(spark):
    rng = np.random.RandomState(4)
    y = rng.randint(0, 2, 200)
    s = np.round(rng.uniform(size=200) + 0.3 * y, 1)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    m = L.ranking_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    thr = np.unique(s)[::-1]
    ap, prev = 0.0, 0.0
    for t in thr:
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        rec = tp / len(pos)
        ap += (rec - prev) * tp / (tp + fp)
        prev = rec
    assert abs(m["roc_auc"] - auc) < 1e-12 and abs(m["avg_precision"] - ap) < 1e-12


def test_linear_forecast(spark):
    ds = pd.date_range("2024-01-31", periods=6, freq="ME").date
    pdf = pd.DataFrame({"Persona": "P", "ds": ds, "y": [10.0, 12, 14, 16, 18, 20]})
    fc = FC.linear_forecast(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    assert list(fc["predicted_value"]) == [22.0, 24.0, 26.0]
    assert str(fc["date"].iloc[0]) == "2024-07-31"
    sea = FC.seasonal_forecast(spark.createDataFrame(pdf)).toPandas()
    assert len(sea) == 3 and set(sea["model"]) == {"linear"}


def test_seasonal_forecast_recovers_season_and_names_its_model(spark):
    ds = pd.date_range("2021-01-31", periods=48, freq="ME")
    y = np.expm1(4 + 0.01 * np.arange(48) + 0.3 * np.sin(2 * np.pi * np.arange(48) / 12))
    pdf = pd.DataFrame({"Persona": "A", "ds": ds[:42], "y": y[:42]})
    short = pd.DataFrame({"Persona": "B", "ds": ds[:8], "y": y[:8]})
    alone = pd.DataFrame({"Persona": "C", "ds": ds[:1], "y": y[:1]})
    series = spark.createDataFrame(pd.concat([pdf, short, alone]))
    out = FC.seasonal_forecast(series, periods=6).orderBy("Persona", "date").toPandas()
    a = out[out["Persona"] == "A"]
    assert np.allclose(a["predicted_value"], y[42:], atol=0.02) and set(a["model"]) == {"seasonal"}
    assert set(out[out["Persona"] == "B"]["model"]) == {"linear"} and "C" not in set(out["Persona"])
    again = FC.seasonal_forecast(series, periods=6, min_points=8).toPandas()
    assert set(again[again["Persona"] == "B"]["model"]) == {"seasonal"}


def test_chunks_cover_whole_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2650))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ch = T.chunk_documents(df).orderBy("chunk_no").toPandas()
    assert list(ch["chunk_no"]) == [0, 1, 2, 3]
    assert ch["content"].iloc[-1].endswith(text[-10:])
    assert all(len(c) <= 1000 for c in ch["content"])


def test_nearest_matches_brute_force(spark):
    rng = np.random.RandomState(5)
    V = rng.normal(size=(120, 8))
    Q = rng.normal(size=(3, 8))
    items = spark.createDataFrame([(i, V[i].tolist()) for i in range(120)], "id long, embedding array<double>")
    qs = spark.createDataFrame([(j, Q[j].tolist()) for j in range(3)], "qid long, embedding array<double>")
    got = T.nearest(items.repartition(4), qs, 5).toPandas()
    Vn = V / np.linalg.norm(V, axis=1, keepdims=True)
    for j in range(3):
        sims = Vn @ (Q[j] / np.linalg.norm(Q[j]))
        exp = list(np.argsort(-sims)[:5])
        assert list(got[got.qid == j].sort_values("rank")["id"]) == exp


def test_upsert_counts(spark):
    cur = U.feature_table(spark.createDataFrame(pd.DataFrame({"CustomerID": ["A", "B"], **{
        k: [1.0, 2.0] for k in FT.COLUMN_MAP}})))
    new = spark.createDataFrame(pd.DataFrame({"CustomerID": ["B", "C"], **{k: [5.0, 6.0] for k in FT.COLUMN_MAP}}))
    merged, counts = U.upsert_features(cur, new)
    c = counts.first()
    assert (c["inserted"], c["updated"]) == (1, 1)
    m = merged.toPandas().set_index("customer_id")
    assert m.loc["A", "recency"] == 1.0 and m.loc["B", "recency"] == 5.0 and m.loc["C", "recency"] == 6.0


def test_stream_equals_batch(spark):
    tx = S.transactions(spark, SF)
    from patronage.operators import clean as C
    msgs = ST.to_messages(tx.unionByName(tx.filter("Quantity > 40")))
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(base, "in")
    msgs.repartition(3).write.json(src)
    stream = ST.read_folder(spark, src, files_per_trigger=1)
    q, ref = ST.start_refresh(stream, os.path.join(base, "state"), os.path.join(base, "out"),
                              os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = ref.latest_features(spark)
    exp = FT.build_customer_features(C.clean_data(tx))
    cols = ["CustomerID", "Recency", "Frequency", "TotalQty", "ProductDiversity", "CategoryDiversity",
            "WeekendOrders", "NightOrders"]
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0
    assert got.count() == exp.count()
    m = got.join(exp.select("CustomerID", F.col("Monetary").alias("m2")), "CustomerID")
    assert m.filter(F.abs(F.col("Monetary") - F.col("m2")) > 1e-6).count() == 0


def test_kafka_record_encoding(spark):
    rec = ST.kafka_records(ST.to_messages(S.transactions(spark, SF))).first()
    import json
    v = json.loads(rec["value"])
    assert rec["key"] == v["customer_id"] and set(v) == {f.name for f in ST.MESSAGE_SCHEMA.fields}
    opts = ST.kafka_source_options("host:9092")
    assert opts["startingOffsets"] == "latest" and "maxOffsetsPerTrigger" not in opts
    assert ST.kafka_source_options("host:9092", records_per_trigger=7)["maxOffsetsPerTrigger"] == "7"


def test_generator_and_csv_roundtrip(spark):
    cust, tx = SK.generate_data(spark, 50, 500)
    p = tx.toPandas()
    assert len(p) == 500 and p["quantity"].between(1, 5).all()
    assert set(p["product_category"]) <= set(SK.PRODUCT_CATEGORIES)
    assert 0.1 < p["returned"].mean() < 0.3
    base = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    batch = S.from_snake(tx)
    SK.write_table(batch.withColumn("InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")),
                   base + "/raw", fmt="csv")
    back = S.load_raw_csv(spark, base + "/raw")
    assert back.count() == 500 and dict(back.dtypes)["InvoiceDate"] == "timestamp"


def test_churn_training_runs(spark):
    f = FT.build_customer_features(S.transactions(spark, SF))
    model, metrics, rates, imp, cols = L.train_churn_model(f)
    m = metrics.first()
    assert 0 <= m["roc_auc"] <= 1 and imp.count() == len(cols)
    pred = L.predict_churn(model, f, cols).first()
    assert pred["churn_risk"] in ("Low", "Medium", "High") and len(pred["top_factors"]) == 3


def test_a_replay_has_a_bounded_number_of_batches(spark, tmp_path):
    tx = spark.range(60).selectExpr(
        "concat('INV', id) InvoiceID", "string(id % 7) CustomerID", "timestamp'2024-01-01' + make_dt_interval(int(id)) InvoiceDate",
        "'A' ProductCategory", "string(id % 5) ProductID", "int(1) Quantity", "2.0D UnitPrice", "0.0D DiscountPct", "'Card' PaymentMethod", "false Returned")
    where = str(tmp_path / "in")
    ST.to_messages(tx).repartition(9).write.json(where)
    assert ST.files_a_batch(spark, where, 3) == 3 and ST.files_a_batch(spark, where, 100) == 1
    q, ref = ST.start_refresh(ST.read_folder(spark, where, ST.files_a_batch(spark, where, 3)), str(tmp_path / "state"),
                              str(tmp_path / "out"), str(tmp_path / "ckpt"), buckets=2)
    q.awaitTermination()
    assert len(ref._done(spark)) == 3
    assert ref.latest_features(spark).agg(F.sum("TotalQty").alias("n")).first()["n"] == 60


def test_customers_to_score_are_dealt_to_tasks(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(2 * L.FILE_ROWS + 1).selectExpr("id CustomerID", "double(id % 7) a", "double(id % 5) b", "int(id % 2) y").coalesce(1)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.limit(200))
    model = RandomForestClassifier(labelCol="y", numTrees=2, maxDepth=2, seed=1).fit(data)
    got = L.predict_churn(model, df, ["a", "b"])
    assert len(got.inputFiles()) == 3 and got.count() == 2 * L.FILE_ROWS + 1


def test_a_batch_leaves_no_tables_of_its_own(spark, tmp_path):
    """What a micro-batch writes on its way is gone when it is done, so that disk grows with the state only."""
    from patronage.session import ensure_checkpoint_dir
    kept = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(kept))
    ref = ST.FeatureRefresher(f"{tmp_path}/state", f"{tmp_path}/out")
    row = ("INV1", "7", "2024-01-02 03:04:05", "cat", "p1", 2, 3.0, 0.0, "card", False)
    for b in range(2):
        ref(spark.createDataFrame([(f"INV{b}", *row[1:]), row], ST.MESSAGE_SCHEMA), b)
    assert set(os.listdir(kept)) == before
    got = ref.latest_features(spark).first()
    assert (got["Frequency"], got["TotalQty"], got["Monetary"]) == (2, 4, 12.0)
