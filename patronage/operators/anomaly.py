"""Isolation forest.

Training: each of the 200 trees needs its own sample of at most 256 rows.
Rows enter a tree by a seeded hash of (id, tree); a tree group holds a few
hundred candidates, of which the 256 with the smallest hash are kept, so
``groupBy(tree).applyInPandas`` builds one tree per group with bounded
input. The trees (model-sized: 200 x at most 511 nodes) are broadcast and
every task scores its rows with vectorised numpy traversal. The decision
threshold is the contamination quantile of the training scores, computed
with the distributed exact quantile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.ordered import exact_quantile
from patronage.session import stored

# Forest settings.
N_TREES = 200
MAX_SAMPLES = 256
CONTAMINATION = 0.05
SEED = 42
EULER = 0.5772156649015329
TREE_SCHEMA = ("tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
               "size array<int>")


def avg_path_length(n):
    """c(n): average path length of an unsuccessful search in a BST of n."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _build_tree(X: np.ndarray, rng: np.random.RandomState, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.where(hi > lo)[0]
        if len(usable) == 0:
            return i
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        mask = sub[:, f] < t
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(X)), 0)
    return feat, thr, left, right, size


def _tree_builder(cols, psi, seed):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["h", "__rid"]).head(psi)
        X = pdf[cols].to_numpy(dtype=float)
        rng = np.random.RandomState(seed + t)
        f, th, le, ri, sz = _build_tree(X, rng, max_depth)
        return pd.DataFrame({"tree": [t], "feature": [f], "threshold": [th], "left": [le], "right": [ri],
                             "size": [sz]})
    return build


def fit_isolation_forest(df: DataFrame, cols: list[str], id_col: str = "CustomerID", n_trees: int = N_TREES,
                         seed: int = SEED, contamination: float = CONTAMINATION, max_samples: int = MAX_SAMPLES):
    """Returns a model dict (trees, psi, offset, cols) and the summary
    DataFrame (total_checked, anomalies_found, anomaly_rate). A null feature counts as 0,
    in training as in scoring; ``max_samples`` rows make a tree."""
    n = df.count()
    psi = min(max_samples, n)
    want = psi
    base = df.select(F.col(id_col).cast("string").alias("__rid"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    mult = 3.0
    while True:
        p = min(1.0, mult * want / max(n, 1))
        f_union = min(1.0, p * n_trees)
        u0 = F.pmod(F.xxhash64("__rid", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0
        union = base.filter(u0 < f_union)
        trees_of = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                            lambda t: F.pmod(F.xxhash64("__rid", F.lit(seed), t), F.lit(1_000_000_007))
                            / 1_000_000_007.0 < F.lit(p / f_union))
        cand = union.select("*", F.explode(trees_of).alias("tree"))
        cand = cand.withColumn("h", F.xxhash64("__rid", F.lit(seed), F.col("tree")))
        short = cand.groupBy("tree").count().filter(F.col("count") < want).count()
        missing = n_trees - cand.select("tree").distinct().count()
        if (short == 0 and missing == 0) or p >= 1.0:
            break
        mult *= 2.0
    build = _tree_builder(cols, psi, seed)
    trees = (cand.select("tree", "h", "__rid", *cols).groupBy("tree").applyInPandas(build, TREE_SCHEMA)
             .orderBy("tree").toPandas())
    model = {"cols": list(cols), "psi": psi,
             "trees": [tuple(np.asarray(r[c]) for c in ("feature", "threshold", "left", "right", "size"))
                       for _, r in trees.iterrows()]}
    # the quantile reads the scores several times, the summary once more
    scored = stored(score_samples(model, df, id_col).select("score_sample"))
    offset = exact_quantile(scored, "score_sample", contamination)
    model["offset"] = float(df.sparkSession.range(1).select(offset).first()[0])
    summary = anomaly_summary(scored.select((F.col("score_sample") < F.lit(model["offset"])).alias("is_anomaly")))
    return model, summary


def tree_scores(X: np.ndarray, trees, psi: int) -> np.ndarray:
    """Negative anomaly score of each row: all rows go down one tree after the other."""
    cpsi = float(avg_path_length(np.array([psi]))[0]) or 1.0
    depth_sum = np.zeros(len(X))
    for feat, thr, left, right, size in trees:
        node = np.zeros(len(X), dtype=int)
        depth = np.zeros(len(X))
        active = feat[node] >= 0
        while active.any():
            idx = np.where(active)[0]
            f = feat[node[idx]]
            go_left = X[idx, f] < thr[node[idx]]
            node[idx] = np.where(go_left, left[node[idx]], right[node[idx]])
            depth[idx] += 1
            active = feat[node] >= 0
        depth_sum += depth + avg_path_length(size[node])
    return -np.power(2.0, -(depth_sum / len(trees)) / cpsi)


def _scorer(bmodel):
    def run(it):
        m = bmodel.value
        cols = m["cols"]
        for pdf in it:
            if pdf.empty:
                continue
            out = pdf.drop(columns=cols).copy()
            out["score_sample"] = tree_scores(pdf[cols].to_numpy(dtype=float), m["trees"], m["psi"])
            yield out
    return run


def score_samples(model: dict, df: DataFrame, id_col: str = "CustomerID") -> DataFrame:
    """Negative anomaly score per row (higher = more normal)."""
    cols = model["cols"]
    b = df.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "offset"})
    data = df.select(F.col(id_col), *[F.col(c).cast("double").alias(c) for c in cols]).na.fill(0.0, subset=cols)
    schema = data.select(id_col).schema.add("score_sample", "double")
    return data.mapInPandas(_scorer(b), schema)


def decision(model: dict, df: DataFrame, id_col: str = "CustomerID") -> DataFrame:
    """Decision score (6 digits), anomaly flag (score < 0) and
    reconstruction_error = 0.5 - score."""
    s = score_samples(model, df, id_col)
    d = F.col("score_sample") - F.lit(model["offset"])
    return s.select(F.col(id_col).alias("customer_id"), F.round(d, 6).alias("anomaly_score"),
                    (d < 0).alias("is_anomaly"), F.round(F.lit(0.5) - d, 6).alias("reconstruction_error"))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Checked, found, rate (4 digits) from a scored table."""
    return scored.agg(F.count(F.lit(1)).alias("total_checked"),
                      F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies_found")).withColumn(
        "anomaly_rate", F.round(F.col("anomalies_found") / F.col("total_checked"), 4))


NODE_ARRAYS = ("feature", "threshold", "left", "right", "size")


class IsolationForestModel(Model, HasInputCols, MLWritable, MLReadable):
    """The fitted forest as a pipeline stage that can be saved: settings in the
    metadata, one row a tree in a Parquet table beside them. ``transform`` adds
    ``anomaly_score``, ``is_anomaly`` and ``reconstruction_error`` to whatever columns there are."""

    psi = Param(Params._dummy(), "psi", "rows of a tree's sample", TypeConverters.toInt)
    offset = Param(Params._dummy(), "offset", "score below which a row is an anomaly", TypeConverters.toFloat)

    def __init__(self, model: dict | None = None):
        super().__init__()
        self.trees: list[tuple] = []
        if model is not None:
            self._set(inputCols=model["cols"], psi=model["psi"], offset=model["offset"])
            self.trees = model["trees"]

    def as_dict(self) -> dict:
        return {"cols": self.getInputCols(), "psi": self.getOrDefault(self.psi),
                "offset": self.getOrDefault(self.offset), "trees": self.trees}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        b = dataset.sparkSession.sparkContext.broadcast((self.trees, self.getOrDefault(self.psi)))

        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(tree_scores(np.column_stack([c.to_numpy(dtype=float) for c in columns]), *b.value))

        score = F.pandas_udf(run, "double")(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.getInputCols()])
        d = F.col("__score") - F.lit(self.getOrDefault(self.offset))
        return (dataset.withColumn("__score", score)
                       .withColumns({"anomaly_score": F.round(d, 6), "is_anomaly": d < 0,
                                     "reconstruction_error": F.round(F.lit(0.5) - d, 6)}).drop("__score"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, instance: IsolationForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = [(i, *[np.asarray(a).tolist() for a in tree]) for i, tree in enumerate(self.instance.trees)]
        self.sparkSession.createDataFrame(rows, TREE_SCHEMA).write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        model = IsolationForestModel()
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        trees = self.sparkSession.read.schema(TREE_SCHEMA).parquet(f"{path}/trees").orderBy("tree").collect()
        model.trees = [tuple(np.asarray(r[c]) for c in NODE_ARRAYS) for r in trees]
        return model
