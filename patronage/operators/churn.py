"""Churn labels, split, model and ranking metrics.

The ranking metrics are exact and distributed: scores are grouped to one
row per distinct value (positives, negatives), and the running totals over
the score order come from bucketed prefix sums, not a global sort.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.expr import risk_band
from patronage.functions.scalars import stats_row
from patronage.operators.ordered import running_totals
from patronage.session import materialize, path_exists, stored

# Default churn training columns, split and forest settings.
DEFAULT_CHURN_FEATURES = ["Recency", "Frequency", "Monetary", "AvgBasketSize", "DiscountUsage", "ReturnRate"]
TEST_SIZE = 0.3
SEED = 42
FOREST = dict(numTrees=200, maxDepth=8, minInstancesPerNode=10)
FILE_ROWS = 16_384      # rows of a file, so that the trees' work is dealt over all cores


def prepare_churn_labels(df: DataFrame, recency="Recency", frequency="Frequency") -> DataFrame:
    """L1: 1 when Recency > its 75th percentile and Frequency <= its 25th."""
    from patronage.operators.ordered import column_quantiles
    q = column_quantiles(df, [recency, frequency], [0.25, 0.75])
    r, f = q[recency][1], q[frequency][0]
    return df.withColumn("ChurnLabel", ((F.col(recency) > F.lit(r)) & (F.col(frequency) <= F.lit(f)))
                         .cast("int"))


def stratified_split(df: DataFrame, label="ChurnLabel", id_col="CustomerID", test_size=TEST_SIZE,
                     seed=SEED) -> DataFrame:
    """L2: exact stratified split: rows are ranked in each class by a seeded
    hash of the id and the first round(n * test_size) are the test rows (equal ids
    share a hash and a side, so the size is exact for distinct ids). Ranks
    come from bucketed running counts, so no class gathers in one task."""
    marked = materialize(df.withColumn("__u", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)),
                                                     F.lit(1 << 52)).cast("double")))
    counts = marked.groupBy(label, "__u").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(label).agg(F.sum("c").alias("__n"))
    cum = running_totals(counts, [label], "__u", ["c"])
    # a class's cut is the smallest hash whose rank reaches its share; equal hashes stay together
    cut = (cum.join(F.broadcast(total), label).filter(F.col("cum_c") >= F.round(F.col("__n") * test_size))
              .groupBy(label).agg(F.min("__u").alias("__cut"), F.max(F.round(F.col("__n") * test_size)).alias("__k")))
    return (marked.join(F.broadcast(cut), label, "left")
                  .withColumn("is_test", F.coalesce((F.col("__u") <= F.col("__cut")) & (F.col("__k") > 0), F.lit(False)))
                  .drop("__u", "__cut", "__k").select(*df.columns, "is_test"))


def class_weights(df: DataFrame, label="ChurnLabel") -> DataFrame:
    """Balanced weight n / (2 * n_class) as a column."""
    t = stats_row(df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("p")))
    n, n_pos = float(t["n"]), float(t["p"] or 0)
    n_cls = F.when(F.col(label) == 1, F.lit(n_pos)).otherwise(F.lit(n - n_pos))
    return df.withColumn("class_weight", F.lit(n) / (2.0 * n_cls))


def train_churn_model(features: DataFrame, feature_cols: list[str] | None = None, id_col="CustomerID"):
    """L3 + L4 + L5 + L6: label, split, weighted forest, test metrics,
    importances. Returns (model, metrics DataFrame, importance DataFrame,
    feature list)."""
    cols = feature_cols or [c for c in DEFAULT_CHURN_FEATURES if c in features.columns]
    lab = stratified_split(prepare_churn_labels(features), id_col=id_col)
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    # written once: the forest, the metrics and the rates read it, not the split behind it
    data = stored(class_weights(assembler.transform(lab).select(id_col, "features", "ChurnLabel", "is_test")), FILE_ROWS)
    train = data.filter(~F.col("is_test"))
    test = data.filter(F.col("is_test"))
    rf = RandomForestClassifier(labelCol="ChurnLabel", featuresCol="features", weightCol="class_weight",
                                seed=SEED, **FOREST)
    model = rf.fit(train)
    scored = model.transform(test).select(
        F.col("ChurnLabel").alias("label"), vector_to_array("probability")[1].alias("score"))
    metrics = ranking_metrics(scored).select(
        F.round("roc_auc", 4).alias("roc_auc"), F.round("avg_precision", 4).alias("avg_precision"))
    rates = data.agg(F.avg("ChurnLabel").alias("churn_rate"),
                     F.count(F.when(~F.col("is_test"), 1)).alias("n_train"),
                     F.count(F.when(F.col("is_test"), 1)).alias("n_test"))
    imp = feature_importances(model, cols)
    return model, metrics, rates, imp, cols


def save_churn_model(model, cols: list[str], path: str) -> None:
    """L3: the forest and its column list as one pipeline, so that neither is kept without the other."""
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    PipelineModel(stages=[assembler, model]).write().overwrite().save(path)


def load_churn_model(path: str):
    """L3: (forest, column list) as saved."""
    assembler, model = PipelineModel.load(path).stages
    return model, assembler.getInputCols()


def ensure_churn_model(path: str, features: DataFrame, id_col="CustomerID"):
    """The stored forest, or one trained on ``features`` and stored if there is none."""
    spark = features.sparkSession
    if path_exists(spark, path):
        return load_churn_model(path)
    model, _, _, _, cols = train_churn_model(features, id_col=id_col)
    save_churn_model(model, cols, path)
    return model, cols


def score_groups(scored: DataFrame, label="label", score="score") -> DataFrame:
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("neg"))


def ranking_metrics(scored: DataFrame, label="label", score="score") -> DataFrame:
    """L4 + L5: exact ROC-AUC (Mann-Whitney, tied scores count one half) and
    step-wise average precision (over distinct thresholds, from high to low, recall increment
    x precision there), from one ascending running total: what stands at or
    above a score is the total, less the running total, plus the score's own. Null where undefined."""
    g = stored(score_groups(scored, label, score))
    t = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    pos, neg = float(t["p"] or 0), float(t["n"] or 0)
    cum = running_totals(g, [], "score", ["pos", "neg"])
    above_pos, above_neg = F.lit(pos) - F.col("cum_pos") + F.col("pos"), F.lit(neg) - F.col("cum_neg") + F.col("neg")
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg")))
    return cum.agg(F.try_divide(wins, F.lit(pos * neg)).alias("roc_auc"),
                   F.try_divide(F.sum(F.col("pos") * above_pos / (above_pos + above_neg)), F.lit(pos)).alias("avg_precision"))


def roc_auc(scored: DataFrame, label="label", score="score") -> DataFrame:
    """L4 alone."""
    return ranking_metrics(scored, label, score).select("roc_auc")


def average_precision(scored: DataFrame, label="label", score="score") -> DataFrame:
    """L5 alone."""
    return ranking_metrics(scored, label, score).select("avg_precision")


def feature_importances(model, cols: list[str]) -> DataFrame:
    """Importances, highest first (a few numbers from the driver-side model)."""
    spark = model.sparkSession if hasattr(model, "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def predict_churn(model, features: DataFrame, cols: list[str], id_col="CustomerID", top=3) -> DataFrame:
    """Probability (4 digits), risk band, top factors by importance."""
    imp = sorted(zip(cols, model.featureImportances.toArray()), key=lambda t: -t[1])[:top]
    factors = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(v)).alias("importance"),
                                 F.lit("positive").alias("direction")) for c, v in imp])
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    asked = stored(features.select(id_col, *cols).na.fill(0.0, subset=cols), FILE_ROWS)
    scored = model.transform(assembler.transform(asked))
    p = vector_to_array("probability")[1]
    return scored.select(F.col(id_col).alias("customer_id"), F.round(p, 4).alias("churn_probability"),
                         risk_band(p).alias("churn_risk"), factors.alias("top_factors"))
