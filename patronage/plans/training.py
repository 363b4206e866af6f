"""Persona training and scoring.

Training keeps the reference's stage order: clean, outlier fences,
features, population-std scaling of the 14 features, correlation-based
drop, the final feature list, PCA to 95 %, comparison of three KMeans
variants, and a refit of the best k on the selected features. Clusters are
renumbered by descending mean Monetary before the persona names are
attached (a stated change: the reference names arbitrary cluster ids).

The fitted scoring chain is a single ``PipelineModel``: a SQL stage with
the learned means and deviations, one with the fitted centres
and one with the cluster renumbering, so saving and loading it
keeps every fitted number.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators import clean as C
from patronage.operators import cluster as K
from patronage.operators import features as FT
from patronage.operators import prep as M
from patronage.sources.personas import attach_persona


def scaler_stage(df: DataFrame, cols: list[str], suffix: str = "__s") -> tuple[SQLTransformer, list, list]:
    """Fitted population-std scaler as a SQL stage (constant column -> 0)."""
    st = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    means = [float(st[f"m_{i}"]) for i in range(len(cols))]
    sds = [float(st[f"s_{i}"]) if st[f"s_{i}"] else 1.0 for i in range(len(cols))]
    exprs = ", ".join(f"(`{c}` - ({m!r})) / ({s!r}) AS `{c}{suffix}`" for c, m, s in zip(cols, means, sds))
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"), means, sds


def relabel_stage(mapping: dict[int, int], raw: str = "RawCluster", col: str = "Cluster") -> SQLTransformer:
    cases = " ".join(f"WHEN {old} THEN {new}" for old, new in sorted(mapping.items()))
    return SQLTransformer(statement=f"SELECT *, CAST(CASE `{raw}` {cases} END AS INT) AS `{col}` FROM __THIS__")


def prepare(tx: DataFrame, outliers: bool = True) -> DataFrame:
    """Stages 1-2: clean and (optionally) fence outliers, then features."""
    c = C.clean_data(tx)
    if outliers:
        c = C.handle_outliers(c, C.OUTLIER_COLUMNS)
    return FT.build_customer_features(c)


def train_personas(features: DataFrame, k: int = K.KMEANS_K, seed: int = K.SEED, n_init: int = K.N_INIT,
                   k_range=range(2, 8), compare: bool = True, id_col: str = "CustomerID") -> dict:
    """K4 + K5: returns model, selected features, comparison table, PCA info
    and the persona table (customer, cluster, persona, PC1, PC2)."""
    scale_cols = FT.feature_columns_present(features)
    feats = features.na.fill(0.0, subset=scale_cols)
    scaler, means, sds = scaler_stage(feats, scale_cols)
    scaled = scaler.transform(feats)
    s_cols = [f"{c}__s" for c in scale_cols]
    renamed = scaled.select(id_col, *[F.col(f"{c}__s").alias(c) for c in scale_cols])
    dropped = M.correlation_drop(renamed, scale_cols)
    drop = [r["feature"] for r in dropped.collect()]
    final = [r["feature"] for r in M.final_features_df(dropped, scale_cols).orderBy("feature").collect()]
    pca_model, ratios, n_pc, signs = M.fit_pca(renamed, final)
    proj = M.pca_project(pca_model, renamed, n_pc, signs)
    pcs = [f"PC{i + 1}" for i in range(n_pc)]
    table, best = None, None
    best_k = k
    if compare:
        table, best = K.compare_methods(proj, final, pcs, k, k_range, seed)
        best_k = int(best["k"])
    # refit on the selected features with the chosen k
    sel = [f"{c}__s" for c in final]
    km = K.kmeans_best(scaled, sel, best_k, seed, n_init)
    km_stage = K.nearest_center_stage(sel, km.centers, "RawCluster")
    pred = km_stage.transform(scaled)
    means_by = (pred.groupBy("RawCluster").agg(F.avg("Monetary").alias("m")).orderBy(F.desc("m"), "RawCluster")
                .collect())
    mapping = {int(r["RawCluster"]): i for i, r in enumerate(means_by)}
    model = PipelineModel(stages=[scaler, km_stage, relabel_stage(mapping)])
    two_d, _, _, s2 = M.fit_pca(renamed, final, k=2)
    pc2 = M.pca_project(two_d, renamed.select(id_col, *final), 2, s2).select(id_col, "PC1", "PC2")
    personas = attach_persona(model.transform(feats).select(*features.columns, "Cluster")).join(pc2, id_col)
    return {"model": model, "features": final, "dropped": drop, "scale_cols": scale_cols,
            "means": means, "scales": sds, "pca_ratios": ratios, "pca_components": n_pc,
            "comparison": table, "best": best, "k": best_k, "personas": personas,
            "centers": _ordered(km.centers, mapping), "mapping": mapping}


def _ordered(centers, mapping: dict[int, int]) -> list:
    """Centres in the order of the renumbered clusters; one that no customer
    has keeps a place after them."""
    last = len(mapping)
    return [centers[i] for i in sorted(range(len(centers)), key=lambda i: (mapping.get(i, last), i))]


def predict_personas(model: PipelineModel, features: DataFrame) -> DataFrame:
    """K5: score features with a fitted (or loaded) model and name personas."""
    scored = model.transform(features)
    return attach_persona(scored.select(*features.columns, "Cluster"))


def save_model(model: PipelineModel, path: str) -> None:
    """S12."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def build_scoring_pipeline(stages) -> Pipeline:
    return Pipeline(stages=stages)


__all__ = ["train_personas", "predict_personas", "save_model", "load_model", "prepare", "VectorAssembler"]
