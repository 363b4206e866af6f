"""Persona dimension (cluster -> persona, description, recommendations).

A fixed four-row table: broadcasting it is safe by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Persona names, descriptions and recommendations per cluster.
PERSONA_MAP = {
    0: "VIP Loyal Customers",
    1: "Discount Hunters",
    2: "Churn Risk",
    3: "One-Time Buyers",
}
PERSONA_DESCRIPTIONS = {
    "VIP Loyal Customers": "High spending, frequent purchases, low recency. Core revenue drivers.",
    "Discount Hunters": "Low spending, only during sales/discounts. Price-sensitive segment.",
    "Churn Risk": "Inactive for months, low frequency, high recency. Need re-engagement.",
    "One-Time Buyers": "Bought once, never returned. Low monetary & frequency.",
}
BUSINESS_RECOMMENDATIONS = {
    "VIP Loyal Customers": [
        "Exclusive rewards & VIP loyalty program",
        "Early access to new products",
        "Personalized recommendations",
    ],
    "Discount Hunters": [
        "Targeted coupon campaigns",
        "Flash sale notifications",
        "Bundle deals to increase basket size",
    ],
    "Churn Risk": [
        "Win-back email campaigns",
        "Special reactivation discounts",
        "Survey to understand inactivity",
    ],
    "One-Time Buyers": [
        "Cross-selling on complementary products",
        "Post-purchase follow-up sequence",
        "Free shipping on second purchase",
    ],
}
UNKNOWN = "Unknown"

PERSONA_SCHEMA = T.StructType([
    T.StructField("Cluster", T.IntegerType(), False),
    T.StructField("Persona", T.StringType(), False),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Recommendations", T.ArrayType(T.StringType()), True),
])


def persona_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, v, PERSONA_DESCRIPTIONS[v], BUSINESS_RECOMMENDATIONS[v])
            for k, v in sorted(PERSONA_MAP.items())]
    return spark.createDataFrame(rows, PERSONA_SCHEMA)


def attach_persona(df: DataFrame, cluster_col: str = "Cluster", keep_details: bool = False) -> DataFrame:
    """Persona name from the cluster number; ids outside the map
    give ``Unknown``. Broadcast left join against the fixed dimension."""
    dim = persona_dim(df.sparkSession)
    cols = ["Cluster", "Persona"] + (["Description", "Recommendations"] if keep_details else [])
    dim = dim.select(*[F.col(c).alias(f"__p_{c}") for c in cols])
    out = df.join(F.broadcast(dim), F.col(cluster_col) == F.col("__p_Cluster"), "left")
    out = out.withColumn("Persona", F.coalesce(F.col("__p_Persona"), F.lit(UNKNOWN)))
    if keep_details:
        out = (out.withColumn("Description", F.col("__p_Description"))
                  .withColumn("Recommendations", F.col("__p_Recommendations")))
    return out.drop(*[f"__p_{c}" for c in cols])


def persona_documents(spark: SparkSession) -> DataFrame:
    """One text document per persona with its recommendations."""
    dim = persona_dim(spark)
    return dim.select(
        F.concat(F.lit("Persona: "), F.col("Persona"), F.lit("\nDescription: "), F.col("Description"),
                 F.lit("\nRecommendations: "), F.array_join(F.col("Recommendations"), ", ")).alias("content"),
        F.create_map(F.lit("source"), F.lit("config"), F.lit("type"), F.lit("persona"),
                     F.lit("persona"), F.col("Persona")).alias("metadata"),
    )


def _plain(c):
    """A number of at most three digits after the point, never in scientific notation, at least one digit kept."""
    return F.regexp_replace(c.cast("decimal(38,3)").cast("string"), r"(\.\d+?)0+$", "$1")


def profile_documents(personas: DataFrame, source: str, exclude=("CustomerID", "Cluster", "Persona", "PC1", "PC2")) -> DataFrame:
    """One text document per persona with the mean of each numeric feature (3 digits), in column order.
    A feature without values reads ``nan``; customers without a persona give no document."""
    cols = [f.name for f in personas.schema.fields
            if f.name not in exclude and isinstance(f.dataType, T.NumericType)]
    means = personas.filter(F.col("Persona").isNotNull()).groupBy("Persona").agg(
        *[F.round(F.avg(c), 3).alias(c) for c in cols])
    entries = [F.concat(F.lit(f"{c}: "), F.coalesce(_plain(F.col(c)), F.lit("nan"))) for c in cols]
    return means.select(
        "Persona",
        F.concat(F.lit("Persona: "), F.col("Persona"), F.lit("\nAverage feature profile: "),
                 F.concat_ws(", ", *entries)).alias("content"),
        F.create_map(F.lit("source"), F.lit(source), F.lit("type"), F.lit("persona_profile"),
                     F.lit("persona"), F.col("Persona")).alias("metadata"))


def persona_summary(spark: SparkSession) -> DataFrame:
    """Cluster, Persona, Description rows."""
    return persona_dim(spark).select("Cluster", "Persona", "Description")


def recommendations_long(spark: SparkSession) -> DataFrame:
    """Persona x recommendation rows with their position."""
    return persona_dim(spark).select(
        "Persona", F.posexplode("Recommendations").alias("rank", "Recommendation"))
