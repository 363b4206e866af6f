"""Writers (S4, S10, S11) and the synthetic generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table; CSV gets a header row."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


# Generator vocabularies and weights.
PRODUCT_CATEGORIES = ["Grocery", "Books", "Sports", "Electronics", "Home", "Fashion"]
CATEGORY_WEIGHTS = [0.2, 0.25, 0.25, 0.15, 0.1, 0.05]
PAYMENT_METHODS = ["Cash", "NetBanking", "UPI", "Card", "Wallet"]
PRICES = [199, 299, 499, 999, 1499, 2499, 3999, 4999]
DISCOUNTS = [0, 5, 10, 15, 20, 25, 30]
# product number ranges per category: [start, end)
PRODUCT_RANGES = {"Grocery": (900, 999), "Books": (700, 799), "Sports": (500, 599),
                  "Electronics": (300, 399), "Home": (100, 199), "Fashion": (1, 99)}
START = "2024-01-01 00:00:00"
END = "2025-12-31 00:00:00"


def generate_data(spark: SparkSession, n_customers: int = 1000, n_transactions: int = 10000,
                  seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Customers and transactions from seeded hashes of the row number
    (deterministic, generated in parallel by ``range``)."""
    def u(i, salt):  # uniform [0, 1) from (row, salt, seed)
        return (F.abs(F.xxhash64(i, F.lit(salt), F.lit(seed))) % 1_000_003) / 1_000_003.0

    customers = spark.range(1, n_customers + 1).select(
        F.concat(F.lit("C"), (F.col("id") + 1000).cast("string")).alias("customer_id"))
    i = F.col("id")
    cum = 0.0
    cat = None
    for name, w in zip(PRODUCT_CATEGORIES, CATEGORY_WEIGHTS):
        cum += w
        cat = F.when(u(i, 1) < cum, name) if cat is None else cat.when(u(i, 1) < cum, name)
    cat = cat.otherwise(PRODUCT_CATEGORIES[-1])
    lo = F.element_at(F.create_map(*[x for k, (a, _) in PRODUCT_RANGES.items() for x in (F.lit(k), F.lit(a))]), cat)
    hi = F.element_at(F.create_map(*[x for k, (_, b) in PRODUCT_RANGES.items() for x in (F.lit(k), F.lit(b))]), cat)
    span = F.unix_timestamp(F.lit(END)) - F.unix_timestamp(F.lit(START))
    pick = lambda arr, salt: F.element_at(F.array(*[F.lit(v) for v in arr]),
                                          (F.floor(u(i, salt) * len(arr)) + 1).cast("int"))
    tx = spark.range(n_transactions).select(
        F.concat(F.lit("INV"), (i + 100000).cast("string")).alias("invoice_id"),
        F.concat(F.lit("C"), (F.floor(u(i, 2) * n_customers) + 1001).cast("long").cast("string")).alias("customer_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.floor(u(i, 3) * (span + 1))).alias("invoice_date"),
        cat.alias("product_category"),
        F.concat(F.lit("P"), (lo + F.floor(u(i, 4) * (hi - lo))).cast("long").cast("string")).alias("product_id"),
        (F.floor(u(i, 5) * 5) + 1).cast("int").alias("quantity"),
        pick(PRICES, 6).cast("double").alias("unit_price"),
        pick(DISCOUNTS, 7).cast("double").alias("discount_pct"),
        pick(PAYMENT_METHODS, 8).alias("payment_method"),
        (u(i, 9) < 0.2).alias("returned"))
    return customers, tx
