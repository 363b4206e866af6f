"""Customer feature table (A1, A2).

One hash aggregation per customer. Sums, counts, min and max combine
map-side before the shuffle, so a customer holding a third of all lines
ships one partial row per map task. The three exact distinct counts are
rewritten by Catalyst into an Expand + two-level aggregation whose first
shuffle is keyed by (customer, distinct value), which spreads a hot
customer over many tasks instead of collecting its values in one set.

The reference date (latest purchase + 1 day) is a scalar subquery over the
customer aggregate (not a join, and no second pass over the lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import expr as E

FEATURE_COLS = [
    "Recency", "Frequency", "Monetary", "AvgBasketSize",
    "PurchaseInterval", "WeekendRatio", "NightRatio",
    "DiscountUsage", "ReturnRate", "ProductDiversity",
    "CategoryDiversity", "AvgQuantity", "MaxOrderValue", "TotalQty",
]

# Feature names as stored in the feature table (snake_case).
COLUMN_MAP = {
    "Recency": "recency", "Frequency": "frequency", "Monetary": "monetary",
    "AvgBasketSize": "avg_basket_size", "PurchaseInterval": "purchase_interval",
    "WeekendRatio": "weekend_ratio", "NightRatio": "night_ratio",
    "DiscountUsage": "discount_usage", "ReturnRate": "return_rate",
    "ProductDiversity": "product_diversity", "CategoryDiversity": "category_diversity",
    "AvgQuantity": "avg_quantity", "MaxOrderValue": "max_order_value", "TotalQty": "total_qty",
}


def reference_date(tx: DataFrame) -> Column:
    """Latest purchase + 1 day, as a lazy scalar subquery."""
    return tx.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("ref")).scalar()


def with_line_flags(tx: DataFrame) -> DataFrame:
    """E1-E3 on the transaction lines."""
    return tx.withColumns({
        "NetRevenue": E.net_revenue(),
        "IsWeekend": E.is_weekend(),
        "IsNight": E.is_night(),
    })


def customer_aggregates(tx: DataFrame) -> DataFrame:
    """A1: the per-customer measures."""
    lines = with_line_flags(tx)
    return lines.groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("LastPurchase"),
        F.min("InvoiceDate").alias("FirstPurchase"),
        F.count_distinct("InvoiceID").alias("Frequency"),
        F.sum("NetRevenue").alias("Monetary"),
        F.avg("Quantity").alias("AvgQuantity"),
        F.max("NetRevenue").alias("MaxOrderValue"),
        F.sum("Quantity").alias("TotalQty"),
        F.sum("IsWeekend").alias("WeekendOrders"),
        F.sum("IsNight").alias("NightOrders"),
        F.count(F.when(F.col("DiscountPct") > 0, 1)).alias("DiscountOrders"),
        F.sum(F.col("Returned").cast("int")).alias("ReturnCount"),
        F.count_distinct("ProductID").alias("ProductDiversity"),
        F.count_distinct("ProductCategory").alias("CategoryDiversity"),
    ).withColumn("TotalOrders", F.col("Frequency"))


def derived_features(agg: DataFrame, ref: Column) -> DataFrame:
    """A2: recency, basket size, purchase interval and ratios (line counts
    over distinct invoices, so ratios can exceed 1; null where a customer
    has no invoice number)."""
    span_days = E.whole_days("LastPurchase", "FirstPurchase")
    interval = span_days / (F.greatest(F.col("Frequency"), F.lit(2)) - 1)
    return agg.withColumns({
        "Recency": E.whole_days(ref, F.col("LastPurchase")),
        "AvgBasketSize": F.try_divide(F.col("Monetary"), F.col("TotalOrders")),
        "PurchaseInterval": F.greatest(F.coalesce(interval, F.lit(0.0)), F.lit(0.0)),
        "WeekendRatio": F.try_divide(F.col("WeekendOrders"), F.col("TotalOrders")),
        "NightRatio": F.try_divide(F.col("NightOrders"), F.col("TotalOrders")),
        "DiscountUsage": F.try_divide(F.col("DiscountOrders"), F.col("TotalOrders")),
        "ReturnRate": F.try_divide(F.col("ReturnCount"), F.col("TotalOrders")),
    })


OUTPUT_ORDER = [
    "CustomerID", "Recency", "Frequency", "Monetary", "AvgQuantity", "MaxOrderValue", "TotalQty",
    "WeekendOrders", "NightOrders", "DiscountOrders", "ReturnCount", "ProductDiversity",
    "CategoryDiversity", "TotalOrders", "FirstPurchase", "LastPurchase", "AvgBasketSize",
    "PurchaseInterval", "WeekendRatio", "NightRatio", "DiscountUsage", "ReturnRate",
]


def build_customer_features(tx: DataFrame, ref_date=None) -> DataFrame:
    """A1 + A2. ``ref_date`` may be a timestamp literal / Column; default is
    the latest purchase in ``tx`` plus one day."""
    agg = customer_aggregates(tx)
    if ref_date is None:
        # from the customer grain: the subquery shares the aggregation's
        # shuffle stages instead of re-reading and re-joining the lines
        ref = agg.agg((F.max("LastPurchase") + F.expr("INTERVAL 1 DAY")).alias("ref")).scalar()
    elif isinstance(ref_date, Column):
        ref = ref_date
    else:
        ref = F.lit(ref_date).cast("timestamp")
    return derived_features(agg, ref).select(*OUTPUT_ORDER)


def feature_columns_present(df: DataFrame, wanted=FEATURE_COLS) -> list[str]:
    """Dynamic feature list: wanted names present in the frame, in order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
