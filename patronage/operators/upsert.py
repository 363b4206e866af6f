"""Table updates by customer.

Both are joins on the customer key followed by ``coalesce``: the result is
a new version of the table, never an in-place row loop; ``upsert_into`` writes
just the rows that change to a keyed table. Counts of inserted and updated rows come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.features import COLUMN_MAP
from patronage.session import stored
from patronage.sources.keyed import KeyedTable


def existing_and_new(current: DataFrame, incoming: DataFrame, key: str = "CustomerID"):
    """(incoming rows whose key exists, incoming rows with a new key)."""
    return (incoming.join(current.select(key), key, "left_semi"),
            incoming.join(current.select(key), key, "left_anti"))


def write_clusters(table: DataFrame, assignments: DataFrame, key: str = "CustomerID",
                   now=None) -> DataFrame:
    """Set cluster and persona (and updated_at) of the customers in
    ``assignments``; other rows are unchanged."""
    now = F.current_timestamp() if now is None else now
    a = assignments.select(F.col(key), F.col("Cluster").alias("__c"), F.col("Persona").alias("__p"),
                           F.lit(True).alias("__hit"))
    j = table.join(a, key, "left")
    out = j.withColumns({
        "cluster": F.when(F.col("__hit"), F.col("__c")).otherwise(F.col("cluster")),
        "persona": F.when(F.col("__hit"), F.col("__p")).otherwise(F.col("persona")),
        "updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at")),
    })
    return out.drop("__c", "__p", "__hit")


def feature_table(features: DataFrame, key: str = "CustomerID", now=None) -> DataFrame:
    """Batch features -> stored feature table (snake_case, nulls -> 0.0)."""
    now = F.current_timestamp() if now is None else now
    return features.select(
        F.col(key).alias("customer_id"),
        *[F.coalesce(F.col(src).cast("double"), F.lit(0.0)).alias(dst) for src, dst in COLUMN_MAP.items()],
        F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("string").alias("persona"),
        now.alias("created_at"), now.alias("updated_at"))


def upsert_features(current: DataFrame, features: DataFrame, now=None):
    """Insert new customers, replace the 14 features of existing ones
    (keeping cluster, persona, created_at); rows only in ``current`` stay.
    Returns (new table, counts DataFrame(inserted, updated))."""
    now = F.current_timestamp() if now is None else now
    inc = feature_table(features, now=now)
    cols = list(COLUMN_MAP.values())
    c = current.alias("c")
    i = inc.alias("i")
    j = c.join(i, F.col("c.customer_id") == F.col("i.customer_id"), "full_outer")
    is_new = F.col("c.customer_id").isNull()
    is_upd = F.col("c.customer_id").isNotNull() & F.col("i.customer_id").isNotNull()
    merged = j.select(
        F.coalesce("c.customer_id", "i.customer_id").alias("customer_id"),
        *[F.when(F.col("i.customer_id").isNotNull(), F.col(f"i.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
          for x in cols],
        F.coalesce("c.cluster", "i.cluster").alias("cluster"), F.coalesce("c.persona", "i.persona").alias("persona"),
        F.coalesce("c.created_at", "i.created_at").alias("created_at"),
        F.when(is_upd | is_new, now).otherwise(F.col("c.updated_at")).alias("updated_at"),
        is_new.alias("__new"), is_upd.alias("__upd"))
    counts = merged.agg(F.count(F.when(F.col("__new"), 1)).alias("inserted"),
                        F.count(F.when(F.col("__upd"), 1)).alias("updated"))
    return merged.drop("__new", "__upd"), counts


def stored_features(spark, folder: str, **sizes) -> KeyedTable:
    """The stored feature table as a keyed table, for ``upsert_into``."""
    schema = ("customer_id string, " + ", ".join(f"{c} double" for c in COLUMN_MAP.values())
              + ", cluster int, persona string, created_at timestamp, updated_at timestamp")
    return KeyedTable(spark, folder, schema, ["customer_id"], **sizes)


def upsert_into(table: KeyedTable, features: DataFrame, version: int, now=None, key: str = "CustomerID") -> DataFrame:
    """S6 in place: as ``upsert_features``, but only buckets that hold incoming customers are
    read and only their rows written, as ``version`` of ``table``. Returns the
    counts (inserted, updated)."""
    incoming = features.select(F.col(key).alias("customer_id"))
    held = table.read(only=table.touched(incoming)).join(incoming, "customer_id", "left_semi")
    merged, counts = upsert_features(held, features, now)
    counts = stored(counts)  # before the table changes under it
    table.write(merged, version)
    return counts
