"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or data Spark derives from them) in
full. Doubles are rounded for the oracle compare: money to 4 digits,
everything else to 6; timestamps are rendered as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.operators import clean as C
from patronage.operators import features as FT
from patronage.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def ts_text(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


MONEY4 = ("Monetary", "MaxOrderValue")


def basket_display(monetary="Monetary", orders="TotalOrders") -> F.Column:
    """Monetary / orders to 4 digits, half up, in exact integer arithmetic.

    Monetary carries at most 4 true decimals, so ``m4`` is exact; rounding
    the quotient as an integer keeps engine-specific float rounding of
    exact ties (m / 2, m / 8, ...) out of the comparison."""
    m4 = F.round(F.col(monetary) * 10000).cast("long")
    n = F.col(orders).cast("long")
    return F.floor((2 * m4 + n) / (2 * n)).cast("double") / 10000


def feature_output(feat: DataFrame) -> DataFrame:
    cols = []
    for c in FT.OUTPUT_ORDER:
        if c in ("FirstPurchase", "LastPurchase"):
            cols.append(ts_text(c).alias(c))
        elif c in MONEY4:
            cols.append(F.round(c, 4).alias(c))
        elif c == "AvgBasketSize":
            cols.append(basket_display().alias(c))
        elif c in ("AvgQuantity", "PurchaseInterval", "WeekendRatio", "NightRatio",
                   "DiscountUsage", "ReturnRate"):
            cols.append(F.round(c, 6).alias(c))
        else:
            cols.append(F.col(c))
    return feat.select(*cols)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_data(S.transactions(spark, sf_dir))


def cleaned_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines written once to the checkpoint folder, in columns, for queries that
    run several statistics over them (instead of re-running scan, joins and
    the whole-row distinct for each)."""
    from patronage.session import stored
    return stored(cleaned(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer features, checkpointed: every query below runs more than
    one job over them."""
    from patronage.session import materialize
    return materialize(FT.build_customer_features(cleaned(spark, sf_dir)))


@register("customer_features")
def q_customer_features(spark, sf_dir):
    """Flagship: view -> clean -> A1 + A2 (one lazy plan)."""
    return feature_output(FT.build_customer_features(cleaned(spark, sf_dir)))


# ---------------------------------------------------------------- shared inputs

from patronage.functions import expr as E  # noqa: E402
from patronage.operators import churn as L  # noqa: E402
from patronage.operators import drift as R  # noqa: E402
from patronage.operators import forecast as FC  # noqa: E402
from patronage.operators import profile as P  # noqa: E402
from patronage.sources import personas as PD  # noqa: E402

TX_NUMERIC = ["Quantity", "UnitPrice", "DiscountPct"]


def price_display(price="UnitPrice", qty="Quantity") -> F.Column:
    """Unit price (a line total in cents over the quantity) to 6 digits,
    half up, in exact integer arithmetic so exact ties (x / 32, ...) round
    the same way in every engine."""
    cents = F.round(F.col(price) * F.col(qty) * 100).cast("long")
    q = F.col(qty).cast("long")
    return F.floor((2 * cents * 10000 + q) / (2 * q)).cast("double") / 1_000_000


def tx_output(df: DataFrame) -> DataFrame:
    """Transaction rows for comparison: date as text, price to 6 digits."""
    return df.select(
        "InvoiceID", "CustomerID", ts_text("InvoiceDate").alias("InvoiceDate"), "ProductCategory",
        "ProductID", "Quantity", price_display().alias("UnitPrice"), "DiscountPct",
        "PaymentMethod", "Returned")


def feat_seg(spark, sf_dir) -> DataFrame:
    """Customer features with the data-given segment and region number."""
    return features(spark, sf_dir).join(S.customer_segments(spark, sf_dir), "CustomerID", "left")


def time_cut(tx: DataFrame) -> F.Column:
    """Midpoint of the purchase period (lazy scalar)."""
    b = tx.agg(F.floor((F.unix_micros(F.min("InvoiceDate")) + F.unix_micros(F.max("InvoiceDate"))) / 2)
               .cast("long").alias("m")).first()
    return F.timestamp_micros(F.lit(b["m"]))


def halves(spark, sf_dir):
    from patronage.session import materialize
    tx = cleaned_m(spark, sf_dir)
    cut = time_cut(tx)
    early = materialize(FT.build_customer_features(tx.filter(F.col("InvoiceDate") < cut)))
    late = materialize(FT.build_customer_features(tx.filter(F.col("InvoiceDate") >= cut)))
    return early, late


def rnd(df: DataFrame, digits: int = 6, money: tuple = (), money_digits: int = 4) -> DataFrame:
    """Round every double column (money columns to ``money_digits``)."""
    out = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            out.append(F.round(name, money_digits if name in money else digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


MONEY_FEATURES = ("Monetary", "MaxOrderValue", "AvgBasketSize", "TotalSales", "Sales", "y",
                  "total_predicted")


# ---------------------------------------------------------------- sources

@register("transactions")
def q_transactions(spark, sf_dir):
    """S2 + W10: ten-column view ordered by invoice date."""
    return tx_output(P.order_by_date(S.transactions(spark, sf_dir)))


@register("tx_count")
def q_tx_count(spark, sf_dir):
    """S3: row count."""
    return S.row_count(S.transactions(spark, sf_dir))


# ---------------------------------------------------------------- cleaning

@register("clean_dedup")
def q_clean_dedup(spark, sf_dir):
    """The view appended to itself, then whole-row distinct."""
    tx = S.transactions(spark, sf_dir)
    return tx_output(C.drop_duplicates(tx.unionByName(tx)))


@register("clean_cancelled")
def q_clean_cancelled(spark, sf_dir):
    """C2."""
    return tx_output(C.drop_cancelled(S.transactions(spark, sf_dir)))


@register("clean_customer")
def q_clean_customer(spark, sf_dir):
    """C3."""
    return tx_output(C.drop_blank_customers(S.transactions(spark, sf_dir)))


@register("clean_quantity")
def q_clean_quantity(spark, sf_dir):
    """C4."""
    return tx_output(C.positive_quantity(S.transactions(spark, sf_dir)))


@register("clean_data")
def q_clean_data(spark, sf_dir):
    """C5."""
    return tx_output(cleaned(spark, sf_dir))


@register("clean_outliers")
def q_clean_outliers(spark, sf_dir):
    """Sequential IQR fences on UnitPrice, Quantity, DiscountPct."""
    return tx_output(C.handle_outliers(cleaned(spark, sf_dir), C.OUTLIER_COLUMNS))


@register("features_fill_zero")
def q_features_fill_zero(spark, sf_dir):
    """Every customer of the dimension with its features, nulls -> 0."""
    cust = S.customer_segments(spark, sf_dir).select("CustomerID")
    f = features(spark, sf_dir).select("CustomerID", *FT.FEATURE_COLS)
    filled = C.fill_zero(cust.join(f, "CustomerID", "left"), FT.FEATURE_COLS)
    filled = filled.withColumn("AvgBasketSize", F.when(F.col("Frequency") > 0, basket_display("Monetary", "Frequency"))
                               .otherwise(F.lit(0.0)))
    return rnd(filled, money=MONEY_FEATURES)


@register("segment_subset")
def q_segment_subset(spark, sf_dir):
    """Rows of one segment, flagged, with its share of customers."""
    fs = feat_seg(spark, sf_dir)
    sub = C.highlight(C.persona_subset(fs, "BUILDING", "Segment"), "BUILDING", "Segment")
    share = fs.agg(F.avg((F.col("Segment") == "BUILDING").cast("double")) * 100).scalar()
    return sub.select("CustomerID", "Segment", "highlight", F.round(share, 6).alias("share_pct"))


# ---------------------------------------------------------------- expressions

@register("line_expressions")
def q_line_expressions(spark, sf_dir):
    """Per line net revenue, weekend / night flags, month start
    and end, weekday, hour, whole days to the reference date, capped qty."""
    tx = cleaned(spark, sf_dir)
    ref = FT.reference_date(tx)
    return tx.select(
        "InvoiceID", "ProductID", "Quantity", F.round(E.net_revenue(), 4).alias("NetRevenue"),
        E.is_weekend().alias("IsWeekend"), E.is_night().alias("IsNight"),
        E.month_start().alias("MonthStart"), E.month_end().alias("MonthEnd"),
        E.day_of_week().alias("DayOfWeek"), E.hour_of_day().alias("Hour"),
        E.whole_days(ref, F.col("InvoiceDate")).alias("DaysToRef"),
        E.clip("Quantity", upper=20).alias("QtyCapped"))


@register("persona_lookup")
def q_persona_lookup(spark, sf_dir):
    """Persona name from a cluster number (region number 0-4 here,
    4 has no persona -> Unknown), broadcast join to the fixed dimension."""
    fs = feat_seg(spark, sf_dir).select("CustomerID", F.col("RegionKey").alias("Cluster"))
    return PD.attach_persona(fs, "Cluster").select("CustomerID", "Cluster", "Persona")


@register("feature_hash")
def q_feature_hash(spark, sf_dir):
    """Change key per customer from the sorted feature values (text form)."""
    f = features(spark, sf_dir)
    cols = sorted(["Recency", "Frequency", "TotalQty", "ProductDiversity", "CategoryDiversity"])
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return f.select("CustomerID", F.substring(F.sha2(text, 256), 1, 16).alias("feature_hash"))


@register("friendly_sources")
def q_friendly_sources(spark, sf_dir):
    """Labels for every document source and page url."""
    docs = S.read_table(spark, sf_dir, "documents").select(F.col("source").alias("src"))
    pages = S.read_table(spark, sf_dir, "pages").select(F.col("url").alias("src"))
    srcs = docs.unionByName(pages).distinct()
    return srcs.select("src", E.friendly_source("src").alias("label"))


@register("segment_profile_norm")
def q_segment_profile_norm(spark, sf_dir):
    """A3 + E12: mean features per segment, min-max normalised over segments."""
    prof = P.cluster_profiles(feat_seg(spark, sf_dir), FT.FEATURE_COLS, "Segment")
    long = prof.unpivot(["Segment"], FT.FEATURE_COLS, "feature", "mean")
    rng = long.groupBy("feature").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    out = long.join(F.broadcast(rng), "feature")
    return out.select("Segment", "feature", F.round("mean", 4).alias("mean"),
                      F.round(E.minmax_norm("mean", F.col("lo"), F.col("hi")), 6).alias("norm"))


@register("recency_dates")
def q_recency_dates(spark, sf_dir):
    """Approximate last purchase date from Recency and a stated date."""
    tx = cleaned(spark, sf_dir)
    ref = F.to_date(FT.reference_date(tx))
    f = FT.build_customer_features(tx)
    return f.select("CustomerID", "Recency", E.recency_date("Recency", ref).alias("approx_last_purchase"))


# ---------------------------------------------------------------- aggregations

@register("segment_profiles")
def q_segment_profiles(spark, sf_dir):
    """A3: mean of each feature by segment."""
    return rnd(P.cluster_profiles(feat_seg(spark, sf_dir), FT.FEATURE_COLS, "Segment"), money=MONEY_FEATURES)


@register("payment_counts")
def q_payment_counts(spark, sf_dir):
    """A4: lines per payment method, descending."""
    return P.value_counts(cleaned(spark, sf_dir), "PaymentMethod")


@register("category_counts")
def q_category_counts(spark, sf_dir):
    """A4: lines per category."""
    return P.value_counts(cleaned(spark, sf_dir), "ProductCategory")


@register("returned_counts")
def q_returned_counts(spark, sf_dir):
    """A4: lines per returned flag."""
    return P.value_counts(cleaned(spark, sf_dir), "Returned")


@register("segment_counts")
def q_segment_counts(spark, sf_dir):
    """A4 + W9: customers per segment with their share."""
    vc = P.value_counts(feat_seg(spark, sf_dir), "Segment")
    return rnd(P.share_of_total(vc, "count", "share_pct"))


@register("overview")
def q_overview(spark, sf_dir):
    """A5: customers, features, clusters (regions), personas (segments)."""
    return P.overview(feat_seg(spark, sf_dir), FT.FEATURE_COLS, "RegionKey", "Segment")


@register("null_counts")
def q_null_counts(spark, sf_dir):
    """Nulls per column of the raw view."""
    return P.null_counts(S.transactions(spark, sf_dir))


@register("data_quality")
def q_data_quality(spark, sf_dir):
    """Duplicates, distinct ids, bad quantities, cancelled invoices."""
    return P.data_quality(S.transactions(spark, sf_dir))


@register("describe_lines")
def q_describe_lines(spark, sf_dir):
    """Numeric summary of the cleaned lines."""
    return rnd(P.describe(cleaned_m(spark, sf_dir), TX_NUMERIC), 4)


@register("describe_features")
def q_describe_features(spark, sf_dir):
    """Numeric summary of the customer features."""
    return rnd(P.describe(features(spark, sf_dir), FT.FEATURE_COLS), 4)


@register("describe_text")
def q_describe_text(spark, sf_dir):
    """Count / unique / top / freq of the text columns."""
    tx = cleaned(spark, sf_dir)
    parts = [P.describe_strings(tx, c) for c in ("ProductCategory", "PaymentMethod", "ProductID", "CustomerID")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("customer_totals")
def q_customer_totals(spark, sf_dir):
    """A8 + E13: EDA totals per customer, order count capped at 20."""
    t = P.customer_totals(cleaned(spark, sf_dir))
    t = t.withColumn("OrderCountCapped", E.clip("OrderCount", upper=20))
    return rnd(t, money=("TotalSales",))


@register("histograms")
def q_histograms(spark, sf_dir):
    """Quantity and UnitPrice in 20 bins, DiscountPct in 15."""
    tx = cleaned_m(spark, sf_dir)
    parts = [P.histogram(tx, c, b).withColumn("column", F.lit(c))
             for c, b in (("Quantity", 20), ("UnitPrice", 20), ("DiscountPct", 15))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rnd(out)


@register("box_summaries")
def q_box_summaries(spark, sf_dir):
    """A10: five-number summary and outlier count per column."""
    tx = cleaned_m(spark, sf_dir)
    parts = [P.box_summary(tx, c) for c in TX_NUMERIC]
    return rnd(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@register("correlation_lines")
def q_correlation_lines(spark, sf_dir):
    """Pearson matrix of the numeric line columns."""
    return rnd(P.correlation_matrix(cleaned(spark, sf_dir), TX_NUMERIC))


@register("correlation_features")
def q_correlation_features(spark, sf_dir):
    """Pearson matrix of the 14 features."""
    return rnd(P.correlation_matrix(features(spark, sf_dir), FT.FEATURE_COLS))


@register("orders_by_weekday")
def q_orders_by_weekday(spark, sf_dir):
    """Lines per weekday, zero filled."""
    return P.orders_by_weekday(cleaned(spark, sf_dir))


@register("orders_by_hour")
def q_orders_by_hour(spark, sf_dir):
    """Lines per hour."""
    return P.orders_by_hour(cleaned(spark, sf_dir))


@register("monthly_sales")
def q_monthly_sales(spark, sf_dir):
    """Sales and distinct orders per month."""
    return rnd(P.monthly_sales(cleaned(spark, sf_dir)), money=("Sales",))


def tx_segment(spark, sf_dir) -> DataFrame:
    """Lines with the customer's segment (left join; missing -> null)."""
    seg = S.customer_segments(spark, sf_dir).select("CustomerID", "Segment")
    return cleaned(spark, sf_dir).join(seg, "CustomerID", "left")


@register("tx_segment")
def q_tx_segment(spark, sf_dir):
    """Every cleaned line with its customer's segment."""
    return tx_segment(spark, sf_dir).select("InvoiceID", "CustomerID", "ProductID", "Quantity", "Segment")


@register("monthly_segment_revenue")
def q_monthly_segment_revenue(spark, sf_dir):
    """A14 + E6: monthly revenue per segment, zero filled, > 3 months."""
    return rnd(P.monthly_by_group(tx_segment(spark, sf_dir), "Segment"), money=("y",))


@register("headline")
def q_headline(spark, sf_dir):
    """Headline figures of the raw view."""
    h = P.headline(S.transactions(spark, sf_dir))
    return rnd(h.withColumn("first_date", ts_text("first_date")).withColumn("last_date", ts_text("last_date")))


@register("churn_labels")
def q_churn_labels(spark, sf_dir):
    """L1: churn label per customer."""
    return L.prepare_churn_labels(features(spark, sf_dir)).select("CustomerID", "Recency", "Frequency", "ChurnLabel")


@register("churn_share")
def q_churn_share(spark, sf_dir):
    """Share of churn labels."""
    return rnd(P.label_share(L.prepare_churn_labels(features(spark, sf_dir))))


@register("recency_ranking_metrics")
def q_recency_ranking_metrics(spark, sf_dir):
    """L4 + L5: ROC-AUC and average precision of Recency as a churn score."""
    lab = L.prepare_churn_labels(features(spark, sf_dir))
    scored = lab.select(F.col("ChurnLabel").alias("label"), F.col("Recency").cast("double").alias("score"))
    return rnd(L.ranking_metrics(scored))


@register("segment_forecast")
def q_segment_forecast(spark, sf_dir):
    """F1 + F3: linear forecast of monthly revenue per segment."""
    return FC.forecast_all(tx_segment(spark, sf_dir), "Segment")


@register("segment_forecast_tail")
def q_segment_forecast_tail(spark, sf_dir):
    """Last 3 months of each segment's series."""
    series = P.monthly_by_group(tx_segment(spark, sf_dir), "Segment")
    return rnd(P.tail_per_group(series, "Segment", "ds", 3), money=("y",))


@register("forecast_summary")
def q_forecast_summary(spark, sf_dir):
    """Total predicted, first lower, last upper per segment."""
    return rnd(P.forecast_summary(FC.forecast_all(tx_segment(spark, sf_dir), "Segment"), "Segment"), 2)


@register("top_products")
def q_top_products(spark, sf_dir):
    """Top 10 products by summed price (ties by id)."""
    return rnd(P.top_n(cleaned(spark, sf_dir), "ProductID", "UnitPrice", 10), 4)


@register("category_sales")
def q_category_sales(spark, sf_dir):
    """Categories by summed price."""
    tx = cleaned(spark, sf_dir)
    return rnd(tx.groupBy("ProductCategory").agg(F.sum("UnitPrice").alias("sum_UnitPrice")), 4)


@register("head_lines")
def q_head_lines(spark, sf_dir):
    """First 10 lines in a full order."""
    tx = tx_output(cleaned(spark, sf_dir))
    return P.head(tx, ["InvoiceDate", "InvoiceID", "ProductID", "Quantity", "UnitPrice", "DiscountPct",
                       "Returned"], 10)


# ---------------------------------------------------------------- drift

@register("drift_features")
def q_drift_features(spark, sf_dir):
    """Drift per feature between customers' early and late halves."""
    early, late = halves(spark, sf_dir)
    return R.detect_drift(early, late, FT.FEATURE_COLS)


@register("drift_overall")
def q_drift_overall(spark, sf_dir):
    """Overall drift row."""
    early, late = halves(spark, sf_dir)
    return R.drift_overall(R.detect_drift(early, late, FT.FEATURE_COLS))


# ---------------------------------------------------------------- persona dimension

@register("persona_summary")
def q_persona_summary(spark, sf_dir):
    """Cluster, Persona, Description export, every customer region
    counted against it (regions without a persona are left out)."""
    fs = feat_seg(spark, sf_dir).groupBy(F.col("RegionKey").alias("Cluster")).agg(F.count(F.lit(1)).alias("n"))
    return PD.persona_summary(spark).join(fs, "Cluster", "left")


@register("persona_recommendations")
def q_persona_recommendations(spark, sf_dir):
    """Persona x recommendation rows with each region's customer count."""
    fs = PD.attach_persona(feat_seg(spark, sf_dir).select(F.col("RegionKey").alias("Cluster")), "Cluster")
    counts = fs.groupBy("Persona").agg(F.count(F.lit(1)).alias("n_customers"))
    return PD.recommendations_long(spark).join(counts, "Persona", "left")


# ---------------------------------------------------------------- retrieval

from patronage.operators import retrieve as T  # noqa: E402


@register("document_chunks")
def q_document_chunks(spark, sf_dir):
    """1000-character windows with 200 overlap over every whole document."""
    docs = S.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    ch = T.chunk_documents(docs, "text")
    return ch.select("doc_id", "chunk_no", "source", "lang", F.length("content").alias("n_chars"),
                     F.md5("content").alias("content_md5"))


@register("label_centroid_neighbours")
def q_label_centroid_neighbours(spark, sf_dir):
    """The 20 stored vectors closest (cosine) to each label's centroid."""
    vecs = S.read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    cent = T.label_centroids(vecs, "label", "embedding")
    top = T.nearest(vecs, cent, 20, id_col="vec_id", qid_col="label")
    return top.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _index_search(spark, sf_dir):
    from patronage.operators.vector_index import VectorIndex
    vecs = S.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vecs.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "qid")
    index = VectorIndex(vecs, "vec_id")
    probes = index.probes_for(0.95, T.FETCH_K)
    return vecs, asked, index.search(asked, T.FETCH_K, probes, id_col="vec_id")


@register("vector_index_search")
def q_vector_index_search(spark, sf_dir):
    """The 20 stored vectors closest (cosine) to every hundredth one, with as many
    probes as a sample of the index needs for 0.95 of its answers."""
    return rnd(_index_search(spark, sf_dir)[2])


@register("vector_index_recall")
def q_vector_index_recall(spark, sf_dir):
    """Whether the index finds at least nine tenths of the exact answers."""
    from patronage.operators.vector_index import recall
    vecs, asked, found = _index_search(spark, sf_dir)
    exact = T.nearest(vecs, asked, T.FETCH_K, id_col="vec_id")
    return recall(found, exact).select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


def retrieval_hits(spark, sf_dir):
    """Benchmark items as questions over the document chunks."""
    docs = S.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # numbered in order of document and chunk, whatever their number
    chunks = positions(T.chunk_documents(docs, "text"), "doc_id", "chunk_no", out="chunk_id")
    model = T.fit_embedder(chunks, "content")
    cvec = T.embed(model, chunks)
    bench = S.read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                           F.col("text").alias("content"))
    qvec = T.embed(model, bench)
    top = T.nearest(cvec, qvec, T.FETCH_K, id_col="chunk_id", qid_col="qid")
    cand = top.join(cvec.select("chunk_id", "embedding", "source", "doc_id"), "chunk_id")
    picked = T.mmr(cand.select("qid", "chunk_id", "embedding"), qvec, T.MMR_K, T.MMR_LAMBDA, "chunk_id", "qid")
    return picked.join(cand.select("qid", "chunk_id", "source", "doc_id"), ["qid", "chunk_id"])


@register("benchmark_retrieval")
def q_benchmark_retrieval(spark, sf_dir):
    """Top-20 by TF-IDF cosine, MMR to 6 per benchmark question."""
    return retrieval_hits(spark, sf_dir).select("qid", "mmr_rank", "chunk_id", "doc_id",
                                                F.round("relevance", 6).alias("relevance"))


@register("benchmark_sources")
def q_benchmark_sources(spark, sf_dir):
    """T5: cited source labels per benchmark question."""
    return T.cited_sources(retrieval_hits(spark, sf_dir), "qid", "source")


# ---------------------------------------------------------------- scaling, selection, clusters

from patronage.operators import anomaly as N  # noqa: E402
from patronage.operators import cluster as K  # noqa: E402
from patronage.operators import evaluate as V  # noqa: E402
from patronage.operators import explain as X  # noqa: E402
from patronage.operators.neighbours import positions  # noqa: E402
from patronage.operators import prep as M  # noqa: E402
from patronage.operators import upsert as U  # noqa: E402
from patronage.streaming import transactions as ST  # noqa: E402


def scaled_regions(spark, sf_dir) -> DataFrame:
    """Standard-scaled 14 features with the customer's region number."""
    fs = feat_seg(spark, sf_dir).select("CustomerID", "RegionKey", *FT.FEATURE_COLS)
    return M.standard_scale(fs, FT.FEATURE_COLS)


@register("scaled_features")
def q_scaled_features(spark, sf_dir):
    """M1: (x - mean) / population std of the 14 features."""
    return rnd(M.standard_scale(features(spark, sf_dir).select("CustomerID", *FT.FEATURE_COLS), FT.FEATURE_COLS))


@register("robust_scaled_features")
def q_robust_scaled_features(spark, sf_dir):
    """M2: (x - median) / IQR of the 14 features."""
    return rnd(M.robust_scale(features(spark, sf_dir).select("CustomerID", *FT.FEATURE_COLS), FT.FEATURE_COLS))


@register("correlated_drop")
def q_correlated_drop(spark, sf_dir):
    """M3: features dropped by the 0.85 correlation rule on scaled features."""
    sc = M.standard_scale(features(spark, sf_dir).select(*FT.FEATURE_COLS), FT.FEATURE_COLS)
    return M.correlation_drop(sc, FT.FEATURE_COLS)


@register("variance_selection")
def q_variance_selection(spark, sf_dir):
    """M4: population variance per feature and the 0.01 threshold decision."""
    v = M.variance_select(features(spark, sf_dir), FT.FEATURE_COLS)
    return v.select("feature", F.format_string("%.9e", "variance").alias("variance"), "kept")


@register("final_features")
def q_final_features(spark, sf_dir):
    """M5: the selected feature list."""
    sc = M.standard_scale(features(spark, sf_dir).select(*FT.FEATURE_COLS), FT.FEATURE_COLS)
    return M.final_features_df(M.correlation_drop(sc, FT.FEATURE_COLS), FT.FEATURE_COLS)


@register("silhouette_regions")
def q_silhouette_regions(spark, sf_dir):
    """Exact Euclidean silhouette per customer of the region grouping
    on the scaled features."""
    sc = scaled_regions(spark, sf_dir)
    return rnd(V.silhouette_samples(sc, FT.FEATURE_COLS, "RegionKey").select("CustomerID", "RegionKey", "silhouette"))


@register("davies_bouldin_regions")
def q_davies_bouldin_regions(spark, sf_dir):
    """Davies-Bouldin index of the region grouping."""
    v = V.davies_bouldin(scaled_regions(spark, sf_dir), FT.FEATURE_COLS, "RegionKey")
    return spark.range(1).select(F.round(F.lit(v), 6).alias("davies_bouldin"))


@register("intra_inter_regions")
def q_intra_inter_regions(spark, sf_dir):
    """Mean positive within-region distance per region and the mean
    cross-region distance."""
    r = V.intra_inter_distances(scaled_regions(spark, sf_dir), FT.FEATURE_COLS, "RegionKey")
    rows = [(i, float(round(v, 6))) for i, v in enumerate(r["intra"])]
    intra = spark.createDataFrame(rows, "pos int, intra double")
    return intra.withColumn("inter_mean", F.round(F.lit(r["inter_mean"]), 6))


@register("ari_region_segment")
def q_ari_region_segment(spark, sf_dir):
    """Adjusted Rand index between the region and segment labelings."""
    return rnd(V.adjusted_rand(feat_seg(spark, sf_dir), "RegionKey", "Segment"))


@register("persona_assignment")
def q_persona_assignment(spark, sf_dir):
    """K1 + K5 + E8: best-of-10 KMeans (k=4) on the selected scaled
    features, clusters renumbered by Monetary, persona names."""
    from patronage.plans import training as TR
    from patronage.session import materialize
    feats = materialize(TR.prepare(S.transactions(spark, sf_dir)))
    res = TR.train_personas(feats, compare=False)
    return res["personas"].select("CustomerID", "Cluster", "Persona", F.round("PC1", 6).alias("PC1"),
                                  F.round("PC2", 6).alias("PC2"))


@register("model_round_trip")
def q_model_round_trip(spark, sf_dir):
    """S12 + K5: the persona model saved, loaded and applied again: whether each
    customer's cluster and persona are those of the training run."""
    from patronage.plans import training as TR
    from patronage.session import materialize
    feats = materialize(TR.prepare(S.transactions(spark, sf_dir), outliers=False))
    res = TR.train_personas(feats, n_init=2, compare=False)
    path = _scratch(spark, "model")
    TR.save_model(res["model"], path)
    again = TR.predict_personas(TR.load_model(path), feats)
    first = res["personas"].select("CustomerID", F.col("Cluster").alias("c"), F.col("Persona").alias("p"))
    return again.join(first, "CustomerID", "full").select(
        "CustomerID", (F.col("Cluster").eqNullSafe(F.col("c")) & F.col("Persona").eqNullSafe(F.col("p"))).alias("same"))


@register("neighbour_counts")
def q_neighbour_counts(spark, sf_dir):
    """Customers within 1.5 of each customer on the scaled features, itself included."""
    sc = scaled_regions(spark, sf_dir).withColumn("id", F.col("CustomerID").cast("long"))
    return K.neighbour_counts(sc, FT.FEATURE_COLS, K.DBSCAN_EPS, "id")


@register("dbscan_customers")
def q_dbscan_customers(spark, sf_dir):
    """K6: DBSCAN (eps 1.5, min_samples 5) on the scaled features."""
    sc = scaled_regions(spark, sf_dir).withColumn("id", F.col("CustomerID").cast("long"))
    return K.dbscan(sc, FT.FEATURE_COLS, K.DBSCAN_EPS, K.DBSCAN_MIN_SAMPLES, "id")


@register("k_distance_customers")
def q_k_distance_customers(spark, sf_dir):
    """K8 + W4: sorted 5-NN distances on the scaled features."""
    sc = scaled_regions(spark, sf_dir).withColumn("id", F.col("CustomerID").cast("long"))
    return rnd(K.k_distance_graph(sc, FT.FEATURE_COLS, 5, "id"))


def scaled_points(spark, sf_dir) -> DataFrame:
    """Scaled features written once, for grids that scan them many times."""
    from patronage.session import stored
    return stored(scaled_regions(spark, sf_dir).select("CustomerID", *FT.FEATURE_COLS))


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf_dir):
    """K2 + K3: inertia and silhouette of the best of 10 starts for k = 2 .. 10, and the k of the highest silhouette."""
    best, table = K.kmeans_optimal_k(scaled_points(spark, sf_dir), FT.FEATURE_COLS)
    return table.withColumn("best", F.col("k") == F.lit(best))


@register("kmeans_invariants")
def q_kmeans_invariants(spark, sf_dir):
    """K1-K3: per k of the grid the customers, those nearer to another centre than to their
    own, whether the label counts and distances give the model's inertia, and rounds in which the cost rose."""
    from patronage.operators import lloyd as LL
    points = LL.vectors(scaled_points(spark, sf_dir), FT.FEATURE_COLS, ["CustomerID"])
    models = LL.best_starts(LL.fit_many(points, [LL.Spec(k, i) for k in range(2, 11) for i in range(10)]))
    labelled = LL.assign(points, models)
    rows = [(j, m.spec.k, m.inertia, sum(b > a * (1 + 1e-12) for a, b in zip(m.costs, m.costs[1:])), m.centers.tolist())
            for j, m in enumerate(models)]
    # nine rows: one a model
    fitted = spark.createDataFrame(rows, "m int, k int, inertia double, cost_rises int, centers array<array<double>>")
    gap = F.transform("centers", lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)),
                                                       F.lit(0.0), lambda s, x: s + x))
    per = (labelled.select("CustomerID", "v", F.posexplode("labels").alias("m", "label")).join(F.broadcast(fitted), "m")
                   .withColumn("gaps", gap).withColumn("own", F.col("gaps")[F.col("label")]))
    out = per.groupBy("k").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count(F.when(F.col("own") > F.array_min("gaps") + 1e-9, 1)).alias("misplaced"),
        (F.abs(F.sum("own") - F.first("inertia")) <= 1e-6 * F.first("inertia")).alias("inertia_holds"),
        F.first("cost_rises").alias("cost_rises"), F.count_distinct("label").alias("clusters"))
    return out


@register("kmeans_methods")
def q_kmeans_methods(spark, sf_dir):
    """K4: KMeans on the components, on the features and with the best k, by silhouette."""
    sc = scaled_points(spark, sf_dir)
    model, _, n, signs = M.fit_pca(sc, FT.FEATURE_COLS)
    proj = M.pca_project(model, sc, n, signs)
    table, best = K.compare_methods(proj, FT.FEATURE_COLS, [f"PC{i + 1}" for i in range(n)])
    return table.withColumn("best", F.col("method") == F.lit(best and best["method"]))


@register("kmeans_tuning")
def q_kmeans_tuning(spark, sf_dir):
    """K9: silhouettes over k and initialisation."""
    return K.tune_kmeans(scaled_points(spark, sf_dir), FT.FEATURE_COLS)


@register("pca_tuning")
def q_pca_tuning(spark, sf_dir):
    """Silhouettes over the number of components and k."""
    return K.tune_pca(scaled_points(spark, sf_dir), FT.FEATURE_COLS)


@register("dbscan_tuning")
def q_dbscan_tuning(spark, sf_dir):
    """Silhouettes over eps {1.0, 2.0} and min_samples {3, 10}."""
    sc = scaled_points(spark, sf_dir).withColumn("id", F.col("CustomerID").cast("long"))
    return K.tune_dbscan(sc, FT.FEATURE_COLS, [1.0, 2.0], [3, 10], "id")


@register("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    """N1 + N2: isolation forest (200 trees, 5 %) over the customer features."""
    f = features(spark, sf_dir)
    model, _ = N.fit_isolation_forest(f, FT.FEATURE_COLS)
    return N.decision(model, f)


@register("anomaly_summary")
def q_anomaly_summary(spark, sf_dir):
    """Checked, found, rate."""
    f = features(spark, sf_dir)
    _, summary = N.fit_isolation_forest(f, FT.FEATURE_COLS)
    return summary


@register("anomaly_model_round_trip")
def q_anomaly_model_round_trip(spark, sf_dir):
    """The isolation forest saved, loaded and applied as a stage: whether each customer's
    scores are those of the training run."""
    f = features(spark, sf_dir)
    fitted, _ = N.fit_isolation_forest(f, FT.FEATURE_COLS)
    path = _scratch(spark, "forest")
    N.IsolationForestModel(fitted).write().overwrite().save(path)
    again = N.IsolationForestModel.load(path).transform(f.select("CustomerID", *FT.FEATURE_COLS))
    first = N.decision(fitted, f).withColumnsRenamed({"anomaly_score": "s", "is_anomaly": "a", "reconstruction_error": "e"})
    return again.join(first, again["CustomerID"] == first["customer_id"], "full").select("CustomerID", (
        F.col("s").eqNullSafe(F.col("anomaly_score")) & F.col("a").eqNullSafe(F.col("is_anomaly"))
        & F.col("e").eqNullSafe(F.col("reconstruction_error"))).alias("same"))


@register("churn_model_round_trip")
def q_churn_model_round_trip(spark, sf_dir):
    """L3 + L7: the churn forest trained and stored where there is none, read on the next call:
    whether each customer's probability is the same."""
    f = features(spark, sf_dir)
    path = _scratch(spark, "churn")
    first = L.predict_churn(*swap(L.ensure_churn_model(path, f), f)).select("customer_id", F.col("churn_probability").alias("p"))
    again = L.predict_churn(*swap(L.ensure_churn_model(path, f), f))
    return again.join(first, "customer_id", "full").select(
        F.col("customer_id").alias("CustomerID"), F.col("p").eqNullSafe(F.col("churn_probability")).alias("same"))


def swap(stored_model, f):
    model, cols = stored_model
    return model, f, cols


@register("drift_baseline_fallback")
def q_drift_baseline_fallback(spark, sf_dir):
    """No baseline is stored, so that of the stored persona table is taken and kept."""
    from patronage.sources.sinks import write_table
    base, personas = _scratch(spark, "baseline"), _scratch(spark, "personas")
    write_table(PD.attach_persona(feat_seg(spark, sf_dir).withColumn("Cluster", F.col("RegionKey"))), personas)
    R.load_baseline(spark, base, personas)
    got = R.load_baseline(spark, base)
    return got.select("CustomerID", "Recency", "Frequency", "TotalQty", F.round("Monetary", 4).alias("Monetary"))


@register("persona_profile_documents")
def q_persona_profile_documents(spark, sf_dir):
    """A document per persona (by region number) with its mean features."""
    named = PD.attach_persona(feat_seg(spark, sf_dir).withColumn("Cluster", F.col("RegionKey")))
    docs = PD.profile_documents(named.select("Persona", *PROFILE_FEATURES), "customer_personas")
    return docs.select("Persona", "content", F.col("metadata")["type"].alias("type"))


@register("separator_chunks")
def q_separator_chunks(spark, sf_dir):
    """Chunks at paragraph, line and word borders over every whole document."""
    return T.chunk_by_separators(S.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("separator_chunk_cover")
def q_separator_chunk_cover(spark, sf_dir):
    """What the chunks of a document add to each other, without white space, hashed; the longest chunk fits."""
    chunks = T.chunk_by_separators(S.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    end = F.col("chunk_start") + F.length("content")
    fresh = F.expr("substring(content, greatest(before - chunk_start, 0) + 1)")
    return (chunks.withColumn("before", F.coalesce(F.lag(end).over(w), F.lit(0)))
                  .groupBy("doc_id").agg(
                      F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                          "chunk_no", F.regexp_replace(fresh, "[ \\t\\r\\n]", "").alias("f")))),
                          lambda x: x["f"]), "")).alias("text_md5"),
                      (F.max(F.length("content")) <= T.CHUNK_SIZE).alias("fits")))


@register("kafka_records")
def q_kafka_records(spark, sf_dir):
    """ST1: cleaned lines as Kafka (key, value) records."""
    return ST.kafka_records(ST.to_messages(cleaned(spark, sf_dir)))


def _stored(spark, sf_dir):
    """The stored table of the early half, the features of the whole period, and the time of the update. Both come
    from lines that are cleaned once, and hold only the columns that a query asks for."""
    ref = F.lit("2001-09-01 00:00:00").cast("timestamp")
    tx = cleaned_m(spark, sf_dir)
    early = FT.build_customer_features(tx.filter(F.col("InvoiceDate") < time_cut(tx)))
    return U.feature_table(early, now=F.lit(None).cast("timestamp")), FT.build_customer_features(tx), ref


@register("write_clusters")
def q_write_clusters(spark, sf_dir):
    """The stored feature table (early half) updated with cluster
    numbers (regions) and persona names of all current customers."""
    table, current, ref = _stored(spark, sf_dir)
    regions = current.join(S.customer_segments(spark, sf_dir), "CustomerID", "left")
    assign = PD.attach_persona(regions.select(F.col("CustomerID").alias("customer_id"),
                                              F.col("RegionKey").alias("Cluster")), "Cluster")
    out = U.write_clusters(table, assign, key="customer_id", now=ref)
    return out.select("customer_id", "cluster", "persona", ts_text("updated_at").alias("updated_at"))


@register("upsert_counts")
def q_upsert_counts(spark, sf_dir):
    """Inserted and updated customers when the full-period
    features are stored over the early-half table."""
    from patronage.session import stored
    table, current, ref = _stored(spark, sf_dir)
    merged, counts = U.upsert_features(stored(table), stored(current), now=ref)
    return counts.withColumn("total", F.lit(merged.count()).cast("long"))


# ---------------------------------------------------------------- texts, models, stream

PROFILE_FEATURES = ["AvgQuantity", "DiscountUsage", "Frequency", "NightRatio", "Recency", "ReturnRate",
                    "WeekendRatio"]


def region_profiles(spark, sf_dir) -> DataFrame:
    """Cluster (region number) -> map of mean features (3 digits), with the
    persona dimension attached (Unknown outside the map)."""
    fs = feat_seg(spark, sf_dir)
    prof = fs.groupBy(F.col("RegionKey").alias("Cluster")).agg(
        *[F.round(F.avg(c), 3).alias(c) for c in PROFILE_FEATURES])
    prof = prof.select("Cluster", F.create_map(*[x for c in PROFILE_FEATURES for x in (F.lit(c), F.col(c))])
                       .alias("profile"))
    return PD.attach_persona(prof, "Cluster", keep_details=True)


@register("persona_narratives")
def q_persona_narratives(spark, sf_dir):
    """Rule-based narrative per cluster with its first six profile entries."""
    p = region_profiles(spark, sf_dir)
    return p.select("Cluster", "Persona", E.narrative_text("Persona", "Description", "Recommendations", "profile", 6)
                    .alias("narrative"))


@register("persona_prompts")
def q_persona_prompts(spark, sf_dir):
    """Narrative prompt per cluster with the whole profile sorted by key."""
    p = region_profiles(spark, sf_dir)
    return p.select("Cluster", E.prompt_text("Persona", "profile").alias("prompt"))


@register("churn_model")
def q_churn_model(spark, sf_dir):
    """Class-weighted forest (200 trees, depth 8, leaf 10) on
    the default churn columns; per-customer probability, band, top factors."""
    f = features(spark, sf_dir)
    model, _, _, _, cols = L.train_churn_model(f)
    return L.predict_churn(model, f, cols)


@register("churn_model_metrics")
def q_churn_model_metrics(spark, sf_dir):
    """L4 + L5 + A16 on the held-out split of the churn forest."""
    f = features(spark, sf_dir)
    _, metrics, rates, _, _ = L.train_churn_model(f)
    r = rates.first()
    return metrics.select("*", F.lit(r["churn_rate"]).alias("churn_rate"), F.lit(r["n_train"]).alias("n_train"),
                          F.lit(r["n_test"]).alias("n_test"))


@register("persona_explanations")
def q_persona_explanations(spark, sf_dir):
    """Exact Shapley contributions of each selected feature to the
    predicted cluster number, background = 100 hashed-sample customers;
    the model and the customers are those of ``persona_assignment``."""
    from patronage.plans import training as TR
    from patronage.session import materialize
    feats = materialize(TR.prepare(S.transactions(spark, sf_dir)))
    res = TR.train_personas(feats, compare=False)
    sel = res["features"]
    idx = [res["scale_cols"].index(c) for c in sel]
    mean = [res["means"][i] for i in idx]
    scale = [res["scales"][i] for i in idx]
    import numpy as np
    centers = np.array(res["centers"])
    return X.explain(feats, sel, mean, scale, centers, feats)


@register("seasonal_forecast")
def q_seasonal_forecast(spark, sf_dir):
    """trend + yearly seasonality per segment (grouped pandas fit)."""
    series = P.monthly_by_group(tx_segment(spark, sf_dir), "Segment")
    return FC.seasonal_forecast(series, "Segment")


@register("pca_scree")
def q_pca_scree(spark, sf_dir):
    """M6 + M8 + W5: explained-variance ratio per component of the selected
    scaled features, running total, and the number kept for 95 %."""
    f = features(spark, sf_dir).select("CustomerID", *FT.FEATURE_COLS)
    sc = M.standard_scale(f, FT.FEATURE_COLS)
    kept = M.final_features_df(M.correlation_drop(sc, FT.FEATURE_COLS), FT.FEATURE_COLS)
    final = [r["feature"] for r in kept.orderBy("feature").collect()]
    _, ratios, k, _ = M.fit_pca(sc, final)
    return M.scree_table(spark, ratios).withColumn("kept", F.col("component") <= k)


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    """M7: 2-D display projection of the scaled features."""
    f = features(spark, sf_dir).select("CustomerID", *FT.FEATURE_COLS)
    sc = M.standard_scale(f, FT.FEATURE_COLS)
    return M.projection_2d(sc, FT.FEATURE_COLS).select("CustomerID", "PC1", "PC2")


@register("dbscan_grid")
def q_dbscan_grid(spark, sf_dir):
    """K7: clusters and noise for eps in {1.0, 1.5, 2.0} x min_samples {3, 5, 10}."""
    sc = scaled_regions(spark, sf_dir).withColumn("id", F.col("CustomerID").cast("long"))
    return K.dbscan_tune(sc, FT.FEATURE_COLS, [1.0, 1.5, 2.0], [3, 5, 10], "id")


@register("stream_refresh")
def q_stream_refresh(spark, sf_dir):
    """ST2-ST4: the raw lines, with repeats of some of them, replayed as a JSON
    message stream through the foreachBatch refresher, which cleans them and
    drops the repeats; returns the features from the final state."""
    import uuid
    from patronage.session import scratch_path
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    raw = S.transactions(spark, sf_dir)
    # messages repeat all names in every line: compressed they are a fraction
    ST.to_messages(raw).write.option("compression", "gzip").json(f"{base}/in")
    ST.to_messages(raw.filter(F.pmod(F.col("CustomerID").cast("long"), F.lit(10)) == 0)).write.mode("append").option(
        "compression", "gzip").json(f"{base}/in")
    stream = ST.read_folder(spark, f"{base}/in", ST.files_a_batch(spark, f"{base}/in"))
    q, ref = ST.start_refresh(stream, f"{base}/state", f"{base}/out",
                              f"{base}/ckpt")
    q.awaitTermination()
    return ref.latest_features(spark).select("CustomerID", "Recency", "Frequency", "TotalQty",
                                             F.round("Monetary", 4).alias("Monetary"))


# ---------------------------------------------------------------- stores, bad rows, small operators

def _scratch(spark, tag: str) -> str:
    import uuid
    from patronage.session import scratch_path
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


@register("csv_round_trip")
def q_csv_round_trip(spark, sf_dir):
    """S1 + S4: the view written as CSV and read back by the fixed schema."""
    from patronage.sources.sinks import write_table
    path = _scratch(spark, "csv")
    write_table(S.transactions(spark, sf_dir).withColumn("InvoiceDate", ts_text("InvoiceDate")), path, "csv")
    return tx_output(S.load_raw_csv(spark, path))


@register("table_store")
def q_table_store(spark, sf_dir):
    """S2 + S4: the snake-case table stored by category, read back and
    projected to the batch names in order of date."""
    from patronage.sources.sinks import write_table
    path = _scratch(spark, "table")
    write_table(S.to_snake(S.transactions(spark, sf_dir)), path, partition_by=["product_category"])
    return tx_output(S.load_transactions(spark.read.parquet(path)))


@register("request_rows")
def q_request_rows(spark, sf_dir):
    """Snake-case request rows with dates as text, to the batch schema."""
    asked = S.to_snake(S.transactions(spark, sf_dir).withColumn("InvoiceDate", ts_text("InvoiceDate")))
    return tx_output(S.from_snake(asked))


def bad_rows(spark, sf_dir) -> DataFrame:
    """The view and derived rows that cleaning must drop or mend: null, blank
    and padded customers, null invoices, zero and negative quantities."""
    tx = S.transactions(spark, sf_dir)
    key = F.pmod(F.col("ProductID").cast("long"), F.lit(6))
    return tx.unionByName(tx.withColumns({
        "InvoiceID": F.when(key != 3, F.col("InvoiceID")),
        "CustomerID": F.when(key == 0, F.lit(None)).when(key == 1, F.lit(" \t "))
                       .when(key == 2, F.concat(F.lit("  "), "CustomerID", F.lit("\t"))).otherwise(F.col("CustomerID")),
        "Quantity": F.when(key == 4, F.lit(0)).when(key == 5, -F.col("Quantity")).otherwise(F.col("Quantity"))}))


def bad_output(df: DataFrame) -> DataFrame:
    """Rows for comparison without a division by their quantity."""
    return df.select("InvoiceID", "CustomerID", ts_text("InvoiceDate").alias("InvoiceDate"), "ProductID", "Quantity")


@register("clean_customer_bad_rows")
def q_clean_customer_bad_rows(spark, sf_dir):
    """C3 with rows to drop and to strip."""
    return bad_output(C.drop_blank_customers(bad_rows(spark, sf_dir)))


@register("clean_quantity_bad_rows")
def q_clean_quantity_bad_rows(spark, sf_dir):
    """C4 with rows to drop."""
    return bad_output(C.positive_quantity(bad_rows(spark, sf_dir)))


@register("clean_data_bad_rows")
def q_clean_data_bad_rows(spark, sf_dir):
    """C5 over the view with bad rows; null invoices stay."""
    return bad_output(C.clean_data(bad_rows(spark, sf_dir)))


@register("friendly_sources_labelled")
def q_friendly_sources_labelled(spark, sf_dir):
    """Every document source under names that its rules look for."""
    needles = F.array(*[F.lit(n.upper()) for n, _ in E.SOURCE_LABELS], F.lit(""))
    src = S.read_table(spark, sf_dir, "documents").select("source").distinct()
    src = src.select(F.coalesce("source", F.lit("none")).alias("s"), F.explode(needles).alias("n")) \
             .select(F.concat_ws("/", "s", "n").alias("src"))
    src = src.unionByName(src.select(F.lit(E.CONFIG_SOURCE[0]).alias("src"))).distinct()
    return src.select("src", E.friendly_source("src").alias("label"))


@register("risk_bands")
def q_risk_bands(spark, sf_dir):
    """E7 + E11: band of each customer's share of weekend lines, and the
    size and sign of its returned less its discounted share."""
    size, way = E.signed_contribution(F.col("ReturnRate") - F.col("DiscountUsage"))
    return features(spark, sf_dir).select("CustomerID", E.risk_band("WeekendRatio").alias("band"),
                                          size.alias("importance"), way.alias("direction"))


@register("feature_hash_json")
def q_feature_hash_json(spark, sf_dir):
    """The change key over the whole-number features."""
    cols = ["TotalQty", "Recency", "ProductDiversity", "Frequency", "CategoryDiversity"]
    return features(spark, sf_dir).select("CustomerID", E.feature_hash(cols).alias("feature_hash"))


@register("existing_and_new")
def q_existing_and_new(spark, sf_dir):
    """Customers with features, against the stored early half."""
    from patronage.session import stored
    table, current, _ = _stored(spark, sf_dir)
    known, new = U.existing_and_new(stored(table.select(F.col("customer_id").alias("CustomerID"))),
                                    stored(current.select("CustomerID", "Frequency")))
    return (known.withColumn("existing", F.lit(True))
                 .unionByName(new.withColumn("existing", F.lit(False))))


@register("upsert_values")
def q_upsert_values(spark, sf_dir):
    """The merged table itself: new values of customers in the full
    period, stamps kept or set."""
    table, current, ref = _stored(spark, sf_dir)
    table = table.withColumn("created_at", F.lit("2001-01-01 00:00:00").cast("timestamp"))
    merged, _ = U.upsert_features(table, current, now=ref)
    return merged.select("customer_id", "recency", "frequency", "total_qty", F.round("monetary", 4).alias("monetary"),
                         (F.col("created_at") == F.col("updated_at")).alias("created_now"))


@register("upsert_incremental")
def q_upsert_incremental(spark, sf_dir):
    """As upsert_values, on a keyed table that is read and written by touched buckets."""
    from patronage.session import stored
    table, current, ref = _stored(spark, sf_dir)
    held = U.stored_features(spark, _scratch(spark, "features"))
    held.write(table.withColumn("created_at", F.lit("2001-01-01 00:00:00").cast("timestamp")), 1)
    U.upsert_into(held, stored(current), 2, now=ref)
    return held.read().select("customer_id", "recency", "frequency", "total_qty", F.round("monetary", 4).alias("monetary"),
                              (F.col("created_at") == F.col("updated_at")).alias("created_now"))


@register("forecast_store")
def q_forecast_store(spark, sf_dir):
    """Forecasts of all segments stored by key, one read back."""
    path = _scratch(spark, "forecast")
    FC.save_forecast(FC.forecast_all(tx_segment(spark, sf_dir), "Segment"), path, "Segment")
    return FC.get_forecast(spark, path, "BUILDING")


@register("drift_baseline")
def q_drift_baseline(spark, sf_dir):
    """The baseline snapshot stored and read back."""
    from patronage.sources.sinks import write_table
    path = _scratch(spark, "baseline")
    write_table(R.baseline_snapshot(feat_seg(spark, sf_dir)), path)
    got = spark.read.parquet(path)
    return got.select("CustomerID", "Recency", "Frequency", "TotalQty", "RegionKey", F.round("Monetary", 4).alias("Monetary"))


@register("best_category")
def q_best_category(spark, sf_dir):
    """The category with the most lines, ties to the first name."""
    return P.best_by(cleaned(spark, sf_dir).groupBy("ProductCategory").agg(F.count(F.lit(1)).alias("n")),
                     "n", "ProductCategory")


@register("top_products_by_category")
def q_top_products_by_category(spark, sf_dir):
    """The three products of each category with the most units."""
    sums = cleaned(spark, sf_dir).groupBy("ProductCategory", "ProductID").agg(F.sum("Quantity").alias("units"))
    return P.ranked_within(sums, ["ProductCategory"], [F.desc("units"), F.asc("ProductID")], 3)
