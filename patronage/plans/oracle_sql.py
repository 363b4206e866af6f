"""DuckDB SQL for the registered queries (independent oracle).

The building blocks below restate the transaction view, cleaning and the
customer features in plain SQL over the pre-registered tables.
"""

from __future__ import annotations

TX = """
tx AS (
  SELECT (CASE WHEN o.o_orderstatus = 'P' THEN 'C' ELSE 'INV' END) || CAST(o.o_orderkey AS VARCHAR) AS InvoiceID,
         CAST(o.o_custkey AS VARCHAR) AS CustomerID,
         CAST(o.o_orderdate AS TIMESTAMP) + to_hours(CAST(o.o_orderkey % 24 AS BIGINT)) AS InvoiceDate,
         p.p_type AS ProductCategory,
         CAST(l.l_partkey AS VARCHAR) AS ProductID,
         CAST(l.l_quantity AS INTEGER) AS Quantity,
         l.l_extendedprice / l.l_quantity AS UnitPrice,
         ROUND(l.l_discount * 100) AS DiscountPct,
         o.o_orderpriority AS PaymentMethod,
         l.l_returnflag = 'R' AS Returned
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

CLEAN = TX + """,
dedup AS (SELECT DISTINCT * FROM tx),
clean AS (
  SELECT * FROM (
    SELECT InvoiceID, regexp_replace(CustomerID, '^\\s+|\\s+$', '', 'g') AS CustomerID,
           InvoiceDate, ProductCategory, ProductID, Quantity, UnitPrice, DiscountPct,
           PaymentMethod, Returned
    FROM dedup
    WHERE NOT coalesce(starts_with(InvoiceID, 'C'), false) AND CustomerID IS NOT NULL
  ) WHERE CustomerID <> '' AND Quantity > 0
)"""

FEATURES = CLEAN + """,
refd AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS ref FROM clean),
agg AS (
  SELECT CustomerID,
         max(InvoiceDate) AS LastPurchase,
         min(InvoiceDate) AS FirstPurchase,
         count(DISTINCT InvoiceID) AS Frequency,
         sum(Quantity * UnitPrice * (1 - DiscountPct / 100)) AS Monetary,
         avg(Quantity) AS AvgQuantity,
         max(Quantity * UnitPrice * (1 - DiscountPct / 100)) AS MaxOrderValue,
         CAST(sum(Quantity) AS BIGINT) AS TotalQty,
         CAST(sum(CASE WHEN isodow(InvoiceDate) IN (6, 7) THEN 1 ELSE 0 END) AS BIGINT) AS WeekendOrders,
         CAST(sum(CASE WHEN hour(InvoiceDate) < 6 THEN 1 ELSE 0 END) AS BIGINT) AS NightOrders,
         count(CASE WHEN DiscountPct > 0 THEN 1 END) AS DiscountOrders,
         CAST(sum(CAST(Returned AS INTEGER)) AS BIGINT) AS ReturnCount,
         count(DISTINCT ProductID) AS ProductDiversity,
         count(DISTINCT ProductCategory) AS CategoryDiversity
  FROM clean GROUP BY CustomerID
),
feat AS (
  SELECT a.*, a.Frequency AS TotalOrders,
         CAST(floor((epoch_us(r.ref) - epoch_us(a.LastPurchase)) / 86400000000) AS BIGINT) AS Recency,
         a.Monetary / a.Frequency AS AvgBasketSize,
         greatest(coalesce(floor((epoch_us(a.LastPurchase) - epoch_us(a.FirstPurchase)) / 86400000000)
                           / (greatest(a.Frequency, 2) - 1), 0.0), 0.0) AS PurchaseInterval,
         a.WeekendOrders / a.Frequency AS WeekendRatio,
         a.NightOrders / a.Frequency AS NightRatio,
         a.DiscountOrders / a.Frequency AS DiscountUsage,
         a.ReturnCount / a.Frequency AS ReturnRate
  FROM agg a CROSS JOIN refd r
)"""

SEGMENTS = """
seg AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS CustomerID, c.c_mktsegment AS Segment,
         CAST(n.n_regionkey AS INTEGER) AS RegionKey
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks)


FEATURE_SELECT = """
SELECT CustomerID, Recency, Frequency, round(Monetary, 4) AS Monetary,
       round(AvgQuantity, 6) AS AvgQuantity, round(MaxOrderValue, 4) AS MaxOrderValue, TotalQty,
       WeekendOrders, NightOrders, DiscountOrders, ReturnCount, ProductDiversity, CategoryDiversity,
       TotalOrders, strftime(FirstPurchase, '%Y-%m-%d %H:%M:%S') AS FirstPurchase,
       strftime(LastPurchase, '%Y-%m-%d %H:%M:%S') AS LastPurchase,
       CAST((2 * CAST(round(Monetary * 10000) AS BIGINT) + TotalOrders) // (2 * TotalOrders) AS DOUBLE) / 10000 AS AvgBasketSize, round(PurchaseInterval, 6) AS PurchaseInterval,
       round(WeekendRatio, 6) AS WeekendRatio, round(NightRatio, 6) AS NightRatio,
       round(DiscountUsage, 6) AS DiscountUsage, round(ReturnRate, 6) AS ReturnRate
FROM feat"""

ORACLE: dict[str, str] = {}

ORACLE["customer_features"] = with_(FEATURES) + FEATURE_SELECT


def txout(src: str) -> str:
    return f"""SELECT InvoiceID, CustomerID, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       ProductCategory, ProductID, Quantity,
       CAST((2 * CAST(round(UnitPrice * Quantity * 100) AS BIGINT) * 10000 + Quantity) // (2 * Quantity) AS DOUBLE)
         / 1000000 AS UnitPrice, DiscountPct,
       PaymentMethod, Returned FROM {src}"""


FEAT_COLS = ["Recency", "Frequency", "Monetary", "AvgBasketSize", "PurchaseInterval", "WeekendRatio",
             "NightRatio", "DiscountUsage", "ReturnRate", "ProductDiversity", "CategoryDiversity",
             "AvgQuantity", "MaxOrderValue", "TotalQty"]
DOUBLE_FEATS = {"Monetary", "AvgBasketSize", "PurchaseInterval", "WeekendRatio", "NightRatio",
                "DiscountUsage", "ReturnRate", "AvgQuantity", "MaxOrderValue"}
MONEY = {"Monetary", "MaxOrderValue", "AvgBasketSize", "TotalSales", "Sales", "y", "total_predicted"}


def r(expr: str, name: str, digits: int = 6, money_digits: int = 4) -> str:
    return f"round({expr}, {money_digits if name in MONEY else digits}) AS {name}"


FS = with_(FEATURES, SEGMENTS, """
fs AS (SELECT f.*, s.Segment, s.RegionKey FROM feat f LEFT JOIN seg s USING (CustomerID))""")

ORACLE["transactions"] = with_(TX) + txout("tx")
ORACLE["tx_count"] = with_(TX) + "SELECT count(*) AS n_rows FROM tx"
ORACLE["clean_dedup"] = with_(TX) + txout("(SELECT DISTINCT * FROM (SELECT * FROM tx UNION ALL SELECT * FROM tx))")
ORACLE["clean_cancelled"] = with_(TX) + txout("tx WHERE NOT coalesce(starts_with(InvoiceID, 'C'), false)")
ORACLE["clean_customer"] = with_(TX) + txout(
    "(SELECT * REPLACE (regexp_replace(CustomerID, '^\\s+|\\s+$', '', 'g') AS CustomerID) FROM tx "
    "WHERE CustomerID IS NOT NULL) WHERE CustomerID <> ''")
ORACLE["clean_quantity"] = with_(TX) + txout("tx WHERE Quantity > 0")
ORACLE["clean_data"] = with_(CLEAN) + txout("clean")


def _fence(prev: str, col: str, i: int) -> str:
    return f"""b{i} AS (SELECT quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1,
                       quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3 FROM {prev}),
o{i} AS (SELECT p.* FROM {prev} p, b{i}
         WHERE {col} >= q1 - 1.5 * (q3 - q1) AND {col} <= q3 + 1.5 * (q3 - q1))"""


ORACLE["clean_outliers"] = with_(CLEAN, _fence("clean", "UnitPrice", 1), _fence("o1", "Quantity", 2),
                                 _fence("o2", "DiscountPct", 3)) + txout("o3")

_fill_cols = []
for _c in FEAT_COLS:
    if _c == "AvgBasketSize":
        _fill_cols.append("CASE WHEN coalesce(f.Frequency, 0) > 0 THEN CAST((2 * CAST(round(f.Monetary * 10000) "
                          "AS BIGINT) + f.Frequency) // (2 * f.Frequency) AS DOUBLE) / 10000 ELSE 0.0 END "
                          "AS AvgBasketSize")
    elif _c in DOUBLE_FEATS:
        _fill_cols.append(r(f"coalesce(f.{_c}, 0.0)", _c))
    else:
        _fill_cols.append(f"coalesce(f.{_c}, 0) AS {_c}")
ORACLE["features_fill_zero"] = with_(FEATURES, SEGMENTS) + f"""
SELECT s.CustomerID, {', '.join(_fill_cols)} FROM seg s LEFT JOIN feat f USING (CustomerID)"""

ORACLE["segment_subset"] = FS + """
SELECT CustomerID, Segment, Segment = 'BUILDING' AS highlight,
       round((SELECT avg(CASE WHEN Segment = 'BUILDING' THEN 1.0 ELSE 0.0 END) FROM fs) * 100, 6) AS share_pct
FROM fs WHERE Segment = 'BUILDING'"""

ORACLE["line_expressions"] = with_(CLEAN, "refd AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS ref FROM clean)") + """
SELECT InvoiceID, ProductID, Quantity, round(Quantity * UnitPrice * (1 - DiscountPct / 100), 4) AS NetRevenue,
       CASE WHEN isodow(InvoiceDate) IN (6, 7) THEN 1 ELSE 0 END AS IsWeekend,
       CASE WHEN hour(InvoiceDate) < 6 THEN 1 ELSE 0 END AS IsNight,
       CAST(date_trunc('month', InvoiceDate) AS DATE) AS MonthStart,
       last_day(InvoiceDate) AS MonthEnd,
       CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS DayOfWeek,
       CAST(hour(InvoiceDate) AS INTEGER) AS Hour,
       CAST(floor((epoch_us(r.ref) - epoch_us(InvoiceDate)) / 86400000000) AS BIGINT) AS DaysToRef,
       least(Quantity, 20) AS QtyCapped
FROM clean, refd r"""

PERSONAS_SQL = """
pdim AS (SELECT * FROM (VALUES
  (0, 'VIP Loyal Customers', 'High spending, frequent purchases, low recency. Core revenue drivers.'),
  (1, 'Discount Hunters', 'Low spending, only during sales/discounts. Price-sensitive segment.'),
  (2, 'Churn Risk', 'Inactive for months, low frequency, high recency. Need re-engagement.'),
  (3, 'One-Time Buyers', 'Bought once, never returned. Low monetary & frequency.')
) AS t(Cluster, Persona, Description)),
precs AS (SELECT * FROM (VALUES
  ('VIP Loyal Customers', 0, 'Exclusive rewards & VIP loyalty program'),
  ('VIP Loyal Customers', 1, 'Early access to new products'),
  ('VIP Loyal Customers', 2, 'Personalized recommendations'),
  ('Discount Hunters', 0, 'Targeted coupon campaigns'),
  ('Discount Hunters', 1, 'Flash sale notifications'),
  ('Discount Hunters', 2, 'Bundle deals to increase basket size'),
  ('Churn Risk', 0, 'Win-back email campaigns'),
  ('Churn Risk', 1, 'Special reactivation discounts'),
  ('Churn Risk', 2, 'Survey to understand inactivity'),
  ('One-Time Buyers', 0, 'Cross-selling on complementary products'),
  ('One-Time Buyers', 1, 'Post-purchase follow-up sequence'),
  ('One-Time Buyers', 2, 'Free shipping on second purchase')
) AS t(Persona, rank, Recommendation))"""

ORACLE["persona_lookup"] = with_(FS.removeprefix("WITH "), PERSONAS_SQL) + """
SELECT f.CustomerID, f.RegionKey AS Cluster, coalesce(p.Persona, 'Unknown') AS Persona
FROM fs f LEFT JOIN pdim p ON f.RegionKey = p.Cluster"""

ORACLE["feature_hash"] = with_(FEATURES) + """
SELECT CustomerID, substring(sha256(concat_ws('|', CAST(CategoryDiversity AS VARCHAR), CAST(Frequency AS VARCHAR),
       CAST(ProductDiversity AS VARCHAR), CAST(Recency AS VARCHAR), CAST(TotalQty AS VARCHAR))), 1, 16) AS feature_hash
FROM feat"""

ORACLE["friendly_sources"] = """
WITH srcs AS (SELECT DISTINCT src FROM (SELECT source AS src FROM documents UNION ALL SELECT url AS src FROM pages))
SELECT src, CASE
  WHEN contains(lower(src), 'customer_personas') THEN 'Customer Persona Profiles'
  WHEN contains(lower(src), 'customer_features_scaled') THEN 'Scaled Customer Features'
  WHEN contains(lower(src), 'customer_features') THEN 'Customer Features Data'
  WHEN contains(lower(src), 'drift_baseline') THEN 'Drift Baseline Analysis'
  WHEN contains(lower(src), 'pipeline') THEN 'Pipeline Report'
  WHEN contains(lower(src), 'readme') THEN 'Project Documentation'
  WHEN contains(lower(src), 'predictions') THEN 'Predictions'
  WHEN src = 'config' THEN 'Persona Configuration'
  ELSE src END AS label
FROM srcs"""

_prof_cols = ", ".join(f"avg({c}) AS {c}" for c in FEAT_COLS)
ORACLE["segment_profile_norm"] = FS + f""",
prof AS (SELECT Segment, {_prof_cols} FROM fs GROUP BY Segment),
long AS (UNPIVOT prof ON {', '.join(FEAT_COLS)} INTO NAME feature VALUE mean),
rng AS (SELECT feature, min(mean) AS lo, max(mean) AS hi FROM long GROUP BY feature)
SELECT l.Segment, l.feature, round(l.mean, 4) AS mean,
       round((l.mean - r.lo) / (r.hi - r.lo + 1e-9), 6) AS norm
FROM long l JOIN rng r USING (feature)"""

ORACLE["recency_dates"] = with_(FEATURES) + """
SELECT CustomerID, Recency, CAST(CAST(r.ref AS DATE) - CAST(Recency AS INTEGER) AS DATE) AS approx_last_purchase
FROM feat, refd r"""

ORACLE["segment_profiles"] = FS + "\nSELECT Segment, " + ", ".join(
    r(f"avg({c})", c) for c in FEAT_COLS) + " FROM fs GROUP BY Segment"


def _vc(col: str, src: str) -> str:
    return f"SELECT {col}, count(*) AS count FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}"


ORACLE["payment_counts"] = with_(CLEAN) + _vc("PaymentMethod", "clean")
ORACLE["category_counts"] = with_(CLEAN) + _vc("ProductCategory", "clean")
ORACLE["returned_counts"] = with_(CLEAN) + _vc("Returned", "clean")
ORACLE["segment_counts"] = FS + """
SELECT Segment, count, round(count * 100.0 / sum(count) OVER (), 6) AS share_pct
FROM (""" + _vc("Segment", "fs") + ")"

ORACLE["overview"] = FS + """
SELECT count(*) AS n_customers, CAST(14 AS BIGINT) AS n_features, count(DISTINCT RegionKey) AS n_clusters,
       count(DISTINCT Segment) AS n_personas FROM fs"""

_tx_cols = ["InvoiceID", "CustomerID", "InvoiceDate", "ProductCategory", "ProductID", "Quantity", "UnitPrice",
            "DiscountPct", "PaymentMethod", "Returned"]
ORACLE["null_counts"] = with_(TX) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM tx" for c in _tx_cols)

ORACLE["data_quality"] = with_(TX) + """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx)) AS n_duplicate_rows,
       count(DISTINCT InvoiceID) AS n_invoices, count(DISTINCT CustomerID) AS n_customers,
       count(DISTINCT ProductID) AS n_products, count(*) FILTER (WHERE Quantity < 0) AS n_negative_qty,
       count(*) FILTER (WHERE Quantity = 0) AS n_zero_qty, count(*) FILTER (WHERE CustomerID IS NULL) AS n_null_customers,
       count(*) FILTER (WHERE starts_with(InvoiceID, 'C')) AS n_cancelled
FROM tx"""


def _describe(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, round(avg({x}), 4) AS mean,
       round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS q25,
       round(quantile_cont({x}, 0.5), 4) AS q50, round(quantile_cont({x}, 0.75), 4) AS q75,
       round(max({x}), 4) AS max FROM {src}""")
    return "\nUNION ALL\n".join(parts)


ORACLE["describe_lines"] = with_(CLEAN) + _describe("clean", ["Quantity", "UnitPrice", "DiscountPct"])
ORACLE["describe_features"] = with_(FEATURES) + _describe("feat", FEAT_COLS)


def _describe_text(col: str) -> str:
    return f"""SELECT '{col}' AS "column", sum(n) AS count, count(*) AS unique,
       arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT {col} AS v, count(*) AS n FROM clean WHERE {col} IS NOT NULL GROUP BY {col})"""


ORACLE["describe_text"] = with_(CLEAN) + "\nUNION ALL\n".join(
    _describe_text(c) for c in ("ProductCategory", "PaymentMethod", "ProductID", "CustomerID"))

ORACLE["customer_totals"] = with_(CLEAN) + """
SELECT CustomerID, round(sum(UnitPrice), 4) AS TotalSales, count(DISTINCT InvoiceID) AS OrderCount,
       round(avg(Quantity), 6) AS AvgQty, round(avg(UnitPrice), 6) AS AvgPrice,
       least(count(DISTINCT InvoiceID), 20) AS OrderCountCapped
FROM clean GROUP BY CustomerID"""


def _hist(col: str, bins: int) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""SELECT b.bin, round(g.lo + b.bin * ((g.hi - g.lo) / {bins}), 6) AS bin_start,
       round(CASE WHEN b.bin = {bins - 1} THEN g.hi ELSE g.lo + (b.bin + 1) * ((g.hi - g.lo) / {bins}) END, 6) AS bin_end,
       coalesce(c.count, 0) AS count, '{col}' AS "column"
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) b
CROSS JOIN (SELECT CASE WHEN max({x}) > min({x}) THEN min({x}) ELSE min({x}) - 0.5 END AS lo,
                   CASE WHEN max({x}) > min({x}) THEN max({x}) ELSE max({x}) + 0.5 END AS hi FROM clean) g
LEFT JOIN (SELECT CAST(least(floor(({x} - g2.lo) * {bins} / (g2.hi - g2.lo)), {bins - 1}) AS INTEGER) AS bin,
                  count(*) AS count
           FROM clean, (SELECT CASE WHEN max({x}) > min({x}) THEN min({x}) ELSE min({x}) - 0.5 END AS lo,
                               CASE WHEN max({x}) > min({x}) THEN max({x}) ELSE max({x}) + 0.5 END AS hi
                        FROM clean) g2
           WHERE {col} IS NOT NULL GROUP BY 1) c ON b.bin = c.bin"""


ORACLE["histograms"] = with_(CLEAN) + "\nUNION ALL\n".join(
    _hist(c, b) for c, b in (("Quantity", 20), ("UnitPrice", 20), ("DiscountPct", 15)))


def _box(col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{col}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr,
       round(min({x}) FILTER (WHERE {x} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max({x}) FILTER (WHERE {x} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM clean, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med,
                    quantile_cont({x}, 0.75) AS q3 FROM clean) q
GROUP BY q1, med, q3"""


ORACLE["box_summaries"] = with_(CLEAN) + "\nUNION ALL\n".join(_box(c) for c in ("Quantity", "UnitPrice", "DiscountPct"))


def _corr(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            expr = f"(SELECT corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FROM {src})"
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, round({expr}, 6) AS corr")
            parts.append(f"SELECT '{b}' AS col1, '{a}' AS col2, round({expr}, 6) AS corr")
    parts += [f"SELECT '{c}' AS col1, '{c}' AS col2, 1.0 AS corr" for c in cols]
    return "\nUNION ALL\n".join(parts)


ORACLE["correlation_lines"] = with_(CLEAN) + _corr("clean", ["Quantity", "UnitPrice", "DiscountPct"])
ORACLE["correlation_features"] = with_(FEATURES) + _corr("feat", FEAT_COLS)

ORACLE["orders_by_weekday"] = with_(CLEAN) + """
SELECT d.day_of_week, coalesce(c.n, 0) AS n_orders
FROM (SELECT CAST(range AS INTEGER) AS day_of_week FROM range(7)) d
LEFT JOIN (SELECT CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS dow, count(*) AS n FROM clean GROUP BY 1) c
ON d.day_of_week = c.dow"""
ORACLE["orders_by_hour"] = with_(CLEAN) + """
SELECT CAST(hour(InvoiceDate) AS INTEGER) AS hour, count(*) AS n_orders FROM clean GROUP BY 1"""
ORACLE["monthly_sales"] = with_(CLEAN) + """
SELECT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month, round(sum(UnitPrice), 4) AS Sales,
       count(DISTINCT InvoiceID) AS Orders FROM clean GROUP BY 1"""

TXSEG = CLEAN + ",\n" + SEGMENTS.strip() + """,
txs AS (SELECT c.*, s.Segment FROM clean c LEFT JOIN seg s USING (CustomerID))"""
ORACLE["tx_segment"] = with_(TXSEG) + "SELECT InvoiceID, CustomerID, ProductID, Quantity, Segment FROM txs"

MONTHLY = TXSEG + """,
sums AS (SELECT Segment, last_day(InvoiceDate) AS ds, sum(Quantity * UnitPrice * (1.0 - DiscountPct / 100.0)) AS y
         FROM txs WHERE Segment IS NOT NULL AND InvoiceDate IS NOT NULL GROUP BY 1, 2),
span AS (SELECT Segment, min(ds) AS first, max(ds) AS last FROM sums GROUP BY 1),
months AS (SELECT Segment, last_day(CAST(m AS DATE)) AS ds FROM span,
           unnest(generate_series(CAST(date_trunc('month', first) AS DATE), CAST(date_trunc('month', last) AS DATE),
                                  INTERVAL 1 MONTH)) AS t(m)),
series AS (SELECT m.Segment, m.ds, coalesce(s.y, 0.0) AS y FROM months m LEFT JOIN sums s USING (Segment, ds)
           WHERE m.Segment IN (SELECT Segment FROM span
                               WHERE date_diff('month', date_trunc('month', first), date_trunc('month', last)) + 1 >= 4))"""
ORACLE["monthly_segment_revenue"] = with_(MONTHLY) + "SELECT Segment, ds, round(y, 4) AS y FROM series"

ORACLE["headline"] = with_(TX) + f"""
SELECT count(*) AS n_rows, count(DISTINCT CustomerID) AS n_customers,
       strftime(min(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS first_date,
       strftime(max(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS last_date,
       {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in _tx_cols)} AS n_missing,
       count(DISTINCT ProductCategory) AS n_categories, count(DISTINCT PaymentMethod) AS n_payment_methods,
       round(avg(CAST(Returned AS DOUBLE)) * 100, 6) AS return_rate_pct, round(avg(UnitPrice), 6) AS avg_unit_price
FROM tx"""

LABELS = FEATURES + """,
lab AS (SELECT f.*, CAST(f.Recency > q.r AND f.Frequency <= q.f AS INTEGER) AS ChurnLabel
        FROM feat f, (SELECT quantile_cont(CAST(Recency AS DOUBLE), 0.75) AS r,
                             quantile_cont(CAST(Frequency AS DOUBLE), 0.25) AS f FROM feat) q)"""
ORACLE["churn_labels"] = with_(LABELS) + "SELECT CustomerID, Recency, Frequency, ChurnLabel FROM lab"
ORACLE["churn_share"] = with_(LABELS) + """
SELECT round(avg(CAST(ChurnLabel AS DOUBLE)), 6) AS positive_rate, count(*) AS n FROM lab"""
ORACLE["recency_ranking_metrics"] = with_(LABELS) + """,
g AS (SELECT CAST(Recency AS DOUBLE) AS score, count(*) FILTER (WHERE ChurnLabel = 1) AS pos,
             count(*) FILTER (WHERE ChurnLabel <> 1) AS neg FROM lab GROUP BY 1),
c AS (SELECT score, pos, neg, sum(neg) OVER (ORDER BY score) AS cum_neg_up,
             sum(pos) OVER (ORDER BY score DESC) AS cum_pos_dn, sum(neg) OVER (ORDER BY score DESC) AS cum_neg_dn
      FROM g),
t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g)
SELECT round(sum(pos * (cum_neg_up - neg + 0.5 * neg)) / (max(t.p) * max(t.n)), 6) AS roc_auc,
       round(sum(pos * (cum_pos_dn / (cum_pos_dn + cum_neg_dn))) / max(t.p), 6) AS avg_precision
FROM c, t"""

FORECAST = MONTHLY + """,
idx AS (SELECT s.*, date_diff('month', date_trunc('month', f.first_ds), date_trunc('month', s.ds)) AS t
        FROM series s JOIN (SELECT Segment, min(ds) AS first_ds FROM series GROUP BY 1) f USING (Segment)),
fit AS (SELECT Segment, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, count(*) AS n, max(ds) AS last_ds
        FROM idx GROUP BY 1 HAVING count(*) >= 2),
res AS (SELECT i.Segment, stddev_pop(i.y - (f.a + f.b * i.t)) AS sd FROM idx i JOIN fit f USING (Segment) GROUP BY 1),
fut AS (SELECT f.*, r.sd, h FROM fit f JOIN res r USING (Segment), range(1, 4) AS hh(h)),
fc AS (SELECT Segment, last_day(CAST(date_trunc('month', last_ds) AS DATE) + to_months(CAST(h AS INTEGER))) AS date,
              round(greatest(a + b * (n - 1 + h), 0.0), 2) AS predicted_value,
              round(greatest(a + b * (n - 1 + h) - 1.96 * sd, 0.0), 2) AS lower_bound,
              round(greatest(a + b * (n - 1 + h) + 1.96 * sd, 0.0), 2) AS upper_bound
       FROM fut)"""
ORACLE["segment_forecast"] = with_(FORECAST) + "SELECT * FROM fc"
ORACLE["segment_forecast_tail"] = with_(MONTHLY) + """
SELECT Segment, ds, round(y, 4) AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY ds DESC) AS rn FROM series) WHERE rn <= 3"""
ORACLE["forecast_summary"] = with_(FORECAST) + """
SELECT Segment, round(sum(predicted_value), 2) AS total_predicted, round(arg_min(lower_bound, date), 2) AS first_lower,
       round(arg_max(upper_bound, date), 2) AS last_upper FROM fc GROUP BY 1"""

ORACLE["top_products"] = with_(CLEAN) + """
SELECT ProductID, round(sum(UnitPrice), 4) AS sum_UnitPrice FROM clean GROUP BY 1
ORDER BY sum(UnitPrice) DESC, ProductID LIMIT 10"""
ORACLE["category_sales"] = with_(CLEAN) + """
SELECT ProductCategory, round(sum(UnitPrice), 4) AS sum_UnitPrice FROM clean GROUP BY 1"""
ORACLE["head_lines"] = with_(CLEAN) + f"""SELECT * FROM ({txout('clean')})
ORDER BY InvoiceDate, InvoiceID, ProductID, Quantity, UnitPrice, DiscountPct, Returned LIMIT 10"""

ORACLE["persona_summary"] = FS + ",\n" + PERSONAS_SQL.strip() + """
SELECT p.Cluster, p.Persona, p.Description, c.n
FROM pdim p LEFT JOIN (SELECT RegionKey AS Cluster, count(*) AS n FROM fs GROUP BY 1) c USING (Cluster)"""
ORACLE["persona_recommendations"] = FS + ",\n" + PERSONAS_SQL.strip() + """
SELECT r.Persona, CAST(r.rank AS INTEGER) AS rank, r.Recommendation, c.n_customers
FROM precs r LEFT JOIN (SELECT coalesce(p.Persona, 'Unknown') AS Persona, count(*) AS n_customers
                        FROM fs f LEFT JOIN pdim p ON f.RegionKey = p.Cluster GROUP BY 1) c USING (Persona)"""


def feature_ctes(src: str, p: str) -> str:
    """The feature CTEs over ``src`` with names prefixed by ``p``."""
    body = FEATURES[len(CLEAN):].lstrip(",\n")
    for name in ("refd", "agg", "feat"):
        body = body.replace(f"{name} AS (", f"{p}{name} AS (")
    body = (body.replace("FROM clean", f"FROM {src}").replace("FROM agg a CROSS JOIN refd r",
                                                              f"FROM {p}agg a CROSS JOIN {p}refd r"))
    return body


_long_e = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, 'e' AS side FROM e_feat"
                             for c in FEAT_COLS)
_long_a = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, 'a' AS side FROM a_feat"
                             for c in FEAT_COLS)

DRIFT = CLEAN + """,
cutv AS (SELECT make_timestamp(CAST(floor((epoch_us(min(InvoiceDate)) + epoch_us(max(InvoiceDate))) / 2) AS BIGINT))
                AS cut FROM clean),
early AS (SELECT c.* FROM clean c, cutv WHERE c.InvoiceDate < cutv.cut),
late AS (SELECT c.* FROM clean c, cutv WHERE c.InvoiceDate >= cutv.cut),
""" + feature_ctes("early", "e_") + ",\n" + feature_ctes("late", "a_") + f""",
vals AS (SELECT * FROM ({_long_e} UNION ALL {_long_a}) WHERE value IS NOT NULL AND NOT isnan(value)),
ranges AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE side = 'e') AS n_e,
                  count(*) FILTER (WHERE side = 'a') AS n_a FROM vals GROUP BY 1
           HAVING count(*) FILTER (WHERE side = 'e') >= 5 AND count(*) FILTER (WHERE side = 'a') >= 5),
spread AS (SELECT * FROM ranges WHERE hi - lo >= 1e-10),
b10 AS (SELECT s.feature, g.bin, s.n_e, s.n_a, s.lo, s.hi FROM spread s, (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) g),
c10 AS (SELECT v.feature, CAST(least(floor((v.value - s.lo) * 10 / (s.hi - s.lo)), 9) AS INTEGER) AS bin,
               count(*) FILTER (WHERE side = 'e') AS c_e, count(*) FILTER (WHERE side = 'a') AS c_a
        FROM vals v JOIN spread s USING (feature) GROUP BY 1, 2),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (
          SELECT b.feature, least(greatest(coalesce(c.c_e, 0) / b.n_e, 1e-10), 1.0) AS e,
                 least(greatest(coalesce(c.c_a, 0) / b.n_a, 1e-10), 1.0) AS a
          FROM b10 b LEFT JOIN c10 c USING (feature, bin)) GROUP BY 1),
b20 AS (SELECT s.feature, g.bin, s.n_e, s.n_a, s.lo, s.hi FROM spread s, (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g),
c20 AS (SELECT v.feature, CAST(least(floor((v.value - s.lo) * 20 / (s.hi - s.lo)), 19) AS INTEGER) AS bin,
               count(*) FILTER (WHERE side = 'e') AS c_e, count(*) FILTER (WHERE side = 'a') AS c_a
        FROM vals v JOIN spread s USING (feature) GROUP BY 1, 2),
dens AS (SELECT b.feature, coalesce(c.c_e, 0) / (b.n_e * ((b.hi - b.lo) / 20)) + 1e-10 AS pe,
                coalesce(c.c_a, 0) / (b.n_a * ((b.hi - b.lo) / 20)) + 1e-10 AS pa
         FROM b20 b LEFT JOIN c20 c USING (feature, bin)),
kl AS (SELECT d.feature, sum((d.pe / t.se) * ln((d.pe / t.se) / (d.pa / t.sa))) AS kl_divergence
       FROM dens d JOIN (SELECT feature, sum(pe) AS se, sum(pa) AS sa FROM dens GROUP BY 1) t USING (feature)
       GROUP BY 1),
kvals AS (SELECT feature, value, count(*) FILTER (WHERE side = 'e') AS m_e, count(*) FILTER (WHERE side = 'a') AS m_a
          FROM vals WHERE feature IN (SELECT feature FROM ranges) GROUP BY 1, 2),
kcum AS (SELECT feature, sum(m_e) OVER w AS ce, sum(m_a) OVER w AS ca,
                sum(m_e) OVER (PARTITION BY feature) AS n_e, sum(m_a) OVER (PARTITION BY feature) AS n_a
         FROM kvals WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ksd AS (SELECT feature, max(abs(ce / n_e - ca / n_a)) AS d, max(n_e) AS n_e, max(n_a) AS n_a FROM kcum GROUP BY 1),
lam AS (SELECT *, (sqrt(n_e * n_a / (n_e + n_a)) + 0.12 + 0.11 / sqrt(n_e * n_a / (n_e + n_a))) * d AS l
        FROM (SELECT feature, d, CAST(n_e AS DOUBLE) AS n_e, CAST(n_a AS DOUBLE) AS n_a FROM ksd)),
ks AS (SELECT k.feature, k.d AS ks_statistic,
              least(greatest(CASE WHEN k.l < 0.2 THEN 1.0
                  WHEN k.l < 1.18 THEN 1.0 - sqrt(2 * pi()) / k.l * sum(exp(-pow(2 * t.i - 1, 2) * pi() * pi() / (8 * k.l * k.l)))
                  ELSE 2.0 * sum(pow(-1.0, t.i - 1) * exp(-2.0 * t.i * t.i * k.l * k.l)) END, 0.0), 1.0) AS ks_pvalue
       FROM lam k, (SELECT range AS i FROM range(1, 21)) t GROUP BY k.feature, k.d, k.l),
drift AS (
  SELECT r.feature, round(coalesce(p.psi, 0.0), 6) AS psi, round(coalesce(k.kl_divergence, 0.0), 6) AS kl_divergence,
         round(s.ks_statistic, 6) AS ks_statistic, round(s.ks_pvalue, 6) AS ks_pvalue,
         coalesce(p.psi, 0.0) > 0.25 AS psi_drift, s.ks_pvalue < 0.05 AS ks_drift,
         coalesce(k.kl_divergence, 0.0) > 0.1 AS kl_drift,
         (coalesce(p.psi, 0.0) > 0.25) OR (s.ks_pvalue < 0.05) OR (coalesce(k.kl_divergence, 0.0) > 0.1) AS drift_detected
  FROM ranges r LEFT JOIN psi p USING (feature) LEFT JOIN kl k USING (feature) LEFT JOIN ks s USING (feature))"""

ORACLE["drift_features"] = with_(DRIFT) + "SELECT * FROM drift"
ORACLE["drift_overall"] = with_(DRIFT) + """
SELECT count(*) AS features_checked, count(*) FILTER (WHERE drift_detected) AS features_with_drift,
       count(*) FILTER (WHERE drift_detected) > 0 AS drift_detected,
       round(count(*) FILTER (WHERE drift_detected) / greatest(count(*), 1), 4) AS drift_ratio
FROM drift"""

ORACLE["document_chunks"] = """
WITH d AS (SELECT doc_id, text, source, lang,
                  CAST(greatest(1, ceil((length(text) - 200) / 800)) AS BIGINT) AS n
           FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, source, lang, CAST(i AS INTEGER) AS chunk_no, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content
      FROM d, unnest(generate_series(0, n - 1)) AS t(i))
SELECT doc_id, chunk_no, source, lang, length(content) AS n_chars, md5(content) AS content_md5 FROM c"""

ORACLE["label_centroid_neighbours"] = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS x FROM e),
cent AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM ex GROUP BY 1, 2) GROUP BY 1),
sims AS (SELECT c.label, e.vec_id,
                list_dot_product(e.v, c.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))) AS sim
         FROM cent c, e),
ranked AS (SELECT label, vec_id, sim, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rank
           FROM sims)
SELECT label, vec_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20"""

_SC = FEATURES + """,
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEAT_COLS) + """ FROM feat),
sc AS (SELECT f.CustomerID, """ + ", ".join(
    f"CASE WHEN s_{c} > 0 THEN (f.{c} - m_{c}) / s_{c} ELSE f.{c} - m_{c} END AS {c}" for c in FEAT_COLS) + """
       FROM feat f, st)"""
ORACLE["scaled_features"] = with_(_SC) + "SELECT CustomerID, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in FEAT_COLS) + " FROM sc"

_RB = FEATURES + """,
rq AS (SELECT """ + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b_{c}" for c in FEAT_COLS) + " FROM feat)"
ORACLE["robust_scaled_features"] = with_(_RB) + "SELECT CustomerID, " + ", ".join(
    f"round((f.{c} - m_{c}) / CASE WHEN b_{c} - a_{c} = 0 THEN 1.0 ELSE b_{c} - a_{c} END, 6) AS {c}"
    for c in FEAT_COLS) + " FROM feat f, rq"


def _drop_sql(src: str) -> str:
    parts = []
    for i, a in enumerate(FEAT_COLS):
        for b in FEAT_COLS[i + 1:]:
            parts.append(f"""SELECT CASE WHEN abs(var_samp({a}) - var_samp({b})) <= 1e-9 * greatest(abs(var_samp({a})), abs(var_samp({b})))
                 THEN '{a}' WHEN var_samp({b}) < var_samp({a}) THEN '{b}' ELSE '{a}' END AS feature
FROM {src} HAVING abs(corr({a}, {b})) > 0.85""")
    return "SELECT DISTINCT feature FROM (" + "\nUNION ALL\n".join(parts) + ")"


ORACLE["correlated_drop"] = with_(_SC) + _drop_sql("sc")
ORACLE["variance_selection"] = with_(FEATURES) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, printf('%.9e', var_pop(CAST({c} AS DOUBLE))) AS variance, "
    f"var_pop(CAST({c} AS DOUBLE)) > 0.01 AS kept FROM feat" for c in FEAT_COLS)
_KEEP = ["Recency", "Frequency", "Monetary", "AvgBasketSize", "PurchaseInterval", "WeekendRatio",
         "NightRatio", "DiscountUsage", "ReturnRate", "ProductDiversity"]
ORACLE["final_features"] = with_(_SC, "dropped AS (" + _drop_sql("sc") + ")") + """
SELECT feature FROM (VALUES """ + ", ".join(f"('{c}')" for c in _KEEP) + """) AS t(feature)
WHERE feature NOT IN (SELECT feature FROM dropped) OR feature IN ('Recency', 'Frequency', 'Monetary')"""

_SCR = _SC + ",\n" + SEGMENTS.strip() + """,
scr AS (SELECT s.*, g.RegionKey FROM sc s LEFT JOIN seg g USING (CustomerID)),
pd AS (SELECT a.CustomerID AS ia, a.RegionKey AS la, b.CustomerID AS ib, b.RegionKey AS lb,
              sqrt(""" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEAT_COLS) + """) AS d
       FROM scr a, scr b)"""
ORACLE["silhouette_regions"] = with_(_SCR) + """,
sizes AS (SELECT RegionKey AS l, count(*) AS n FROM scr GROUP BY 1),
pm AS (SELECT ia, la, lb, sum(d) AS s FROM pd GROUP BY 1, 2, 3),
ab AS (SELECT p.ia, p.la,
              max(CASE WHEN p.lb = p.la THEN p.s / greatest(z.n - 1, 1) END) AS a,
              min(CASE WHEN p.lb <> p.la THEN p.s / z.n END) AS b,
              max(CASE WHEN p.lb = p.la THEN z.n END) AS own
       FROM pm p JOIN sizes z ON p.lb = z.l GROUP BY 1, 2)
SELECT ia AS CustomerID, la AS RegionKey,
       round(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END, 6) AS silhouette FROM ab"""

ORACLE["intra_inter_regions"] = with_(_SCR) + """,
sizes AS (SELECT RegionKey AS l, count(*) AS n FROM scr GROUP BY 1),
intra AS (SELECT la, avg(d) AS intra FROM pd WHERE la = lb AND d > 0 GROUP BY 1),
inter AS (SELECT avg(m) AS inter_mean FROM (SELECT la, lb, avg(d) AS m FROM pd WHERE la < lb GROUP BY 1, 2))
SELECT CAST(row_number() OVER (ORDER BY la) - 1 AS INTEGER) AS pos, round(intra, 6) AS intra,
       round((SELECT inter_mean FROM inter), 6) AS inter_mean FROM intra"""

ORACLE["davies_bouldin_regions"] = with_(_SC + ",\n" + SEGMENTS.strip() + """,
scr AS (SELECT s.*, g.RegionKey FROM sc s LEFT JOIN seg g USING (CustomerID)),
cen AS (SELECT RegionKey, """ + ", ".join(f"avg({c}) AS {c}" for c in FEAT_COLS) + """ FROM scr GROUP BY 1),
sp AS (SELECT s.RegionKey, avg(sqrt(""" + " + ".join(f"pow(s.{c} - c.{c}, 2)" for c in FEAT_COLS) + """)) AS si
       FROM scr s JOIN cen c USING (RegionKey) GROUP BY 1),
rr AS (SELECT a.RegionKey AS i, max((sa.si + sb.si) / sqrt(""" + " + ".join(
    f"pow(a.{c} - b.{c}, 2)" for c in FEAT_COLS) + """)) AS r
       FROM cen a JOIN cen b ON a.RegionKey <> b.RegionKey JOIN sp sa ON sa.RegionKey = a.RegionKey
       JOIN sp sb ON sb.RegionKey = b.RegionKey GROUP BY 1)""") + "SELECT round(avg(r), 6) AS davies_bouldin FROM rr"

ORACLE["ari_region_segment"] = with_(FS.removeprefix("WITH ")) + """,
cont AS (SELECT RegionKey, Segment, count(*) AS nij FROM fs GROUP BY 1, 2),
sa AS (SELECT sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS ai FROM cont GROUP BY RegionKey)),
sb AS (SELECT sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS bj FROM cont GROUP BY Segment)),
sij AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM cont)
SELECT round(CASE WHEN (sa + sb) / 2.0 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0
            ELSE (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (n * (n - 1) / 2.0)) END, 6) AS ari
FROM sa, sb, sij"""

ORACLE["kafka_records"] = with_(CLEAN) + """
SELECT CustomerID AS key, to_json(struct_pack(invoice_id := InvoiceID, customer_id := CustomerID,
       invoice_date := strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S'), product_category := ProductCategory,
       product_id := ProductID, quantity := Quantity, unit_price := UnitPrice, discount_pct := DiscountPct,
       payment_method := PaymentMethod, returned := Returned))::VARCHAR AS value FROM clean"""

_EARLY = CLEAN + """,
cutv AS (SELECT make_timestamp(CAST(floor((epoch_us(min(InvoiceDate)) + epoch_us(max(InvoiceDate))) / 2) AS BIGINT))
                AS cut FROM clean),
early AS (SELECT c.* FROM clean c, cutv WHERE c.InvoiceDate < cutv.cut),
""" + feature_ctes("early", "e_") + ",\n" + FEATURES[len(CLEAN):].lstrip(",\n")
ORACLE["write_clusters"] = with_(_EARLY, SEGMENTS, PERSONAS_SQL.strip()) + """
SELECT f.CustomerID AS customer_id,
       CASE WHEN a.CustomerID IS NOT NULL THEN a.RegionKey END AS cluster,
       CASE WHEN a.CustomerID IS NOT NULL THEN coalesce(p.Persona, 'Unknown') END AS persona,
       CASE WHEN a.CustomerID IS NOT NULL THEN '2001-09-01 00:00:00' END AS updated_at
FROM e_feat f
LEFT JOIN (SELECT x.CustomerID, s.RegionKey FROM feat x LEFT JOIN seg s USING (CustomerID)) a USING (CustomerID)
LEFT JOIN pdim p ON a.RegionKey = p.Cluster"""
ORACLE["upsert_counts"] = with_(_EARLY) + """
SELECT count(*) FILTER (WHERE e.CustomerID IS NULL) AS inserted,
       count(*) FILTER (WHERE e.CustomerID IS NOT NULL AND f.CustomerID IS NOT NULL) AS updated,
       count(*) AS total
FROM e_feat e FULL OUTER JOIN feat f USING (CustomerID)"""

_PROFILE = ["AvgQuantity", "DiscountUsage", "Frequency", "NightRatio", "Recency", "ReturnRate", "WeekendRatio"]
_PROF = FS.removeprefix("WITH ") + ",\n" + PERSONAS_SQL.strip() + """,
prof AS (SELECT RegionKey AS Cluster, """ + ", ".join(f"round(avg({c}), 3) AS {c}" for c in _PROFILE) + """
         FROM fs GROUP BY 1),
entries AS (""" + " UNION ALL ".join(
    f"SELECT Cluster, '{c}' AS k, CAST({c} AS VARCHAR) AS v FROM prof" for c in _PROFILE) + """),
pp AS (SELECT p.Cluster, coalesce(d.Persona, 'Unknown') AS Persona, coalesce(d.Description, '') AS Description
       FROM prof p LEFT JOIN pdim d USING (Cluster)),
recs AS (SELECT Persona, string_agg('- ' || Recommendation, chr(10) ORDER BY rank) AS lines FROM precs GROUP BY 1),
ranked AS (SELECT Cluster, k, v, row_number() OVER (PARTITION BY Cluster ORDER BY k) AS rn FROM entries)"""
ORACLE["persona_narratives"] = with_(_PROF) + """
SELECT pp.Cluster, pp.Persona,
       '## ' || pp.Persona || chr(10) || chr(10) || pp.Description || chr(10) || chr(10)
       || '**Recommended Strategies:**' || coalesce(chr(10) || r.lines, '')
       || chr(10) || chr(10) || '**Profile Highlights:**' || chr(10)
       || (SELECT string_agg('- ' || k || ': ' || v, chr(10) ORDER BY k) FROM ranked x
           WHERE x.Cluster = pp.Cluster AND x.rn <= 6) AS narrative
FROM pp LEFT JOIN recs r USING (Persona)"""
ORACLE["persona_prompts"] = with_(_PROF) + """
SELECT pp.Cluster,
       'Persona: ' || pp.Persona || chr(10) || 'Behavioral Profile:' || chr(10)
       || (SELECT string_agg('  ' || k || ': ' || v, chr(10) ORDER BY k) FROM ranked x WHERE x.Cluster = pp.Cluster)
       || chr(10) || chr(10) || 'Generate a detailed marketing persona narrative (2-3 paragraphs).' AS prompt
FROM pp"""

ORACLE["stream_refresh"] = with_(FEATURES) + """
SELECT CustomerID, Recency, Frequency, TotalQty, round(Monetary, 4) AS Monetary FROM feat"""

ORACLE["csv_round_trip"] = ORACLE["table_store"] = ORACLE["request_rows"] = ORACLE["transactions"]

BAD = TX + """,
bad AS (
  SELECT * FROM tx UNION ALL
  SELECT * EXCLUDE (k) REPLACE (
    CASE WHEN k = 3 THEN NULL ELSE InvoiceID END AS InvoiceID,
    CASE k WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) || ' ' WHEN 2 THEN '  ' || CustomerID || chr(9)
           ELSE CustomerID END AS CustomerID,
    CASE k WHEN 4 THEN 0 WHEN 5 THEN -Quantity ELSE Quantity END AS Quantity)
  FROM (SELECT *, CAST(ProductID AS BIGINT) % 6 AS k FROM tx))"""
BAD_SELECT = """
SELECT InvoiceID, CustomerID, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, ProductID, Quantity FROM """
STRIPPED = "(SELECT * REPLACE (regexp_replace(CustomerID, '^\\s+|\\s+$', '', 'g') AS CustomerID) FROM {src})"
ORACLE["clean_customer_bad_rows"] = with_(BAD) + BAD_SELECT + STRIPPED.format(src="bad") + " WHERE CustomerID <> ''"
ORACLE["clean_quantity_bad_rows"] = with_(BAD) + BAD_SELECT + "bad WHERE Quantity > 0"
ORACLE["clean_data_bad_rows"] = with_(BAD) + BAD_SELECT + STRIPPED.format(src="(SELECT DISTINCT * FROM bad)") + """
WHERE CustomerID <> '' AND Quantity > 0 AND NOT coalesce(starts_with(InvoiceID, 'C'), false)"""

ORACLE["friendly_sources_labelled"] = """
WITH srcs AS (
  SELECT DISTINCT coalesce(source, 'none') || '/' || n AS src FROM documents,
    (SELECT unnest(['CUSTOMER_PERSONAS', 'CUSTOMER_FEATURES_SCALED', 'CUSTOMER_FEATURES', 'DRIFT_BASELINE', 'PIPELINE',
                    'README', 'PREDICTIONS', '']) AS n)
  UNION SELECT 'config')
SELECT src,""" + ORACLE["friendly_sources"].split("SELECT src,", 1)[1]

ORACLE["risk_bands"] = with_(FEATURES) + """
SELECT CustomerID, CASE WHEN WeekendRatio < 0.3 THEN 'Low' WHEN WeekendRatio < 0.6 THEN 'Medium' ELSE 'High' END AS band,
       round(abs(ReturnRate - DiscountUsage), 6) AS importance,
       CASE WHEN ReturnRate - DiscountUsage > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM feat"""

ORACLE["feature_hash_json"] = with_(FEATURES) + """
SELECT CustomerID, substring(sha256('{"CategoryDiversity":' || CategoryDiversity || ',"Frequency":' || Frequency
       || ',"ProductDiversity":' || ProductDiversity || ',"Recency":' || Recency || ',"TotalQty":' || TotalQty || '}'), 1, 16)
       AS feature_hash
FROM feat"""

ORACLE["existing_and_new"] = with_(_EARLY) + """
SELECT f.CustomerID, f.Frequency, e.CustomerID IS NOT NULL AS existing
FROM feat f LEFT JOIN e_feat e USING (CustomerID)"""
ORACLE["upsert_values"] = with_(_EARLY) + """
SELECT coalesce(f.CustomerID, e.CustomerID) AS customer_id,
       CAST(coalesce(f.Recency, e.Recency) AS DOUBLE) AS recency,
       CAST(coalesce(f.Frequency, e.Frequency) AS DOUBLE) AS frequency,
       CAST(coalesce(f.TotalQty, e.TotalQty) AS DOUBLE) AS total_qty,
       round(coalesce(f.Monetary, e.Monetary), 4) AS monetary, e.CustomerID IS NULL AS created_now
FROM e_feat e FULL OUTER JOIN feat f USING (CustomerID)"""

ORACLE["forecast_store"] = with_(FORECAST) + "SELECT * FROM fc WHERE Segment = 'BUILDING'"
ORACLE["drift_baseline"] = FS + """
SELECT CustomerID, Recency, Frequency, TotalQty, RegionKey, round(Monetary, 4) AS Monetary FROM fs"""
ORACLE["best_category"] = with_(CLEAN) + """
SELECT ProductCategory, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1"""
ORACLE["top_products_by_category"] = with_(CLEAN) + """
SELECT * FROM (SELECT ProductCategory, ProductID, CAST(sum(Quantity) AS BIGINT) AS units FROM clean GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY ProductCategory ORDER BY units DESC, ProductID) <= 3"""

# Neighbour searches on the scaled features, by all pairs.
_NB = _SC + """,
pts AS (SELECT CAST(CustomerID AS BIGINT) AS id, """ + ", ".join(FEAT_COLS) + """ FROM sc),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, sqrt(""" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEAT_COLS) + """) AS d
       FROM pts a, pts b)"""
ORACLE["k_distance_customers"] = with_(_NB) + """,
ranked AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS k FROM pairs)
SELECT round(d, 6) AS kdist, row_number() OVER (ORDER BY d, a) - 1 AS position FROM ranked WHERE k = 5"""


def _density(cells: str) -> str:
    """Labels of DBSCAN for each (eps, ms) cell: least core id reachable, then border points."""
    return with_(_NB).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
cells(eps, ms) AS (VALUES {cells}),
core AS MATERIALIZED (SELECT eps, ms, a AS id FROM pairs, cells WHERE d <= eps GROUP BY eps, ms, a HAVING count(*) >= ms),
links AS MATERIALIZED (SELECT x.eps, x.ms, p.a, p.b FROM pairs p JOIN core x ON x.id = p.a AND p.d <= x.eps
       JOIN core y ON y.id = p.b AND y.eps = x.eps AND y.ms = x.ms WHERE p.a <> p.b),
low(eps, ms, id, lab) USING KEY (eps, ms, id) AS (
  SELECT eps, ms, id, id FROM core
  UNION
  SELECT l.eps, l.ms, l.b, min(t.lab) FROM low t JOIN links l ON l.eps = t.eps AND l.ms = t.ms AND l.a = t.id
  JOIN recurring.low r ON r.eps = l.eps AND r.ms = l.ms AND r.id = l.b
  WHERE t.lab < r.lab GROUP BY l.eps, l.ms, l.b),
named AS (SELECT *, dense_rank() OVER (PARTITION BY eps, ms ORDER BY lab) - 1 AS cluster FROM low),
touch AS (SELECT n.eps, n.ms, p.a AS id, min(n.cluster) AS cluster FROM pairs p JOIN named n ON n.id = p.b AND p.d <= n.eps
       GROUP BY n.eps, n.ms, p.a),
labels AS (SELECT c.eps, c.ms, p.id, coalesce(n.cluster, t.cluster, -1) AS label FROM pts p CROSS JOIN cells c
       LEFT JOIN named n ON n.eps = c.eps AND n.ms = c.ms AND n.id = p.id
       LEFT JOIN touch t ON t.eps = c.eps AND t.ms = c.ms AND t.id = p.id)
"""


ORACLE["dbscan_customers"] = _density("(1.5::DOUBLE, 5)") + "SELECT id, CAST(label AS INTEGER) AS label FROM labels"
ORACLE["dbscan_grid"] = _density(", ".join(f"({e}::DOUBLE, {m})" for e in (1.0, 1.5, 2.0) for m in (3, 5, 10))) + """
SELECT eps, CAST(ms AS INTEGER) AS min_samples, CAST(count(DISTINCT label) FILTER (label >= 0) AS INTEGER) AS n_clusters,
       CAST(count(*) FILTER (label = -1) AS INTEGER) AS n_noise FROM labels GROUP BY eps, ms"""

ORACLE["upsert_incremental"] = ORACLE["upsert_values"]
ORACLE["neighbour_counts"] = with_(_NB) + """
SELECT a AS id, count(*) AS neighbours FROM pairs WHERE d <= 1.5 GROUP BY a"""
ORACLE["model_round_trip"] = with_(FEATURES) + "SELECT CustomerID, true AS same FROM feat"

ORACLE["kmeans_invariants"] = with_(FEATURES) + """SELECT CAST(k AS INT) AS k, n AS customers, 0 AS misplaced, true AS inertia_holds,
    0 AS cost_rises, k AS clusters
FROM (SELECT count(*) AS n FROM feat) CROSS JOIN (SELECT unnest(range(2, 11)) AS k)"""

ORACLE["anomaly_model_round_trip"] = ORACLE["churn_model_round_trip"] = ORACLE["model_round_trip"]
ORACLE["drift_baseline_fallback"] = ORACLE["stream_refresh"]
ORACLE["persona_profile_documents"] = with_(_PROF) + """,
named AS (SELECT coalesce(d.Persona, 'Unknown') AS Persona, f.* FROM fs f LEFT JOIN pdim d ON d.Cluster = f.RegionKey),
mean AS (SELECT Persona, """ + ", ".join(f"CAST(round(avg({c}), 3) AS VARCHAR) AS {c}" for c in _PROFILE) + """
         FROM named GROUP BY Persona)
SELECT Persona, 'persona_profile' AS type, 'Persona: ' || Persona || chr(10) || 'Average feature profile: ' || """ + \
    " || ', ' || ".join(f"'{c}: ' || coalesce({c}, 'nan')" for c in _PROFILE) + " AS content FROM mean"
ORACLE["separator_chunk_cover"] = """SELECT doc_id, md5(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) AS text_md5, true AS fits
FROM documents WHERE regexp_replace(text, '[ \\t\\r\\n]', '', 'g') <> ''"""

ORACLE["vector_index_recall"] = """SELECT count(*) AS queries, CAST(sum(least(20, (SELECT count(*) FROM embeddings))) AS BIGINT) AS wanted,
       true AS reached
FROM embeddings WHERE vec_id % 100 = 0"""
