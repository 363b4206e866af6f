"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code-point order (null
last) get repeating weights and share a budget; a target stops at a multiple
of its source's size and the excess is shared again by weight. A source is
taken whole as often as its target allows; for the rest of its budget the
documents are counted by exact size, a proportional share of every size is
taken, and bounded-knapsack dynamic programming over the sizes left fills what
remains: first by the largest sizes down to a window of ``WINDOW`` words and
exactly inside it; where that is not as near as can be, by the sums of all
documents left against all that remains, then by the sums of all documents
against the whole budget. The nearest of these is taken. Sums are held one by
one up to ``sums`` of them, and the fit is as near as any choice could be; from then on
one is held for each budget / ``sums`` words, with its exact value, every sum met is compared, and what a
source misses its budget by stays in the order of those words. Each row carries its source's
``miss``, so a fit that is not exact is seen. Which documents of a size are taken is
decided by a seeded hash.

Documents never gather by source: they are counted by (source, size, hash
bucket), and only those counts are fitted. A group of one size is cut by its
256 hash buckets, so no task ranks more than one bucket of a hot group. The
driver holds a few sums a round.

Null texts have size 0 and are taken for nothing. Repeated rows are rows of
their own. Reruns take the same rows (equal rows are interchangeable).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import row_keys, store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 17
WINDOW = 1 << 16
SUMS = 1 << 20


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """_k1, _k2 (the row), doc_id, source, skey, size and hash bucket of every row."""
    src = docs.select(docs[id_col].alias("doc_id"), *row_keys(docs[id_col], docs[text_col], docs[source_col]),
                      docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            n = [len((t or "").encode("utf-8", "surrogatepass").split()) for t in b.column("_text").to_pylist()]
            cols = [b.column(c) for c in ("doc_id", "_k1", "_k2", "source")]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(n, pa.int64())], ["doc_id", "_k1", "_k2", "source", "size"])

    out = src.mapInArrow(run, src.drop("_text").schema.add("size", "long"))
    return (out.withColumn("skey", F.xxhash64(F.col("source").isNull(), "source"))
               .withColumn("order", F.xxhash64(F.lit(seed), "_k1", "_k2"))
               .withColumn("bucket", F.expr("cast(shiftrightunsigned(order, 56) as int)")))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size): water
    filling by weight below the caps, one small aggregate a round."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    # the table of sources is small beside the documents: one row a distinct source
    t = store(per_source.select("skey", "source_size", w.alias("w")), "mix-sources")
    total = t.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    limit = F.lit(float(cap)) * F.col("source_size")
    level, capped = 0.0, -1
    while total:
        full = F.col("w") * F.lit(level) > limit
        r = t.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"),
                  F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        level, capped = (share * total - r["c"]) / r["w"], r["n"]
    return t.select("skey", "source_size", F.least(limit, F.col("w") * F.lit(level)).alias("target"))


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum comes as near to
    ``budget`` as it can, by bounded subset sum; it passes the budget by less
    than the smallest size, and only if that is nearer."""
    take = np.zeros(len(size), np.int64)
    if budget <= 0 or not (count > 0).any():
        return take
    top = budget + int(size[count > 0].min())
    maker = np.full(top + 1, -1, np.int32)
    maker[0] = -2
    items = []
    for k in np.argsort(-size, kind="stable").tolist():
        s, left, piece = int(size[k]), int(count[k]), 1
        while s > 0 and left > 0 and s * min(piece, left) <= top:
            p = min(piece, left)
            w = s * p
            fresh = np.flatnonzero((maker[:-w] != -1) & (maker[w:] == -1)) + w
            maker[fresh] = len(items)
            items.append((k, p, w))
            left -= p
            piece *= 2
        if maker[budget] != -1:
            break
    sums = np.flatnonzero(maker != -1)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        k, p, w = items[maker[at]]
        take[k] += p
        at -= w
    return take


def least_miss(size: np.ndarray, count: np.ndarray, budget: int) -> int:
    """How far from ``budget`` any sum must stay: the sizes' common divisor and
    their total tell."""
    held = (count > 0) & (size > 0)
    if not held.any():
        return budget
    g = int(np.gcd.reduce(size[held]))
    return max(budget - int((size * count)[held].sum()), min(budget % g, -budget % g))


def nearest(size: np.ndarray, count: np.ndarray, budget: int, sums: int = SUMS) -> np.ndarray:
    """How many of each size to take so that their sum comes near ``budget``,
    above or below: exactly as near as it can while there are no more than
    ``sums`` different sums below it."""
    take = np.zeros(len(size), np.int64)
    if budget <= 0:
        return take
    floor = least_miss(size, count, budget)
    real, maker, parent = np.zeros(1, np.int64), np.full(1, -1, np.int32), np.full(1, -1, np.int32)
    miss, end, items = budget, (0, -1), []
    # words a cell; 0: sums are told apart by their value
    unit, full = int(budget <= sums), np.zeros(sums + 1, bool)
    full[0] = True
    for k in np.argsort(-size, kind="stable").tolist():
        s, left, piece = int(size[k]), int(count[k]), 1
        while s > 0 and left > 0 and miss > floor:
            p = min(piece, left)
            left -= p
            piece *= 2
            new = real + s * p
            d = np.abs(new - budget)
            at = int(d.argmin())
            if d[at] < miss:
                miss, end = int(d[at]), (at, len(items))
            fresh = np.flatnonzero(new < budget)
            if unit:
                fresh = fresh[~full[new[fresh] // unit]]
                cell, one = np.unique(new[fresh] // unit, return_index=True)
                full[cell] = True
                fresh = fresh[one]
            else:
                fresh = fresh[~np.isin(new[fresh], real)]
            real = np.concatenate([real, new[fresh]])
            maker = np.concatenate([maker, np.full(len(fresh), len(items), np.int32)])
            parent = np.concatenate([parent, fresh.astype(np.int32)])
            items.append((k, p))
            if not unit and len(real) > sums:
                unit = -(-budget // sums)
                full[real // unit] = True
    at, item = end
    while item >= 0:
        k, p = items[item]
        take[k] += p
        item, at = int(maker[at]), int(parent[at])
    return take


def fit(size: np.ndarray, count: np.ndarray, budget: int, window: int = WINDOW, sums: int = SUMS) -> np.ndarray:
    """How many documents of each size to take once for a budget of words."""
    total = int((size * count).sum())
    if total <= 0 or budget <= 0:
        return np.zeros(len(size), np.int64)
    share = np.minimum(count, np.floor(count * (budget / total)).astype(np.int64))
    left = budget - int((share * size).sum())
    while left < 0:  # rounding of a very large count
        k = int(np.argmax(np.where(share > 0, size, -1)))
        share[k] -= 1
        left += int(size[k])
    best = share + fill(size, count - share, left, window)
    for start, rest in ((share, left), (np.zeros(len(size), np.int64), budget)):
        miss = abs(budget - int((best * size).sum()))
        if miss <= least_miss(size, count - start, rest):
            continue
        other = start + nearest(size, count - start, rest, sums)
        if abs(budget - int((other * size).sum())) < miss:
            best = other
    return best


def fill(size: np.ndarray, count: np.ndarray, left: int, window: int) -> np.ndarray:
    """The largest sizes down to ``window`` words, then ``knapsack``."""
    take = np.zeros(len(size), np.int64)
    for k in np.argsort(-size, kind="stable").tolist():
        if left <= window:
            break
        s = int(size[k])
        more = min(int(count[k]), -(-(left - window) // max(1, s)), left // max(1, s)) if s else 0
        take[k] += more
        left -= more * s
    small = (size <= 2 * left) & (size > 0) & (count > take)
    at = np.flatnonzero(small)
    take[at] += knapsack(size[at], (count - take)[at], min(left, window))
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, window: int = WINDOW, sums: int = SUMS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and miss (words that
    its source's mix is off its rounded target) of every row, with _k1 and _k2 that name the row and copies, how often it is
    taken."""
    rows = store(sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    buckets = store(rows.groupBy("skey", "size", "bucket")
                        .agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")), "mix-buckets")
    hist = buckets.groupBy("skey", "size").agg(F.sum("n").alias("n"), F.min("source").alias("source"))
    per = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min("source").alias("source"))
    plan = targets(per, weights, share, cap)
    plan = (plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                            .otherwise(0).cast("long"))
                .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        size, rest = pdf["size"].to_numpy(np.int64), int(pdf["rest"].iloc[0])
        extra = fit(size, pdf["n"].to_numpy(np.int64), rest, window, sums)
        return pdf.assign(extra=extra, miss=abs(rest - int((extra * size).sum())))

    schema = "skey long, size long, n long, source_size long, target double, passes long, rest long, extra long, miss long"
    fitted = (hist.drop("source").join(plan, "skey").groupBy("skey")
                  .applyInPandas(choose, schema).drop("n", "rest"))
    before = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("bucket")
                             .rowsBetween(Window.unboundedPreceding, -1))
    cuts = (buckets.drop("source").join(fitted, ["skey", "size"])
                   .withColumn("quota", F.greatest(F.lit(0).cast("long"), F.col("extra") - F.coalesce(before, F.lit(0))))
                   .drop("n", "extra"))
    turn = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("order", "_k1", "_k2"))
    return (rows.join(cuts, ["skey", "size", "bucket"])
                .withColumn("copies", F.col("passes") + (turn <= F.col("quota")).cast("long"))
                .select("doc_id", "_k1", "_k2", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"), "miss", "copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    taken = mix(docs, id_col, text_col, source_col, **options)
    # equal rows share their keys: their copies are added up, then dealt to them in turn
    per = taken.groupBy("_k1", "_k2").agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select(*[docs[c] for c in docs.columns], *row_keys(docs[id_col], docs[text_col], docs[source_col]))
    turn = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1", "_k2"))
    each = F.floor(F.col("_sum") / F.col("_rows")) + (F.col("_turn") <= F.col("_sum") % F.col("_rows")).cast("long")
    return (keyed.join(per.filter("_sum > 0"), ["_k1", "_k2"]).withColumn("_turn", turn)
                 .withColumn("_copies", each.cast("int"))
                 .withColumn("_copy", F.explode(F.expr("if(_copies > 0, sequence(1, _copies), array())")))
                 .select(*docs.columns))
