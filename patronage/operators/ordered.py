"""Exact cumulative sums over a value order without a global sort, and exact quantiles.

A window ordered over a whole table runs in one task. Instead the distinct
values of all keys are dealt by range to as many buckets as the session has
shuffle partitions, so their number grows with the cluster and the input it is
sized for; bucket totals (at most keys + buckets rows) give each bucket's
starting offset, and a window inside each bucket finishes the exact running
sum. A hot value is a single row, and a key with most values spreads over many buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import stored

PIECES = 64            # of the values that are left between quantile brackets, in each round
ACCURACY = 10_000      # of the sketch that brackets quantiles
DRIVER_ROWS = 1 << 16  # values with counts that the driver ranks at the end


def running_totals(counts: DataFrame, keys: list[str], order_col: str, measures: list[str],
                   n_buckets: int | None = None, descending: bool = False,
                   prefix: str = "cum_") -> DataFrame:
    """``counts`` has one row per (keys, order_col). Adds ``cum_<m>``: the sum
    of ``m`` over rows whose ``order_col`` is <= the row's (>= when
    ``descending``), the row itself included. ``n_buckets`` defaults to the
    session's shuffle partitions."""
    spark = counts.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sign = F.lit(-1.0 if descending else 1.0)
    # the dealing samples its input: it is written before anything relies on it
    dealt = stored(counts.withColumn("__ord", F.col(order_col).cast("double") * sign)
                         .repartitionByRange(n_buckets, *keys, "__ord")
                         .withColumn("__bucket", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "__bucket").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    wk = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), *[
        F.coalesce(F.sum(f"__t_{m}").over(wk), F.lit(0)).alias(f"__o_{m}") for m in measures])
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):  # a null key is a key
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = dealt.join(F.broadcast(offsets), same, "left")
    wb = (Window.partitionBy(*keys, "__bucket").orderBy("__ord")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select(*counts.columns, *[
        (F.col(f"__o_{m}") + F.sum(m).over(wb)).alias(f"{prefix}{m}") for m in measures])


def exact_quantiles(df: DataFrame, col: str, ps: list[float], n_buckets: int = PIECES) -> list:
    """``column_quantiles`` of one column."""
    return column_quantiles(df, [col], ps, n_buckets=n_buckets)[col]


def exact_quantile(df: DataFrame, col: str, p: float, n_buckets: int = PIECES):
    """One interpolated quantile as a literal Column."""
    return F.lit(exact_quantiles(df, col, [p], n_buckets)[0])


def column_quantiles(df: DataFrame, cols: list[str], ps: list[float], held: bool = False, accuracy: int = ACCURACY,
                     driver_rows: int = DRIVER_ROWS, n_buckets: int = PIECES) -> dict:
    """Exact interpolated quantiles of several columns (pandas / numpy ``linear``, DuckDB
    ``quantile_cont``): {column: [q for p in ps]}; None for a column without values.

    The columns are written once (unless ``held`` says that ``df`` is such a table). One sketch pass
    brackets every wanted rank; one counting pass counts what lies between the brackets as
    a whole and what lies inside by value, so no value outside leaves its task. While more than
    ``driver_rows`` values are left, they are cut into ``n_buckets`` pieces at quantiles of their own and only the
    pieces that hold a wanted rank are kept. A rank that the sketch should have missed widens its
    column's bracket to everything, so the result is exact in any case."""
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    data = data if held else stored(data)
    near = [min(1.0, max(0.0, p + e)) for p in ps for e in (-2 / accuracy, 2 / accuracy)]
    aggs = []
    for i in range(len(cols)):
        aggs += [F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", near, accuracy).alias(f"q{i}")]
    first = data.agg(*aggs).first()
    total = {i: first[f"n{i}"] for i in range(len(cols)) if first[f"n{i}"]}
    wanted = {i: sorted({r for p in ps for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}) for i, n in total.items()}
    spans = {i: _joined(list(zip(first[f"q{i}"][::2], first[f"q{i}"][1::2]))) for i in total}
    while True:
        regions, inside = _count_regions(data, spans)
        missed = [i for i in total if not _ranks_inside(regions[i], wanted[i])]
        if not missed:
            break
        spans.update({i: [(float("-inf"), float("inf")), ] for i in missed})
    at = _values_at(inside, regions, wanted, driver_rows, n_buckets)
    out = {}
    for i, c in enumerate(cols):
        if i not in total:
            out[c] = [None] * len(ps)
            continue
        hs = [(total[i] - 1) * p for p in ps]
        out[c] = [at[i][math.floor(h)] + (h - math.floor(h)) * (at[i][math.ceil(h)] - at[i][math.floor(h)])
                  if math.floor(h) != h else at[i][math.floor(h)] for h in hs]
    return out


def _joined(spans: list[tuple]) -> list[tuple]:
    """Disjoint brackets in order that cover the same values."""
    out = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _count_regions(data: DataFrame, spans: dict):
    """({column: counts of its regions}, table k, g, v, c of the values inside).
    Regions alternate: before the first bracket, in it, after it and so on; a bracket's region is odd."""
    parts = []
    for i, brackets in spans.items():
        v = F.col(f"c{i}")
        region = F.lit(2 * len(brackets))
        for j, (lo, hi) in reversed(list(enumerate(brackets))):
            region = F.when(v < lo, 2 * j).when((v <= hi) | F.lit(hi == float("inf")), 2 * j + 1).otherwise(region)
        parts.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("k"), region.alias("g"),
                                                    F.when(region % 2 == 1, v).alias("v"))))
    if not parts:
        return {}, None
    counts = stored(data.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
                        .groupBy("k", "g", "v").agg(F.count(F.lit(1)).alias("c")))
    regions = {i: [0] * (2 * len(b) + 1) for i, b in spans.items()}
    for r in counts.groupBy("k", "g").agg(F.sum("c").alias("c")).collect():
        regions[r["k"]][r["g"]] = r["c"]
    return regions, counts.filter("g % 2 = 1")


def _ranks_inside(regions: list[int], ranks: list[int]) -> bool:
    edge = [sum(regions[:g]) for g in range(len(regions) + 1)]
    return all(any(edge[g] <= r < edge[g + 1] for g in range(1, len(regions), 2)) for r in ranks)


def _values_at(counts: DataFrame, regions: dict, wanted: dict, driver_rows: int, n_buckets: int) -> dict:
    """{column: {rank: value}} from the values inside the brackets."""
    if not wanted:
        return {}
    # groups of values that stand together: (column, group) -> how many values come before
    before = {(k, g): sum(n[:g]) for k, n in regions.items() for g in range(1, len(n), 2)}
    while counts.count() > driver_rows:
        cuts = {(r["k"], r["g"]): sorted(set(r["q"])) for r in counts.groupBy("k", "g").agg(
            F.percentile_approx("v", [j / n_buckets for j in range(1, n_buckets)], 1000).alias("q")).collect()}
        piece = F.lit(None).cast("int")
        for (k, g), q in cuts.items():
            edges = F.array(*[F.lit(x) for x in q])
            piece = F.when((F.col("k") == k) & (F.col("g") == g), F.size(F.filter(edges, lambda b: b < F.col("v")))).otherwise(piece)
        cut = counts.withColumn("piece", piece)
        sizes = {}
        for r in cut.groupBy("k", "g", "piece").agg(F.sum("c").alias("c")).collect():
            sizes.setdefault((r["k"], r["g"]), {})[r["piece"]] = r["c"]
        keep, later = {}, {}
        for (k, g), n in sizes.items():
            at = before[(k, g)]
            for j in sorted(n):
                if any(at <= r < at + n[j] for r in wanted[k]):
                    keep[(k, g, j)] = g * n_buckets + j
                    later[(k, g * n_buckets + j)] = at
                at += n[j]
        new = F.lit(None).cast("int")
        for (k, g, j), name in keep.items():
            new = F.when((F.col("k") == k) & (F.col("g") == g) & (F.col("piece") == j), name).otherwise(new)
        smaller = stored(cut.withColumn("g", new).filter("g is not null").drop("piece"))
        if smaller.count() >= counts.count():
            break
        counts, before = smaller, later
    out = {k: {} for k in wanted}
    rows = {}
    for r in counts.collect():
        rows.setdefault((r["k"], r["g"]), []).append((r["v"], r["c"]))
    for (k, g), values in rows.items():
        at = before[(k, g)]
        for v, c in sorted(values):
            for r in wanted[k]:
                if at <= r < at + c:
                    out[k][r] = v
            at += c
    return out
