"""Helpers shared by the operators of this subpackage: written tables in the
shared folder, complete-group streaming over sorted Arrow batches, block
splitting of large buckets, and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import scratch_path


def store(df: DataFrame, tag: str, partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_groups(batches, key: str):
    """From record batches sorted by ``key`` (equal keys adjacent, possibly
    straddling batches) yield tables that hold only complete groups."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        k = t.column(key).to_numpy()
        cut = _last_start(k)
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _last_start(k: np.ndarray) -> int:
    """Index where the last run of equal values begins."""
    diff = np.flatnonzero(k[1:] != k[:-1])
    return int(diff[-1]) + 1 if len(diff) else 0


def group_pairs(g: np.ndarray, own: np.ndarray, diag: np.ndarray, limit: int = 1 << 20):
    """Pairs (i, j), i < j, of rows with the same group id in a sorted array;
    in an off-diagonal block only rows of different blocks pair up. Yields
    index arrays, a bounded number at a time."""
    out_i, out_j, n, s = [], [], 0, 1
    while True:
        i = np.flatnonzero(g[:-s] == g[s:]) if s < len(g) else np.empty(0, np.int64)
        if not len(i):
            break
        keep = diag[i] | (own[i] != own[i + s])
        i = i[keep]
        out_i.append(i)
        out_j.append(i + s)
        n += len(i)
        if n >= limit:
            yield np.concatenate(out_i), np.concatenate(out_j)
            out_i, out_j, n = [], [], 0
        s += 1
    if n:
        yield np.concatenate(out_i), np.concatenate(out_j)


def star_edges(a: np.ndarray, b: np.ndarray):
    """Reduce an edge list to (node, root) rows of its components, root = the
    smallest node; roots themselves are left out. At most one row a node."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, lab):
            break
        lab = new
    keep = lab != np.arange(len(nodes))
    return nodes[keep], nodes[lab[keep]]


class EdgeSink:
    """Collects verified pairs and keeps them reduced to star edges, so that a
    dense group never holds more than a row for each of its nodes."""

    def __init__(self, limit: int = 1 << 18):
        self.a, self.b, self.n, self.limit = [], [], 0, limit

    def add(self, a, b):
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > self.limit:
                self.reduce()
                self.limit = max(self.limit, 2 * self.n)

    def reduce(self):
        if self.a:
            a, b = star_edges(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.n = [a], [b], len(a)
        return (self.a[0], self.b[0]) if self.a else (np.empty(0, np.int64), np.empty(0, np.int64))


def split_buckets(rows: DataFrame, key: str, ident: str, block: int,
                  need: str | None = None, payload: DataFrame | None = None) -> DataFrame:
    """Rows of buckets (equal ``key``) with two or more members, dealt so that
    every pair of a bucket meets in one group.

    A bucket of n rows is cut into ceil(n / block) blocks by a hash of
    ``ident`` and each pair of blocks becomes a group, so a bucket that holds a
    third of all rows spreads over many tasks and a group stays near
    ``2 * block`` rows. ``need`` names a boolean that at least one row of a
    bucket must have; ``payload`` is joined on ``ident`` after lonely rows are
    gone. Rows are often exploded from a small table and then many times what Spark takes
    them for, so no side of a join is broadcast. Adds ``g`` (group id; partitions come sorted by it), ``own`` (block)
    and ``diag`` (the group pairs a block with itself).
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                  F.max(need if need else F.lit(True)).alias("_need"))
    j = rows.join(sizes.filter("_n > 1 and _need").drop("_need").hint("merge"), key)
    if payload is not None:
        j = j.join(payload.hint("merge"), ident)
    j = (j.withColumn("_nb", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
          .withColumn("own", F.expr(f"cast(pmod(xxhash64({ident}, 7L), _nb) as int)"))
          .withColumn("_o", F.explode(F.expr("sequence(0, _nb - 1)"))))
    j = (j.withColumn("g", F.xxhash64(key, F.least("own", "_o"), F.greatest("own", "_o")))
          .withColumn("diag", F.col("own") == F.col("_o")).drop("_n", "_nb", "_o"))
    return j.repartition("g").sortWithinPartitions("g")


def row_keys(*cols) -> list:
    """Two 64-bit hashes that together name a row by the given columns."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(1), *cols).alias("_k2")]


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components by contraction: (node, root) for every node of
    ``edges`` (long columns a, b); root is one node of the component.

    Each round maps every node to the first of its closed neighbourhood (in
    natural order on even rounds, which finishes star graphs at once; in a
    seeded hashed order on odd rounds, which shrinks chains by a constant
    factor) and contracts the edges. Rounds are written to the shared folder.
    """
    e = store(edges.filter("a <> b").select("a", "b").distinct(), f"{tag}-edges")
    empty = e.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    maps, turn = [], 0
    while not e.isEmpty():
        def order(c, turn=turn):
            return F.struct((F.lit(0).cast("long") if turn % 2 == 0
                             else F.xxhash64(F.col(c), F.lit(turn))).alias("o"), F.col(c).alias("v"))
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        f = (both.groupBy("a").agg(F.min(order("b")).alias("m"))
                 .select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("root")))
        f = store(f, f"{tag}-map")
        maps.append(f)
        fa = f.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        fb = f.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = (e.join(fa, "a").join(fb, "b").filter("ra <> rb")
              .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        e = store(e, f"{tag}-edges")
        turn += 1
    if not maps:
        return empty
    out = maps[-1]
    for f in reversed(maps[:-1]):
        nxt = out.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        out = f.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return out
