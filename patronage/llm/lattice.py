"""Embedding near-dedup by E8 lattice hashing.

Each unit vector is projected by ``TABLES`` seeded Gaussian matrices to eight
dimensions and decoded to its nearest point of the E8 lattice, its home cell.
It also visits the ``PROBES`` neighbouring cells (of the 240 around its home)
that lie nearest. Two vectors of one label are compared where one is at home
in a cell that the other is at home in or visits, and linked if their cosine
in double precision reaches the threshold.

Equal vectors are one class with a weight, so copies cost one row. Large cells
are split into block pairs. A pair that meets in several cells counts where it
meets first, which both rows' cell lists tell, so link counts need no shuffle
of pairs; links leave a task as counts per row and as star edges.

Vectors that are null, empty or zero, or hold null or non-finite components,
and rows with a null label or vec_id link with nothing: no links, a component
of their own. Vectors of different lengths are never compared. Repeated rows
are vectors of their own that link with each other (cosine 1); so are rows that share
a vec_id but not a vector.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import EdgeSink, components, group_pairs, split_buckets, store, whole_groups

THRESHOLD = 0.93
TABLES = 6
PROBES = 8
SCALE = 0.8       # cell size: larger is finer
SEED = 1729
BLOCK_ROWS = 512
PAIR_CHUNK = 1 << 15


def min_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = min_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers with an even sum) to each row."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    if len(odd):
        d = x[odd] - f[odd]
        worst = np.abs(d).argmax(axis=1)
        f[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point to each row: the better of the two cosets."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


def projections(dim: int, tables: int = TABLES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """(tables, dim, 8) Gaussian matrices; unit vectors map to unit variance."""
    return np.random.default_rng([seed, dim]).normal(size=(tables, dim, 8)) * scale


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _cell_ids(points: np.ndarray, salt: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of lattice points, different for each salt and table."""
    p = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    h = _mix(salt.astype(np.uint64), np.uint64(table + 1))
    for k in range(8):
        h = _mix(h, p[..., k])
    return h.view(np.int64)


def cells(unit: np.ndarray, salt: np.ndarray, tables: int = TABLES, probes: int = PROBES,
          scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes) cell ids, the home cell first."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t, m in enumerate(projections(unit.shape[1], tables, scale, seed)):
        x = unit @ m
        home = decode_e8(x)
        out[:, t, 0] = _cell_ids(home, salt, t)
        if probes:
            gain = (x - home) @ NEIGHBOURS.T
            near = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
            out[:, t, 1:] = _cell_ids(home[:, None, :] + NEIGHBOURS[near], salt[:, None], t)
    return out


def _first_meeting(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """2 * table + direction of the first cell where two rows meet: direction 0
    is a's home (b at home there or visiting), 1 is b's home."""
    at_a = (sig_b == sig_a[:, :, :1]).any(axis=2)
    at_b = (sig_a == sig_b[:, :, :1]).any(axis=2)
    both = np.stack([at_a, at_b], axis=2).reshape(len(sig_a), -1)
    return both.argmax(axis=1)


def _matrix(col: pa.ChunkedArray, rows: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def signatures(classes: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """rep, weight, unit (array<double>), sig (array<long>) of valid classes."""
    def run(batches):
        for b in batches:
            vecs = [np.array(v, np.float64) for v in b.column("embedding").to_pylist()]
            salt = b.column("salt").to_numpy()
            dims = np.array([len(v) for v in vecs])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([vecs[i] for i in at])
                # scale by the largest component first: extreme values neither overflow nor vanish
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                s = _mix(salt[at].view(np.uint64), np.uint64(d))
                sig = cells(x, s, tables, probes, scale, seed).reshape(len(at), -1)
                off = pa.array(np.arange(len(at) + 1) * d, pa.int32())
                soff = pa.array(np.arange(len(at) + 1) * sig.shape[1], pa.int32())
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    b.column("rep").take(take), b.column("weight").take(take),
                    pa.ListArray.from_arrays(off, pa.array(x.ravel())),
                    pa.ListArray.from_arrays(soff, pa.array(sig.ravel()))], ["rep", "weight", "unit", "sig"])

    return (classes.select("rep", "weight", "embedding", "salt")
                   .mapInArrow(run, "rep long, weight long, unit array<double>, sig array<long>"))


def verify(rows: DataFrame, threshold: float, tables: int, probes: int) -> DataFrame:
    """Per task: (rep, n, root): links of a row found first in the cells of this
    task, weighted by copies, and the root of its local component."""
    width = 1 + probes

    def run(batches):
        sink = EdgeSink()
        count: dict[int, int] = {}
        for t in whole_groups(batches, "g"):
            n = t.num_rows
            rep, w = t.column("rep").to_numpy(), t.column("weight").to_numpy()
            cell = t.column("cell").to_numpy()
            home = t.column("home").to_numpy(zero_copy_only=False)
            lists = t.column("unit").combine_chunks()
            dim = np.diff(lists.offsets.to_numpy())
            unit_flat, unit_at = lists.values.to_numpy(), lists.offsets.to_numpy()
            sig = _matrix(t.column("sig"), n).reshape(n, tables, width)
            got = np.zeros(n, np.int64)
            for i, j in group_pairs(t.column("g").to_numpy(), t.column("own").to_numpy(),
                                    t.column("diag").to_numpy(zero_copy_only=False), PAIR_CHUNK):
                ok = (home[i] | home[j]) & (rep[i] != rep[j]) & (dim[i] == dim[j]) & (cell[i] == cell[j])
                i, j = i[ok], j[ok]
                for a in range(0, len(i), PAIR_CHUNK):
                    p, q = i[a: a + PAIR_CHUNK], j[a: a + PAIR_CHUNK]
                    cos = np.empty(len(p))
                    for d in np.unique(dim[p]):
                        s = np.flatnonzero(dim[p] == d)
                        k = np.arange(d)
                        cos[s] = np.einsum("ij,ij->i", unit_flat[unit_at[p[s]][:, None] + k],
                                           unit_flat[unit_at[q[s]][:, None] + k])
                    near = cos >= threshold
                    p, q = p[near], q[near]
                    if not len(p):
                        continue
                    # smaller rep first, as the order of meetings needs one direction
                    swap = rep[p] > rep[q]
                    lo, hi = np.where(swap, q, p), np.where(swap, p, q)
                    first = _first_meeting(sig[lo], sig[hi])
                    tab, way = first // 2, first % 2
                    owner = np.where(way == 0, lo, hi)
                    here = sig[owner, tab, 0] == cell[p]
                    lo, hi = lo[here], hi[here]
                    np.add.at(got, lo, w[hi])
                    np.add.at(got, hi, w[lo])
                    sink.add(rep[lo], rep[hi])
            for r, c in zip(rep[got > 0].tolist(), got[got > 0].tolist()):
                count[r] = count.get(r, 0) + c
            if len(count) > 1 << 18:
                yield _rows(count, sink)
                sink, count = EdgeSink(), {}
        yield _rows(count, sink)

    def _rows(count, sink):
        a, b = sink.reduce()
        root = dict(zip(a.tolist(), b.tolist()))
        reps = list(count)
        return pa.RecordBatch.from_arrays([
            pa.array(reps, pa.int64()), pa.array(list(count.values()), pa.int64()),
            pa.array([root.get(r, r) for r in reps], pa.int64())], ["rep", "n", "root"])

    return rows.mapInArrow(run, "rep long, n long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES,
                    probes: int = PROBES, scale: float = SCALE, seed: int = SEED,
                    block: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``df``."""
    v = F.col("_v")
    src = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("_v"),
                    df[label_col].alias("_label"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = (F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & ~bad & F.exists(v, lambda x: x != 0))
    src = src.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    src = src.withColumn("_c1", F.when(F.col("_ok"), F.xxhash64("_label", "_v"))) \
             .withColumn("_c2", F.when(F.col("_ok"), F.xxhash64(F.lit(1), "_label", "_v")))
    classes = (src.filter("_ok").groupBy("_c1", "_c2")
                  .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"),
                       F.first("_v").alias("embedding"), F.first("_label").alias("label"))
                  .withColumn("salt", F.xxhash64("label")))
    # a class is named by a number of its own, as rows of several classes may share a vec_id
    classes = store(classes.select("_c1", "_c2", F.monotonically_increasing_id().alias("rep"), "low", "weight", "salt",
                                   "embedding"), "lattice-classes")
    sigs = store(signatures(classes, tables, probes, scale, seed), "lattice-sigs")
    width = 1 + probes
    keyed = (sigs.select("rep", F.posexplode("sig").alias("_pos", "cell"))
                 .select("rep", "cell", (F.col("_pos") % width == 0).alias("home")))
    rows = split_buckets(keyed, "cell", "rep", block, need="home", payload=sigs)
    part = store(verify(rows.select("g", "own", "diag", "cell", "home", "rep", "weight", "unit", "sig"),
                        threshold, tables, probes), "lattice-links")
    counts = part.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")), "lattice")
    names = (comp.join(classes.select(F.col("rep").alias("node"), "low"), "node")
                 .groupBy("root").agg(F.min("low").alias("component_id")))
    comp = comp.join(names, "root").select(F.col("node").alias("rep"), "component_id")
    per = (classes.select("_c1", "_c2", "rep", "low", "weight").join(counts, "rep", "left").join(comp, "rep", "left")
                  .select("_c1", "_c2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                          F.coalesce("component_id", "low").alias("component_id")))
    return (src.select("vec_id", "_c1", "_c2").join(per, ["_c1", "_c2"], "left")
               .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       F.coalesce("component_id", "vec_id").alias("component_id"))
               .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
