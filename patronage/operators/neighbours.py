"""Neighbour search in boxes that fit the data (J6, J7) and what builds on it:
neighbour counts, linked components and global positions.

A k-d tree over a bounded sample cuts space into boxes of about ``LEAF_ROWS``
points; boxes that follow each other in the tree make blocks of up to ``MAX_BLOCK``
points, and a box with more is dealt to several blocks. Each unordered pair of blocks whose
bounding boxes lie within the radius meets in one task. There the points meet the
tiles of the other block that they reach, in one matrix product of single precision; what its
error bound leaves open is decided in double precision. The table is shuffled twice, whatever the number of
pairs (``blocks_met``), and a task holds two blocks. Boxes are at most
``SAMPLE_ROWS`` / 4, which bounds the tree and the bounding boxes that the driver
collects and broadcasts.

The sample only shapes the boxes; results do not depend on it. Points with a null
or NaN coordinate are no points: callers give them back as such.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.session import stored

LEAF_ROWS = 128
SAMPLE_ROWS = 1 << 16
GROUP = 256      # points of a tile
VISITORS = 1024  # points of a block, at least
MAX_BLOCK = 32_768
SIDE = 32        # blocks a table is cut into between these sizes: 528 pairs of them
SHARED = 8192    # points of small blocks that share a partition
ROWS = 2048      # points that meet a tile at once
SLACK = 1 + 1e-9  # boxes are kept beyond what rounding could lose


class BoxTree:
    """Binary cuts at medians of the widest dimension, as arrays over nodes."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.n_leaves = 0
        depth = max(0, math.ceil(math.log2(max(1, leaves))))
        todo = [(self._node(), sample, depth)]
        while todo:
            node, x, d = todo.pop()
            width = np.ptp(x, axis=0) if len(x) else np.zeros(sample.shape[1])
            if d == 0 or len(x) < 4 or not width.max(initial=0) > 0:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            k = int(width.argmax())
            cut = float(np.median(x[:, k]))
            low = x[:, k] <= cut
            if low.all():  # the upper half is one value: cut below it
                cut = float(x[x[:, k] < cut, k].max())
                low = x[:, k] <= cut
            self.dim[node], self.cut[node] = k, cut
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(self.left[node], x[low], d - 1), (self.right[node], x[~low], d - 1)]
        for name in ("dim", "cut", "left", "right", "leaf"):
            setattr(self, name, np.array(getattr(self, name)))

    def _node(self) -> int:
        for values, v in ((self.dim, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            values.append(v)
        return len(self.dim) - 1

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] <= self.cut[node], self.left[node], self.right[node])

    def set_boxes(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Bounding boxes of all nodes from those of the leaves that hold points."""
        self.low = np.full((len(self.dim), low.shape[1]), np.inf)
        self.high = np.full((len(self.dim), low.shape[1]), -np.inf)
        node = np.empty(self.n_leaves, np.int64)
        node[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)
        self.low[node[leaf]], self.high[node[leaf]] = low, high
        for n in range(len(self.dim) - 1, -1, -1):  # children follow their parents
            if self.leaf[n] < 0:
                self.low[n] = np.minimum(self.low[self.left[n]], self.low[self.right[n]])
                self.high[n] = np.maximum(self.high[self.left[n]], self.high[self.right[n]])

    def visits(self, x: np.ndarray, radius: np.ndarray):
        """(row, leaf) of all boxes within ``radius`` of each row."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves = [], []
        while len(row):
            out = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0)
            near = np.sqrt((out * out).sum(axis=1)) <= radius[row] * SLACK
            row, node = row[near], node[near]
            end = self.leaf[node] >= 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            row, node = row[~end], node[~end]
            row, node = np.concatenate([row, row]), np.concatenate([self.left[node], self.right[node]])
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (row, node)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of two small blocks."""
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        d += (x[:, None, k] - y[None, :, k]) ** 2
    return np.sqrt(d, out=d)


def row_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of equal rows of two blocks, summed in the order of ``distances``."""
    d = np.zeros(len(x))
    for k in range(x.shape[1]):
        d += (x[:, k] - y[:, k]) ** 2
    return np.sqrt(d, out=d)


class Squares:
    """Squared distances of all rows of two blocks as one product in single precision, with
    a bound of its error. What the bound leaves open is decided by ``distances``."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.exact = x, y, None
        middle = (y.min(axis=0) + y.max(axis=0)) / 2
        u, v = x - middle, y - middle
        nu, nv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        top = nu.max() + nv.max()
        if not top < 1e30:
            self.exact = distances(x, y)
            return
        left = np.column_stack([u, nu, np.ones(len(x))]).astype(np.float32)
        right = np.column_stack([-2 * v, np.ones(len(y)), nv]).astype(np.float32)
        self.square, self.slack = left @ right.T, (4 * x.shape[1] + 32) * 1.2e-7 * top

    def within(self, radius) -> np.ndarray | None:
        """Which distances are at most ``radius`` (a number, or a column of one a row); None: none."""
        if self.exact is None:
            r2 = radius * radius
            grow = r2 * 1e-6 + self.slack
            maybe = self.square <= np.float32(r2 + grow)
            n = np.count_nonzero(maybe)
            if not n:
                return None
            sure = self.square <= np.float32(r2 - grow)
            open_ = n - np.count_nonzero(sure)
            if not open_:
                return sure
            if open_ < 0.2 * sure.size:
                i, j = np.nonzero(maybe ^ sure)
                r = radius[i, 0] if np.ndim(radius) else radius
                sure[i, j] = row_distances(self.x[i], self.y[j]) <= r
                return sure
            self.exact = distances(self.x, self.y)
        return self.exact <= radius


class Block:
    """Points of some neighbouring boxes in tiles of about ``tile``, each with its bounding box."""

    def __init__(self, values: dict, d: int, tile: int):
        order = np.argsort(values["leaf"], kind="stable")
        self.x = values.pop("x").reshape(-1, d)[order]
        self.of = {k: v[order] for k, v in values.items()}
        cuts = np.arange(0, len(self.x), tile)
        self.tiles = list(zip(cuts, [*cuts[1:], len(self.x)]))
        self.low, self.high = np.minimum.reduceat(self.x, cuts), np.maximum.reduceat(self.x, cuts)

    def reaching(self, other: "Block", t: int, radius, wanted=None) -> np.ndarray:
        """Rows within ``radius`` (a number, or one a row) of tile ``t`` of another block; of those marked in ``wanted``, if given."""
        low, high = other.low[t], other.high[t]
        out = np.maximum(np.maximum(low - self.high, self.low - high), 0)
        far = radius if np.ndim(radius) == 0 else np.maximum.reduceat(radius, [a for a, _ in self.tiles])
        near = np.flatnonzero(np.sqrt((out * out).sum(axis=1)) <= far * SLACK)
        if not len(near) or (wanted is not None and not wanted.any()):
            return near[:0]
        rows = np.concatenate([np.arange(*self.tiles[i]) for i in near])
        rows = rows if wanted is None else rows[wanted[rows]]
        x = self.x[rows]
        out = np.maximum(np.maximum(low - x, x - high), 0)
        return rows[np.sqrt((out * out).sum(axis=1)) <= (radius if np.ndim(radius) == 0 else radius[rows]) * SLACK]

    def meetings(self, other: "Block", radius, wanted=None, sought=None):
        """(rows, rows of the other block) that may lie within the radius, in small pieces.
        ``wanted``, ``sought``: marks of the rows and the rows of the other side that matter, asked for each tile anew."""
        for t, (a, b) in enumerate(other.tiles):
            cols = np.arange(a, b)
            if sought is not None:
                cols = cols[sought(cols)]
            rows = self.reaching(other, t, radius, None if wanted is None else wanted(cols)) if len(cols) else cols
            for s in range(0, len(rows), ROWS):
                yield rows[s:s + ROWS], cols


def local_roots(a: np.ndarray, b: np.ndarray):
    """(nodes, smallest node of the component of each) of an edge list."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, lab):
            return nodes, nodes[lab]
        lab = new


class Groups:
    """Union-find over the places of some points; a group is named by its smallest point."""

    def __init__(self, labels: np.ndarray):
        self.names, self.of = np.unique(labels, return_inverse=True)
        self.up = np.arange(len(self.names))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return self.up[self.of[rows]]

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the groups ``a`` and ``b`` (roots) of each link."""
        link = np.unique(np.minimum(a, b) * len(self.up) + np.maximum(a, b))
        nodes, low = local_roots(link // len(self.up), link % len(self.up))
        to = np.arange(len(self.up))
        to[nodes] = low
        self.up = to[self.up]


def blocks_met(rows: DataFrame, n_blocks: int, size: int, pairs: list[tuple[int, int]], packed) -> DataFrame:
    """Pairs of blocks: (b, o, columns of block b, columns of block o), the latter null for a block by itself.
    ``rows`` has the block ``b`` (of about ``size`` rows) and a struct ``r``; ``packed`` makes columns (arrays) of the array of a block's structs.

    A block is packed in a partition of its own, whatever Spark would put together, and written as a file of its own,
    so that no reader holds more than one. Tasks then read the two partitions of their pair
    (a cartesian product of two exchanges of the packed blocks): the table is shuffled twice, not once a pair; rows of
    a task come by the first block."""
    spark, n_blocks = rows.sparkSession, max(1, n_blocks)
    table = stored(rows.repartitionById(n_blocks, F.col("b")).groupBy("b").agg(F.collect_list("r").alias("r"))
                       .select("b", *packed(F.col("r"))), 1)
    cols, none = [c for c in table.columns if c != "b"], lambda c: F.lit(None).cast(table.schema[c].dataType)
    single = sorted(i for i, j in pairs if i == j)
    alone = table.filter(F.col("b").isin(single)).repartitionById(n_blocks, F.col("b")).select(
        "b", F.col("b").alias("o"), *cols, *[none(c).alias(f"{c}_o") for c in cols])
    others = {(i, j) for i, j in pairs if i != j}
    if not others:
        return alone
    # small blocks share partitions, a large one has its own
    few = max(n_blocks * size // SHARED, (8 * spark.sparkContext.defaultParallelism) ** 0.5)
    parts = min(n_blocks, math.ceil(few))
    # many large blocks: a task meets one with some others
    more = parts if parts <= SIDE else -(-parts // 4)
    dealt = [table.repartitionById(p, F.pmod("b", F.lit(p))) for p in (parts, more)]
    wanted = F.array(*[F.lit("".join("1" if (i, j) in others else "0" for j in range(n_blocks))) for i in range(n_blocks)])
    right = dealt[1].select(F.col("b").alias("o"), *[F.col(c).alias(f"{c}_o") for c in cols])
    both = dealt[0].join(right.hint("shuffle_replicate_nl"), F.substring(F.get(wanted, F.col("b")), F.col("o") + 1, 1) == "1")
    both = both.select("b", "o", *cols, *[f"{c}_o" for c in cols])
    return both.unionAll(alone) if single else both


class Boxes:
    """Points in boxes. ``points`` has a unique long ``n`` and the columns ``cols``."""

    def __init__(self, points: DataFrame, cols: list[str], leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
                 group: int = GROUP, visitors: int = VISITORS):
        self.cols = [f"x{i}" for i in range(len(cols))]
        self.group = group
        whole = F.lit(True)
        for c in cols:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        data = points.filter(whole).select("n", *[F.col(c).cast("double").alias(x) for c, x in zip(cols, self.cols)])
        self.rows = data.count()
        # the points whose hash is least, in a fixed share: the same on every run
        part = min(1.0, sample_rows / max(1, self.rows))
        keep = F.pmod(F.xxhash64(F.lit(5), "n"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
        picked = data if part >= 1 else data.filter(keep)
        sample = picked.select(*self.cols).limit(2 * sample_rows).toPandas().to_numpy(dtype=float)
        tree = BoxTree(sample.reshape(-1, len(cols)), min(-(-self.rows // leaf_rows), max(1, sample_rows // 4)))
        names = self.cols

        def home(it):
            for pdf in it:
                pdf["leaf"] = tree.homes(pdf[names].to_numpy())
                yield pdf

        self.home = stored(data.mapInPandas(home, T.StructType(list(data.schema) + [T.StructField("leaf", T.LongType())])))
        box = self.home.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(names)],
                                            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(names)]).toPandas()
        self._cut(box.sort_values("leaf"), min(MAX_BLOCK, max(visitors, -(-self.rows // SIDE))))

    def _cut(self, box: pd.DataFrame, size: int) -> None:
        """Blocks of about ``size`` points: boxes that follow each other in the tree, or hashed pieces of a
        box that holds more. Keeps each box's first block and number of them, and the bounds of all blocks."""
        d, first, pieces, low, high, held = len(self.cols), [], [], [], [], 0
        self.size = size
        lows, highs = (box[[f"{s}{i}" for i in range(d)]].to_numpy(float) for s in ("lo", "hi"))
        for c, lo, hi in zip(box["c"], lows, highs):
            if held and held + c <= size:
                low[-1], high[-1] = np.minimum(low[-1], lo), np.maximum(high[-1], hi)
                first.append(len(low) - 1)
                pieces.append(1)
                held += c
                continue
            first.append(len(low))
            pieces.append(-(-int(c) // size))
            low += [lo] * pieces[-1]
            high += [hi] * pieces[-1]
            held = c if pieces[-1] == 1 else 0
        self.low, self.high = np.array(low).reshape(-1, d), np.array(high).reshape(-1, d)
        spark = self.home.sparkSession
        where = spark.createDataFrame([(int(k), f, p) for k, f, p in zip(box["leaf"], first, pieces)], "leaf long, f int, p int")
        self.dealt = stored(self.home.join(F.broadcast(where), "leaf").withColumn(   # a row a box is broadcast
            "b", (F.col("f") + F.pmod(F.xxhash64(F.lit(1), "n"), F.col("p"))).cast("int")).drop("f", "p"))

    def pairs_of_blocks(self, reach=None, own: bool = True, others: bool = True) -> list[tuple[int, int]]:
        """Unordered pairs of blocks, those within ``reach`` of each other (None: all; a number, or one a block)."""
        out = []
        for i in range(len(self.low)):
            js = np.arange(i if own else i + 1, len(self.low) if others else min(i + 1, len(self.low)))
            if reach is not None and len(js):
                gap = np.maximum(np.maximum(self.low[i] - self.high[js], self.low[js] - self.high[i]), 0)
                far = reach if np.ndim(reach) == 0 else np.maximum(reach[i], reach[js])
                js = js[(np.sqrt((gap * gap).sum(axis=1)) <= far * SLACK) | (js == i)]
            out += [(i, int(j)) for j in js]
        return out

    def meet(self, step, schema: str, pairs: list[tuple[int, int]], extra: DataFrame | None = None) -> DataFrame:
        """``step(block, other block)`` (the other is the same one for a block by itself) on every
        pair of blocks; a step yields frames. ``extra``: (n, numbers) that points carry in ``Block.of``.
        A block is packed once and read by the tasks of its pairs (``blocks_met``), which hold two blocks at a time."""
        names, tile, d = self.cols, self.group, len(self.cols)
        rows = self.dealt if extra is None else self.dealt.join(extra, "n", "left")
        more = [c for c in rows.columns if c not in ("b", *names)]
        met = blocks_met(rows.select("b", F.struct(F.array(*names).alias("x"), *more).alias("r")), len(self.low), self.size, pairs,
                         lambda r: [F.flatten(r["x"]).alias("x"), *[r[c].alias(c) for c in more]])
        result = [f.split()[0] for f in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    g, h = (Block({c: batch.column(j)[i].values.to_numpy(zero_copy_only=False)
                                   for j, c in enumerate(["x", *more], at)}, d, tile) if batch.column(at)[i].is_valid else None
                            for at in (2, 3 + len(more)))
                    for frame in step(g, g if h is None else h):
                        if len(frame):
                            yield pa.RecordBatch.from_pandas(frame[result], preserve_index=False)

        return met.mapInArrow(run, schema)

    def counts(self, radii: list[float], enough: int | None = None) -> DataFrame:
        """(n, c0, c1, ...): how many points lie within each radius, the point itself included. With ``enough`` a
        point that has so many within the least radius, and so within all, is not asked for more: its counts are at least
        ``enough``, others are whole. Blocks are then met only for points that miss some in their own."""
        most, many, near = float(max(radii)), len(radii), int(np.argmin(radii))
        schema = "n long, " + ", ".join(f"c{i} long" for i in range(many))

        def met(g, h, n, i, j):
            """Counts the points of ``i`` and ``j`` that lie within the radii of each other."""
            square = Squares(g.x[i], h.x[j])
            for k, r in enumerate(radii):
                hit = square.within(float(r))
                if hit is not None:
                    hit = hit.astype(np.float32)
                    n[0][k, i] += (hit @ np.ones(len(j), np.float32)).astype(np.int64)
                    if h is not g:
                        n[1][k, j] += (np.ones(len(i), np.float32) @ hit).astype(np.int64)

        def frames(g, h, n):
            for block, c in zip((g,) if h is g else (g, h), n):
                some = c.any(axis=0)
                yield pd.DataFrame({"n": block.of["n"][some], **{f"c{k}": c[k, some] for k in range(many)}})

        def step(g, h):
            n = [np.zeros((many, len(b.x)), np.int64) for b in (g, h)]
            for i, j in g.meetings(h, most):
                met(g, h, n, i, j)
            yield from frames(g, h, n)

        def inside(g, _):
            n = [np.zeros((many, len(g.x)), np.int64)]
            for a, b in g.tiles:   # the points close by come first
                met(g, g, n, np.arange(a, b), np.arange(a, b))
            for t, (a, b) in enumerate(g.tiles):
                rows = g.reaching(g, t, most, n[0][near] < enough)
                rows = rows[(rows < a) | (rows >= b)]
                for s in range(0, len(rows), ROWS):
                    met(g, g, n, rows[s:s + ROWS], np.arange(a, b))
            yield from frames(g, g, n)

        def outside(g, h):
            had = [b.of[f"c{near}"] for b in (g, h)]
            n = [np.zeros((many, len(b.x)), np.int64) for b in (g, h)]
            for t, (a, b) in enumerate(h.tiles):
                cols = np.arange(a, b)
                asking = cols[had[1][cols] + n[1][near, cols] < enough]
                lacks = had[0] + n[0][near] < enough
                rows = g.reaching(h, t, most, None if len(asking) else lacks)
                for some, others in ((rows[lacks[rows]], cols), (rows[~lacks[rows]], asking)):
                    for s in range(0, len(some) if len(others) else 0, ROWS):
                        met(g, h, n, some[s:s + ROWS], others)
            yield from frames(g, h, n)

        if enough is None:
            got = self.meet(step, schema, self.pairs_of_blocks(most))
        else:
            got = stored(self.meet(inside, schema, self.pairs_of_blocks(others=False)))
            lacking = self.blocks_with(got, F.col(f"c{near}") < enough)
            pairs = [(i, j) for i, j in self.pairs_of_blocks(most, own=False) if i in lacking or j in lacking]
            if pairs:
                got = got.unionByName(self.meet(outside, schema, pairs, got))
        return got.groupBy("n").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(many)])

    def blocks_with(self, points: DataFrame, some) -> set[int]:
        """The blocks that hold rows of ``points`` (column ``n``) for which ``some`` is true."""
        return {r["b"] for r in self.dealt.select("n", "b").join(points.filter(some).select("n"), "n", "left_semi")
                .select("b").distinct().collect()}

    def pairs(self, radius: float) -> DataFrame:
        """(q, n, dist) of all pairs within the radius, the point itself included."""
        def step(g, h):
            for i, j in g.meetings(h, float(radius)):
                hit = Squares(g.x[i], h.x[j]).within(float(radius))
                if hit is None:
                    continue
                a, b = np.nonzero(hit)
                q, n = g.of["n"][i[a]], h.of["n"][j[b]]
                dist = row_distances(g.x[i[a]], h.x[j[b]])
                yield pd.DataFrame({"q": q, "n": n, "dist": dist})
                if h is not g:
                    yield pd.DataFrame({"q": n, "n": q, "dist": dist})

        return self.meet(step, "q long, n long, dist double", self.pairs_of_blocks(float(radius)))

    def nearest(self, k: int) -> DataFrame:
        """(n, kdist): the distance to the k-th nearest point, the point itself
        counted; null where there are fewer. The k-th in the block at home bounds the search in others."""
        def search(g, h, best):
            # ``best``: the k least distances known of each row of g, the last one the bound
            radius = best[:, -1].copy()
            for i, j in g.meetings(h, radius):
                hit = Squares(g.x[i], h.x[j]).within(best[i, -1:])
                if hit is None:
                    continue
                a, b = np.nonzero(hit)
                if not len(a):
                    continue
                dist = row_distances(g.x[i[a]], h.x[j[b]])
                order = np.lexsort((dist, a))
                a, dist = a[order], dist[order]
                start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                turn = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(a)]))
                rank = np.arange(len(a)) - start[turn]
                new = np.full((len(start), k), np.inf)
                new[turn[rank < k], rank[rank < k]] = dist[rank < k]
                rows = i[a[start]]
                yield rows, new

        def merged(best, found):
            best = best.copy()
            for rows, new in found(best):
                best[rows] = np.sort(np.concatenate([best[rows], new], axis=1), axis=1)[:, :k]
            return best

        def lists(block, best):
            some = np.isfinite(best).any(axis=1)
            return pd.DataFrame({"n": block.of["n"][some], "d": [r[np.isfinite(r)].tolist() for r in best[some]]})

        def inside(g, _):
            best = np.full((len(g.x), k), np.inf)
            for a, b in g.tiles:   # a bound from the points close by, which are met again
                near = np.sort(distances(g.x[a:b], g.x[a:b]), axis=1)[:, :k]
                if near.shape[1] == k:
                    best[a:b, -1] = near[:, -1]
            bound = best[:, -1].copy()

            def found(now):
                now[:, -1] = bound
                seen = np.full((len(g.x), k), np.inf)
                for rows, new in search(g, g, now):
                    seen[rows] = np.sort(np.concatenate([seen[rows], new], axis=1), axis=1)[:, :k]
                    now[rows, -1] = np.minimum(now[rows, -1], seen[rows, -1])
                now[:] = np.inf
                yield np.arange(len(g.x)), seen
            yield lists(g, merged(best, found))

        def outside(g, h):
            for one, two in ((g, h), (h, g)):
                bound = np.where(np.isnan(one.of["radius"]), np.inf, one.of["radius"])
                best = np.full((len(one.x), k), np.inf)
                best[:, -1] = bound
                seen = np.full((len(one.x), k), np.inf)
                for rows, new in search(one, two, best):
                    seen[rows] = np.sort(np.concatenate([seen[rows], new], axis=1), axis=1)[:, :k]
                    best[rows, -1] = np.minimum(best[rows, -1], seen[rows, -1])
                yield lists(one, seen)

        kth = F.get(F.array_sort(F.flatten(F.collect_list("d"))), F.lit(k - 1))
        schema = "n long, d array<double>"
        own = stored(self.meet(inside, schema, self.pairs_of_blocks(others=False)))
        radius = stored(own.select("n", F.get("d", F.lit(k - 1)).alias("radius")))
        # a block reaches as far as its widest point
        far = self.dealt.select("n", "b").join(radius, "n", "left").groupBy("b").agg(
            F.max(F.coalesce("radius", F.lit(float("inf")))).alias("far")).collect()
        reach = np.zeros(len(self.low))
        for r in far:
            reach[r["b"]] = r["far"]
        pairs = self.pairs_of_blocks(reach, own=False)
        found = own.unionByName(self.meet(outside, schema, pairs, radius)) if pairs else own
        return found.groupBy("n").agg(kth.alias("kdist"))

    def clusters(self, counts: DataFrame, cells: list[tuple[int, float, int]]) -> DataFrame:
        """(n, l0, l1, ...): for each cell (number of its radius in ``counts``, radius, least neighbours) the
        smallest dense point of the cluster, null for noise. Dense points are joined in their
        blocks, then the groups of each two blocks that reach each other - tiles that are one group already do
        not meet again -, then by components of groups; a border point takes the least cluster it touches. Points joined
        for a lesser radius and as many neighbours are so for a wider one and fewer: cells go on from what those before them joined."""
        most, many = max(r for _, r, _ in cells), len(cells)
        order = sorted(range(many), key=lambda c: (cells[c][1], -cells[c][2]))
        within = {c: [p for p in order[:at] if cells[p][1] <= cells[c][1] and cells[p][2] >= cells[c][2]]
                  for at, c in enumerate(order)}
        wide = lambda p: ", ".join(f"{p}{c} long" for c in range(many))
        spark = self.home.sparkSession

        # the cell of the same radius whose dense points have met each other before
        before = {c: next((p for p in reversed(within[c]) if cells[p][1] == cells[c][1]), None) for c in order}

        def united(g, h, radius, groups, gi, hi, dense_g, dense_h, met_g, met_h):
            """Joins the groups of dense points; ``gi`` and ``hi`` are the places of the blocks' rows in ``groups``,
            ``met_g`` and ``met_h`` mark points that have met each other within this radius."""
            new_g, new_h = dense_g & ~met_g, dense_h & ~met_h

            def sought(cols):
                return dense_h[cols]

            def wanted(cols):
                rows = dense_g if new_h[cols].any() else new_g
                to = groups.roots(hi[cols])
                return rows & (groups.roots(gi) != to[0]) if (to == to[0]).all() else rows

            if not (new_g.any() or new_h.any()):
                return
            for i, j in g.meetings(h, radius, wanted, sought):
                hit = Squares(g.x[i], h.x[j]).within(radius)
                if hit is None:
                    continue
                a, b = groups.roots(gi[i]), groups.roots(hi[j])
                hit &= a[:, None] != b[None, :]
                p, q = np.nonzero(hit)
                if len(p):
                    groups.unite(a[p], b[q])

        def inside(g, _):
            out, rows, done = {"n": g.of["n"]}, np.arange(len(g.x)), {}
            for c in order:
                k, radius, least = cells[c]
                dense = g.of[f"c{k}"] >= least
                groups = done[c] = Groups(g.of["n"])
                for p in within[c]:
                    groups.unite(groups.up, groups.up[done[p].up])
                met = np.zeros(len(rows), bool) if before[c] is None else g.of[f"c{k}"] >= cells[before[c]][2]
                united(g, g, radius, groups, rows, rows, dense, dense, met, met)
                out[f"r{c}"] = np.where(dense, groups.names[groups.roots(rows)], -1)
            yield pd.DataFrame(out)

        def across(g, h):
            done, rows = {}, np.arange(len(g.x) + len(h.x))
            for c in order:
                radius, a, b = cells[c][1], g.of[f"r{c}"], h.of[f"r{c}"]
                groups = done[c] = Groups(np.concatenate([a, b]))
                for p in within[c]:
                    # points of one group of the other cell, in order of it, are linked one to the next
                    root = done[p].roots(rows)
                    by = np.argsort(root, kind="stable")
                    by = by[done[p].names[root[by]] >= 0]
                    same = np.flatnonzero(root[by[1:]] == root[by[:-1]])
                    groups.unite(groups.roots(by[same]), groups.roots(by[same + 1]))
                met = [np.zeros(len(x.x), bool) if before[c] is None else x.of[f"r{before[c]}"] >= 0 for x in (g, h)]
                united(g, h, radius, groups, np.arange(len(a)), np.arange(len(a), len(a) + len(b)), a >= 0, b >= 0, *met)
                moved = np.flatnonzero(groups.up != np.arange(len(groups.up)))
                yield pd.DataFrame({"cell": np.full(len(moved), c, np.int32), "a": groups.names[moved], "b": groups.names[groups.up[moved]]})

        def touching(g, h):
            for one, two in ((g, h),) if h is g else ((g, h), (h, g)):
                out, none = {"n": one.of["n"]}, np.iinfo(np.int64).max
                for c, (_, radius, _) in enumerate(cells):
                    label, lowest = two.of[f"l{c}"], np.full(len(one.x), none)
                    border, dense = one.of[f"l{c}"] < 0, two.of[f"l{c}"] >= 0
                    for i, j in one.meetings(two, radius, lambda s: border & (lowest > label[s].min()), lambda s: dense[s]):
                        hit = Squares(one.x[i], two.x[j]).within(radius)
                        if hit is not None:
                            lowest[i] = np.minimum(lowest[i], np.where(hit, label[j][None, :], none).min(axis=1))
                    out[f"l{c}"] = lowest
                got = pd.DataFrame(out)
                yield got[(got[[f"l{c}" for c in range(many)]] < none).any(axis=1)]

        roots = stored(self.meet(inside, "n long, " + wide("r"), self.pairs_of_blocks(others=False), counts))
        apart = self.pairs_of_blocks(most, own=False)
        edges = self.meet(across, "cell int, a long, b long", apart, roots) if apart \
            else spark.createDataFrame([], "cell int, a long, b long")
        code = lambda c: F.col(c) * many + F.col("cell")
        comp = components(edges.select(code("a").alias("a"), code("b").alias("b")))
        comp = comp.select(F.col("node").alias("code"), (F.col("component") - F.pmod("component", F.lit(many))) / many)
        comp = comp.toDF("code", "to").withColumn("to", F.col("to").cast("long"))
        each = roots.select("n", F.posexplode(F.array(*[f"r{c}" for c in range(many)])).alias("cell", "root"))
        each = each.withColumn("code", code("root")).join(comp, "code", "left")
        label = F.coalesce("to", "root")
        dense = stored(each.groupBy("n").agg(*[F.max(F.when(F.col("cell") == c, label)).alias(f"l{c}") for c in range(many)]))
        loose = F.lit(False)
        for c in range(many):
            loose = loose | (F.col(f"l{c}") < 0)
        border = self.blocks_with(dense, loose)
        pairs = [(i, j) for i, j in self.pairs_of_blocks(most) if i in border or j in border]
        both = dense.unionByName(self.meet(touching, "n long, " + wide("l"), pairs, dense)) if pairs else dense
        # a dense point's own label is its only one; others have -1 and what they touch
        return both.groupBy("n").agg(*[
            F.min(F.when(F.col(f"l{c}").between(0, (1 << 63) - 2), F.col(f"l{c}"))).alias(f"l{c}") for c in range(many)])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b; one orderable type);
    component is the smallest node reachable.

    Each round every node goes to the first of its closed neighbourhood in an order by
    hash that changes with the round, and edges are contracted. Only nodes that come first among
    their neighbours stay, at most half of a component, so rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder."""
    e = stored(edges.filter("a <> b").select("a", "b").distinct())
    maps = []
    while not e.isEmpty():
        turn = F.lit(len(maps))
        rank = lambda c: F.struct(F.xxhash64(turn, F.col(c)).alias("o"), F.col(c).alias("v"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                             .select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("root")))
        maps.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = stored(e.join(a, "a").join(b, "b").filter("ra <> rb")
                         .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1]
    for to in reversed(maps[:-1]):
        after = out.select(F.col("node").alias("root"), F.col("root").alias("later"))
        out = to.join(after, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    out = stored(out)
    low = out.groupBy("root").agg(F.min("node").alias("low"))
    return out.join(low, "root").select("node", F.least("root", "low").alias("component"))


def positions(df: DataFrame, *order, out: str = "position") -> DataFrame:
    """``df`` with its row's place (from 0) in the given order, without a window
    over all rows: rows are dealt by range, each partition numbers its own, and
    the counts of the partitions before it are added. Equal rows in ``order`` stand in any order; end it
    with a unique column to fix it and to let a frequent value spread."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(ranged)  # numbers are fixed from here on
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()  # a row a partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        before[r["p"]] = total
        total += r["c"]
    if not before:
        return ranged.withColumn(out, F.lit(0).cast("long")).drop("__at")
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[part]
    return ranged.withColumn(out, start + row).drop("__at")
