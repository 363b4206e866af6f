"""Inverted-file index for top-k by cosine (T3 at scale).

Centroids are fitted on a bounded sample (``SAMPLE_PER_CELL`` rows a cell, at most
``MAX_CELLS`` cells); every item is then put into the cell of its nearest centroid, and
cells into pieces of about ``PIECE`` rows, so that a hot cell is many tasks' work. A query meets the
pieces of its ``probes`` nearest cells, in blocks of about ``QUERIES`` queries: a group of the
search holds one piece and one block, whatever the table's size. With as many probes as
cells the answer is that of ``retrieve.nearest``; with fewer it may miss neighbours, and
``recall`` says how many and ``probes_for`` how many probes a wanted recall takes.

Items and queries whose vector is null, zero, or holds null or non-finite components
have no direction: they are not indexed, and such queries have no answer. Rows that share an id are
rows of their own. An empty table gives an index without cells and no answers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.operators import lloyd as LL
from patronage.session import stored

MAX_CELLS = 4096
SAMPLE_PER_CELL = 64
PIECE = 8192
QUERIES = 2048
ROUNDS = 10
SEED = 42


def _unit(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v): unit vectors in double precision, rows without a direction left out."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    big = F.array_max(F.transform("w", lambda x: F.abs(x)))
    fine = ~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (big > 0)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    return (df.select(F.col(id_col).alias("id"), v.alias("w")).filter(F.col("w").isNotNull() & fine)
              .withColumn("w", F.transform("w", lambda x: x / big))
              .select("id", F.transform("w", lambda x: x / norm).alias("v")))


class VectorIndex:
    """``items`` by cells, written under the shared checkpoint folder."""

    def __init__(self, items: DataFrame, id_col: str = "id", vec: str = "embedding", cells: int | None = None,
                 piece: int = PIECE, queries: int = QUERIES, seed: int = SEED):
        self.queries = queries
        points = stored(_unit(items, id_col, vec))
        self.size = points.count()
        want = min(cells or max(1, math.isqrt(self.size)), MAX_CELLS)
        share = min(1.0, SAMPLE_PER_CELL * want / max(self.size, 1))
        sample = points if share == 1.0 else points.filter(
            F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
        fitted = LL.fit_many(stored(sample.select("v")), [LL.Spec(want, init="random")], seed, max_iter=ROUNDS,
                             seed_rows=4 * MAX_CELLS)
        self.centers = fitted[0].centers if fitted else np.zeros((0, 1))
        placed = LL.assign(points, fitted, "at").select("id", "v", F.col("at")[0].alias("cell"))
        self.items = stored(placed)
        # one row a cell: at most MAX_CELLS
        counts = self.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        self.cells = stored(counts.select("cell", "n", F.ceil(F.col("n") / piece).cast("int").alias("pieces")))

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(id, v, pos, cell) for the ``probes`` nearest cells of each query; ``pos`` counts them from 0."""
        centers = self.centers
        if not len(centers):
            return queries.filter(F.lit(False)).withColumns({"pos": F.lit(0), "cell": F.lit(0)})
        half = (centers ** 2).sum(axis=1) / 2
        take = min(probes, len(centers))

        def run(it):
            for pdf in it:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at:at + 256]
                    q = np.stack([np.asarray(v, dtype=float) for v in part["v"]])
                    cells = np.argsort(half - q @ centers.T, axis=1, kind="stable")[:, :take]
                    yield part.assign(cells=list(cells.astype(np.int32)))

        schema = f"id {dict(queries.dtypes)['id']}, v array<double>, cells array<int>"
        return queries.mapInPandas(run, schema).select("id", "v", F.posexplode("cells").alias("pos", "cell"))

    def search(self, queries: DataFrame, k: int, probes: int, qid_col: str = "qid", vec: str = "embedding",
               id_col: str = "id") -> DataFrame:
        """(qid, id, similarity, rank): the ``k`` most similar items among the probed cells, ties by id.
        Every row of ``queries`` needs an id of its own."""
        top = self._top(stored(self._probed(_unit(queries, qid_col, vec), probes)), k)
        return top.select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "similarity", "rank")

    def probes_for(self, target: float = 0.95, k: int = 20, sample: int = 256, seed: int = SEED) -> int:
        """Fewest probes with which ``target`` of the exact answers of ``sample`` items, asked as queries, lie
        in probed cells; an item does not count as its own answer. Vectors without clusters
        need most cells, and this says so before a search does."""
        picked = self.items.orderBy(F.xxhash64("id", "v", F.lit(seed)), "id").limit(sample).select("v")
        asked = stored(picked.select(F.monotonically_increasing_id().alias("id"), "v"))
        top = self._top(stored(self._probed(asked, len(self.centers))), k + 1).filter("rank > 1")
        by_pos = {r["pos"]: r["n"] for r in top.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted, seen = target * sum(by_pos.values()), 0
        for pos in sorted(by_pos):
            seen += by_pos[pos]
            if seen >= wanted:
                return pos + 1
        return max(1, len(self.centers))

    def _top(self, asked: DataFrame, k: int) -> DataFrame:
        q_type, i_type = dict(asked.dtypes)["id"], dict(self.items.dtypes)["id"]
        load = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / self.queries).cast("int").alias("blocks"))
        plan = F.broadcast(self.cells.join(load, "cell").select("cell", "pieces", "blocks"))   # at most MAX_CELLS rows
        item = F.xxhash64("id", "v")
        left = self.items.join(plan, "cell").select(
            "cell", F.pmod(item, "pieces").cast("int").alias("piece"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
        right = asked.join(plan, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("qid"), "pos", F.col("v").alias("qv"))

        def meet(items: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            if items.empty or ask.empty:
                return pd.DataFrame({"qid": [], "pos": [], "id": [], "similarity": []})
            items = items.sort_values("id", kind="stable")
            x, ids = np.stack(list(items["v"])), items["id"].to_numpy()
            out = []
            for at in range(0, len(ask), 256):
                part = ask.iloc[at:at + 256]
                s = np.round(np.stack(list(part["qv"])) @ x.T, 9)       # 9 digits settle float ties
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]     # equal: smaller id first
                each = best.shape[1]
                out.append(pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), each),
                                         "pos": np.repeat(part["pos"].to_numpy(), each), "id": ids[best].ravel(),
                                         "similarity": np.take_along_axis(s, best, axis=1).ravel()}))
            return pd.concat(out)

        keys = ["cell", "piece", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            meet, f"qid {q_type}, pos int, id {i_type}, similarity double")
        w = Window.partitionBy("qid").orderBy(F.desc("similarity"), F.asc("id"))
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, qid_col: str = "qid") -> DataFrame:
    """queries, wanted and recall: the share of exact answers found. An answer
    as similar as the last exact one counts, as equal similarities leave the choice open."""
    last = exact.groupBy(qid_col).agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("wanted"))
    hits = (found.join(last, qid_col, "right").groupBy(qid_col).agg(
        F.count(F.when(F.col("similarity") >= F.col("least") - 1e-9, 1)).alias("hits"), F.first("wanted").alias("wanted")))
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"),
                    (F.sum(F.least("hits", "wanted")) / F.sum("wanted")).alias("recall"))
