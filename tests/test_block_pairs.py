"""Blocks that meet in pairs: products against sums by coordinate, rows sent, shared scans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.operators import cluster as K
from patronage.operators import evaluate as V
from patronage.operators import lloyd as LL
from patronage.operators import neighbours as NB


def brute(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e200])
def test_products_decide_as_sums_do(offset):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 4, (60, 3)).astype(float), rng.normal(size=(60, 3)) * 0.01]) + offset
    y = x[rng.permutation(len(x))][:50]
    d = NB.distances(x, y)
    for radius in (1.0, 2.0, 3.0, 0.005, 0.0):     # grid points lie exactly on a whole radius
        hit = NB.Squares(x, y).within(radius)
        assert np.array_equal(np.zeros(d.shape, bool) if hit is None else hit, d <= radius)


def test_distances_by_product_keep_zero_and_short_ones():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 5)), np.full((3, 5), 1e4)])
    y = np.concatenate([x[:20], x[:20] + 1e-7, rng.normal(size=(30, 5))])
    got, want = V.distances(x, y), brute(x, y)
    assert np.array_equal(got == 0, want == 0) and np.allclose(got, want, rtol=1e-7, atol=0)
    x[0, 0] = np.nan
    assert np.isnan(V.distances(x, y)[0]).all() and not np.isnan(V.distances(x, y)[1:]).any()


def test_points_are_sent_once_a_pair_of_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(600, 14)), np.ones((200, 14))])
    cols = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).withColumn("n", F.monotonically_increasing_id())
    boxes = NB.Boxes(df, cols, leaf_rows=4, group=16, visitors=200)
    sizes = {r["b"]: r["count"] for r in boxes.dealt.groupBy("b").count().collect()}
    pairs = boxes.pairs_of_blocks(100.0)
    # every box is within reach, yet rows go out once a pair of blocks, not once a box
    assert len(sizes) <= 12 and len(pairs) == len(sizes) * (len(sizes) + 1) // 2
    assert max(sizes.values()) <= 2 * 200 and sum(sizes.values()) == len(x)
    sent = boxes.meet(lambda g, h: [pd.DataFrame({"n": np.concatenate([b.of["n"] for b in ((g,) if g is h else (g, h))])})],
                      "n long", pairs)
    assert sent.count() == len(x) * len(sizes)


def test_grid_cells_equal_single_runs_and_share_the_meetings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(90, 2)) * 0.3, rng.normal(size=(60, 2)) * 0.2 + 3, rng.uniform(-4, 6, (30, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).withColumn("id", F.monotonically_increasing_id())
    met = []
    keep = NB.Boxes.meet
    monkeypatch.setattr(NB.Boxes, "meet", lambda *a: (met.append(1), keep(*a))[1])
    got = {(r["eps"], r["min_samples"]): (r["n_clusters"], r["n_noise"], r["score"])
           for r in K.tune_dbscan(df, ["a", "b"], [0.3, 0.6], [3, 6]).collect()}
    assert len(met) <= 4                            # counts, blocks alone, blocks in pairs, border points
    for (eps, least), (clusters, noise, score) in got.items():
        lab = np.array([r["label"] for r in K.dbscan(df, ["a", "b"], eps, least).orderBy("id").collect()])
        assert (clusters, noise) == (lab.max() + 1, (lab == -1).sum())
        if clusters < 2 or noise > 0.5 * len(x):
            assert score == -1.0
            continue
        labelled = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(label=lab))
        assert score == pytest.approx(V.silhouette_score(labelled, ["a", "b"], "label")[0], abs=1e-9)


def test_a_point_without_a_place_leaves_the_score_undefined(spark):
    rows = [(i, float(i % 2) * 9 + i * 0.01) for i in range(12)] + [(12, None)]
    df = spark.createDataFrame(rows, "id long, a double")
    got = K.tune_dbscan(df, ["a"], [0.5], [3]).first()
    assert (got["n_clusters"], got["n_noise"]) == (2, 1) and np.isnan(got["score"])


def test_silhouette_groups_are_a_share_of_the_points(spark, monkeypatch):
    monkeypatch.setattr(LL, "MIN_OWN", 8)
    monkeypatch.setattr(LL, "GROUPS", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 4))
    labels = np.column_stack([rng.integers(0, 3, 100), rng.integers(0, 2, 100)])
    df = spark.createDataFrame([(r.tolist(), l.tolist()) for r, l in zip(x, labels)], "v array<double>, labels array<int>")
    got = LL.silhouettes(df, [3, 2], [4, 2])
    for m, dims in enumerate((4, 2)):
        d, lab = brute(x[:, :dims], x[:, :dims]), labels[:, m]
        each = []
        for i in range(100):
            mean = {c: d[i, lab == c].sum() / ((lab == c).sum() - (c == lab[i])) for c in set(lab)}
            a = mean.pop(lab[i])
            each.append((min(mean.values()) - a) / max(a, min(mean.values())))
        assert got[m] == pytest.approx(np.mean(each), abs=1e-9)


@pytest.mark.parametrize("name", ["upsert_counts", "existing_and_new", "write_clusters"])
def test_stored_tables_clean_the_lines_once(spark, raw_df, monkeypatch, name):
    from patronage.plans import queries as Q
    read = []
    monkeypatch.setattr(Q.S, "transactions", lambda *_: (read.append(1), raw_df)[1])
    monkeypatch.setattr(Q.S, "customer_segments", lambda *_: spark.createDataFrame(
        [(f"C{i + 10}", "s", i % 5) for i in range(20)], "CustomerID string, Segment string, RegionKey int"))
    assert Q.QUERIES[name](spark, "").count() > 0 and len(read) == 1


def test_blocks_meet_without_a_shuffle_a_pair(spark):
    """Blocks that meet are read from one exchange by each pair, and their sums come by slices."""
    from patronage.operators import evaluate as V
    from patronage.operators.neighbours import blocks_met
    rows = spark.range(500).select((F.col("id") % 10).cast("int").alias("b"), F.struct(F.col("id").alias("p")).alias("r"))
    pairs = [(0, 0), (0, 3), (2, 7), (9, 9), (5, 6)]
    met = blocks_met(rows, 10, 50, pairs, lambda r: [r["p"].alias("p")])
    assert "CartesianProduct" in met._jdf.queryExecution().executedPlan().toString()
    got = {(r["b"], r["o"]): (sorted(r["p"]), r["p_o"] and sorted(r["p_o"])) for r in met.collect()}
    block = lambda k: list(range(k, 500, 10))
    assert got == {(i, j): (block(i), None if i == j else block(j)) for i, j in pairs}
    old, V.SLICE = V.SLICE, 7
    try:
        x = np.random.default_rng(8).normal(size=(120, 2))
        g = [None if i % 11 == 0 else i % 3 for i in range(120)]
        df = spark.createDataFrame([(i, k, *map(float, v)) for i, (k, v) in enumerate(zip(g, x))], "__pid long, g int, a double, b double")
        got = {(r["pid"], r["other"]): (r["own"], r["dsum"], r["npos"], r["cnt"]) for r in V.pair_sums(df, ["a", "b"], "g", 25).collect()}
    finally:
        V.SLICE = old
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == 120 * 4
    for (i, o), (own, total, positive, count) in got.items():
        of = np.array([k == o for k in g])
        assert own == g[i] and abs(total - dist[i, of].sum()) < 1e-9 and positive == (dist[i, of] > 0).sum() and count == of.sum()
