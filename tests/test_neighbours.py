"""Box neighbour search, components and positions against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.operators import cluster as K
from patronage.operators.neighbours import Boxes, BoxTree, components, positions

SMALL = dict(leaf_rows=16, group=10, visitors=12)


def points(seed=0, n=300, d=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, d)), rng.normal(size=(n // 4, d)) * 0.1 + 3, np.full((n - n // 2 - n // 4, d), 1.0)])
    return x[rng.permutation(len(x))]


def frame(spark, x, extra=()):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(f"p{i:05d}", *map(float, r)) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} double" for c in cols)), cols


def brute(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_pairs_counts_and_knn_equal_brute_force(spark, sizes):
    x = points()
    d = brute(x)
    df, cols = frame(spark, x, [("zz", None, 1.0, 1.0), ("zy", float("nan"), 1.0, 1.0)])
    got = {(r["qid"], r["id"]): r["dist"] for r in K.radius_pairs(df, cols, 0.7, **sizes).collect()}
    want = {(f"p{i:05d}", f"p{j:05d}"): d[i, j] for i, j in zip(*np.nonzero(d <= 0.7))}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    n = {r["id"]: r["neighbours"] for r in K.neighbour_counts(df, cols, 0.7, **sizes).collect()}
    assert n == {**{f"p{i:05d}": int(c) for i, c in enumerate((d <= 0.7).sum(1))}, "zz": 0, "zy": 0}
    k = {r["id"]: r["kdist"] for r in K.knn_distances(df, cols, 5, **sizes).collect()}
    assert k["zz"] is None and k["zy"] is None
    assert np.allclose([k[f"p{i:05d}"] for i in range(len(x))], np.sort(d, axis=1)[:, 4])


@pytest.mark.parametrize("sizes", [{}, SMALL])
@pytest.mark.parametrize("eps,least", [(0.7, 5), (0.3, 3), (0.05, 4), (9.0, 2)])
def test_dbscan_labels_equal_brute_force(spark, sizes, eps, least):
    x = points(3, 160)
    d = brute(x) <= eps
    core = d.sum(1) >= least
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([low[d[i] & core].min() if core[i] else low[i] for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    names = sorted(set(low[core]))
    want = [names.index(low[i]) if core[i] else min((names.index(low[j]) for j in np.flatnonzero(d[i] & core)), default=-1)
            for i in range(len(x))]
    df, cols = frame(spark, x, [("zz", None, 1.0, 1.0)])
    got = {r["id"]: r["label"] for r in K.dbscan(df, cols, eps, least, **sizes).collect()}
    assert [got[f"p{i:05d}"] for i in range(len(x))] == want and got["zz"] == -1


def test_boxes_compare_few_pairs_and_split_hot_ones():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 3))
    tree = BoxTree(x, 64)
    leaf = tree.homes(x)
    held = np.unique(leaf)
    tree.set_boxes(held, np.array([x[leaf == k].min(0) for k in held]), np.array([x[leaf == k].max(0) for k in held]))
    row, to = tree.visits(x, np.full(len(x), 0.05))
    size = np.bincount(leaf, minlength=tree.n_leaves)
    assert size[to].sum() < 0.1 * len(x) ** 2
    near = brute(x[:200])[:, :200] <= 0.05
    reached = set(zip(row.tolist(), to.tolist()))
    assert all((i, leaf[j]) in reached for i, j in zip(*np.nonzero(near)))
    assert BoxTree(np.ones((500, 2)), 8).n_leaves == 1


def test_empty_and_tiny_tables(spark):
    none, cols = frame(spark, np.zeros((0, 2)))
    assert K.dbscan(none, cols, 1.0, 2).count() == 0 and K.knn_distances(none, cols, 2).count() == 0
    one, cols = frame(spark, np.array([[1.0, 2.0]]))
    assert [tuple(r) for r in K.dbscan(one, cols, 1.0, 2).collect()] == [("p00000", -1)]
    assert [tuple(r) for r in K.dbscan(one, cols, 1.0, 1).collect()] == [("p00000", 0)]
    assert [tuple(r) for r in K.knn_distances(one, cols, 2).collect()] == [("p00000", None)]


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from patronage.operators import neighbours
    n, rounds = 10_000, []
    keep = neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df: (rounds.append(1), keep(df))[1])
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = chain.unionByName(spark.createDataFrame([(20000, 20001), (20001, 20000), (7, 7), (30000, 20000)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 20000: 20000, 20001: 20000, 30000: 20000}
    assert len(rounds) // 2 < 20
    assert components(edges.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    e = rng.integers(0, 400, size=(300, 2))
    low = np.arange(400)
    for _ in range(400):
        for a, b in e:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pd.DataFrame(e, columns=["a", "b"]))).collect()}
    assert got == {int(v): int(low[v]) for v in set(e[e[:, 0] != e[:, 1]].ravel().tolist())}


def test_positions_equal_a_sort(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(v) if v else None) for i, v in enumerate(rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    got = {r["id"]: r["position"] for r in positions(df, "v", "id").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {i: k for k, (i, _) in enumerate(want)}
    assert positions(df.limit(0), "v").count() == 0


def test_counts_for_density_stop_where_enough(spark, monkeypatch):
    """DBSCAN needs no whole counts: points with enough neighbours in their block meet no other block."""
    from patronage.operators.neighbours import Boxes
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(60, 3)) * 4
    x = np.concatenate([np.repeat(spots, 10, axis=0), rng.normal(size=(40, 3)) * 4])
    df, cols = frame(spark, x)
    points = K._numbered(df, cols, "id")
    boxes = Boxes(points, [f"v{i}" for i in range(3)], leaf_rows=16, group=16, visitors=100)
    pairs = []
    meet = Boxes.meet
    monkeypatch.setattr(Boxes, "meet", lambda self, step, schema, p, extra=None: pairs.append(len(p)) or meet(self, step, schema, p, extra))
    whole = (brute(x)[..., None] <= np.array([0.5, 1.5])).sum(1)
    for enough in (4, 30):
        got = {r["n"]: (r["c0"], r["c1"]) for r in boxes.counts([0.5, 1.5], enough).collect()}
        for i, w in enumerate(whole):
            assert got[i] == tuple(w) if w[0] < enough else min(got[i]) >= enough and max(got[i][0] - w[0], got[i][1] - w[1]) <= 0
    pairs.clear()
    dense, _ = frame(spark, np.repeat(spots, 10, axis=0))
    K.dbscan(dense, cols, 0.5, 5, leaf_rows=16, group=16, visitors=100).count()
    assert max(pairs[:1]) < 20 and len(pairs) <= 3     # inside for counts and groups, across for groups


def test_cells_of_a_grid_equal_single_runs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 2)) * 0.4, rng.normal(size=(150, 2)) * 0.4 + 3, rng.uniform(-3, 6, size=(60, 2))])
    df, cols = frame(spark, x)
    grid = K.DensityClusters(df, cols, [0.3, 0.6, 0.2], "id", enough=8, leaf_rows=16, group=16, visitors=60)
    cells = [(e, m) for e in (0.3, 0.6, 0.2) for m in (3, 8)]
    got = sorted(grid.cells(cells).collect(), key=lambda r: r["id"])
    for c, (eps, least) in enumerate(cells):
        near = brute(x) <= eps
        core = near.sum(1) >= least
        lab = np.where(core, np.arange(len(x)), len(x))
        while True:
            new = np.where(core, np.where(near & core[None], lab[None], len(x)).min(1), len(x))
            if (new == lab).all():
                break
            lab = new
        want = [int(lab[i]) if core[i] else int(np.where(near[i] & core, lab, len(x)).min()) for i in range(len(x))]
        assert [len(x) if r[f"l{c}"] is None else r[f"l{c}"] for r in got] == want
    with pytest.raises(ValueError):
        grid.cells([(0.3, 9)])
