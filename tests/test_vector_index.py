"""The inverted-file index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import retrieve as T
from patronage.operators.vector_index import VectorIndex, recall

BAD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [float("nan")] * 8), (9005, [float("inf")] + [1.0] * 7)]


def made(spark, n=900, seed=0, bad=BAD):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, 8))
    x = c[rng.integers(0, 12, n)] + rng.normal(scale=0.3, size=(n, 8))
    x[:n // 3] = x[0]                                     # one vector is a third of all rows
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + list(bad)
    return spark.createDataFrame(rows, "id long, embedding array<double>"), x


def brute(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[q], 9)
    return [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(x)), -s))[:k]]


def ask(df, step):
    return df.filter(f"id % {step} = 0 OR id > 9000").withColumnRenamed("id", "qid")


@pytest.mark.parametrize("sizes", [{}, {"piece": 37, "queries": 5}])
def test_all_probes_are_exact(spark, sizes):
    df, x = made(spark)
    index = VectorIndex(df, cells=9, **sizes)
    assert index.size == 900 and index.cells.agg(F.sum("n")).first()[0] == 900
    got = {}
    for r in index.search(ask(df, 50), 7, probes=9).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["similarity"]))
    assert got.keys() == set(range(0, 900, 50))
    for q, rows in got.items():
        want = brute(x, q, 7)
        assert [i for i, _ in rows] == [i for i, _ in want] and np.allclose([s for _, s in rows], [s for _, s in want])


def test_few_probes_reach_recall(spark):
    df, _ = made(spark, 2000, bad=[])
    q = ask(df, 40)
    exact = T.nearest(df, q, 10)
    index = VectorIndex(df)
    r = recall(index.search(q, 10, probes=8), exact).first()
    assert r["queries"] == 50 and r["wanted"] == 500 and r["recall"] >= 0.9
    probes = index.probes_for(0.9, 10)
    assert 1 <= probes < len(index.centers) and recall(index.search(q, 10, probes), exact).first()["recall"] >= 0.85
    assert recall(exact, exact).first()["recall"] == 1.0
    assert recall(exact.filter("rank <= 5 AND similarity < 0"), exact).first()["recall"] == 0.0


def test_hot_cell_is_cut_and_repeated_ids_stay(spark):
    df, _ = made(spark, 300, bad=[])
    index = VectorIndex(df.unionAll(df), cells=4, piece=50)
    assert index.size == 600 and index.cells.agg(F.max("pieces")).first()[0] > 1
    got = index.search(ask(df, 100), 2, probes=4).orderBy("qid", "rank").collect()
    assert [r["id"] for r in got if r["qid"] == 200] == [200, 200]


def test_very_large_and_small_components(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = VectorIndex(df, cells=1).search(df.withColumnRenamed("id", "qid"), 2, probes=1).orderBy("qid", "rank").collect()
    assert [(r["id"], r["similarity"]) for r in got if r["qid"] == 2] == [(1, 1.0), (2, 1.0)]


def test_empty(spark):
    df, _ = made(spark, 30, bad=[])
    none = df.filter("id < 0")
    assert VectorIndex(none).probes_for() == 1
    assert VectorIndex(none).search(ask(df, 10), 3, probes=2).count() == 0
    assert VectorIndex(df).search(ask(none, 10), 3, probes=2).count() == 0


def test_exact_search_keeps_its_memory_in_bounds():
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(4000, 4)), rng.normal(size=(3000, 4))
    x[100:1500] = x[100]                                        # ties are told by id
    unit = T._unit(q)
    pages = [pd.DataFrame({"id": ids, "v": list(x[ids])}) for ids in np.array_split(rng.permutation(4000), 2)]
    tracemalloc.start()
    got = pd.concat(T._block_topk(SimpleNamespace(value=(np.arange(3000), unit)), 20)(iter(pages)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and len(got) == 3000 * 20
    for i in range(0, 3000, 500):
        mine = got[got["qid"] == i]
        s = np.round(T._unit(x) @ unit[i], 9)
        want = np.lexsort((np.arange(4000), -s))[:20]
        assert np.array_equal(mine["id"], want) and np.allclose(mine["similarity"], s[want], atol=2e-9)
