"""Shapley explanations of the persona model.

The explained function is the model's predicted cluster number, as a
number, for one customer at a time: v(S) = mean over the background rows of
f(x_S, b_rest). Up to ``exact_features`` features all 2^d coalitions are enumerated;
beyond, ``pairs`` seeded permutations and their reverses are walked (antithetic
sampling): contributions still add up exactly, and each has a standard error from the
spread of the pairs. ``method`` says which of the two a row comes from.

A squared distance to a centroid is a sum over features, so a coalition's distance is what
the customer has in it plus what the background row has outside. Both are matrix products of
the coalitions with squared differences: the background's once a task, the customers' once a
block. Of two centroids one is nearer if the customer's difference is at most the background row's; so
once a task the rows' differences are sorted, with the set of rows from each place on as bits. A customer
takes a binary search a pair of centroids and coalition, not a comparison a row: the sets it finds,
cut with one another, are the rows for which a centroid is the nearest.

Customers are scored block-wise in ``mapInPandas``; the model (scaler statistics, centroids)
and the background sample (``n_background`` rows, by hash) are broadcast, so nothing grows with
the customer count except the number of tasks, which customers are dealt to in files of
``TASK_ROWS``. Null features count as 0.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import stored
from patronage.sources.personas import PERSONA_MAP, UNKNOWN

MAX_EXACT_FEATURES = 10
BACKGROUND = 100
PAIRS = 64
BLOCK = 256
ROWS = 128      # background rows that are sorted together
STEP = 64       # coalitions of a block of customers met at once
TASK_ROWS = 4096


def _coalition_weights(d: int):
    """Coalitions as bitmasks 0..2^d-1 (bit j = feature j present) and the
    Shapley weight |S|! (d-|S|-1)! / d! of each."""
    ids = np.arange(2 ** d)
    masks = ((ids[:, None] >> np.arange(d)[None, :]) & 1).astype(bool)
    sizes = masks.sum(axis=1)
    fact = [math.factorial(t) for t in range(d + 1)]
    w = np.array([fact[t] * fact[d - t - 1] / fact[d] if t < d else 0.0 for t in sizes])
    return ids, masks, w


def _predict(Z: np.ndarray, mean, scale, centers) -> np.ndarray:
    Zs = (Z - mean) / scale
    d2 = ((Zs[..., None, :] - centers) ** 2).sum(-1)
    return d2.argmin(-1).astype(float)


def shapley_values(x: np.ndarray, background: np.ndarray, predict) -> tuple[np.ndarray, float, float]:
    """Exact Shapley values of ``predict`` at ``x`` against a background set:
    phi_j = sum over S without j of w(S) * (v(S + j) - v(S))."""
    d = len(x)
    ids, masks, w = _coalition_weights(d)
    # Z[s, b, :] = x where feature in coalition s, else background row b
    Z = np.where(masks[:, None, :], x[None, None, :], background[None, :, :])
    v = predict(Z).mean(axis=1)
    phi = np.zeros(d)
    for j in range(d):
        without = ids[~masks[:, j]]
        phi[j] = np.sum(w[without] * (v[without | (1 << j)] - v[without]))
    return phi, float(v[0]), float(v[-1])


class Explainer:
    """Contributions for the nearest of ``centers`` against a background."""

    def __init__(self, mean, scale, centers, background, exact_features: int = MAX_EXACT_FEATURES, pairs: int = PAIRS, seed: int = 42):
        self.mean, self.scale, self.centers = (np.asarray(v, float) for v in (mean, scale, centers))
        d = len(self.mean)
        self.method = "exact" if d <= exact_features else "sampled"
        if self.method == "exact":
            self.ids, self.masks, self.weight = _coalition_weights(d)
        else:
            rng = np.random.default_rng(seed)
            half = np.argsort(rng.random((pairs, d)), axis=1)
            self.walks = np.concatenate([half, half[:, ::-1]])
            rank = np.argsort(self.walks, axis=1)  # the step at which a feature comes in
            self.masks = (rank[:, None, :] < np.arange(d + 1)[None, :, None]).reshape(-1, d)
        self.inside = self.masks.astype(float)
        b = self._parts(np.asarray(background, float))
        self.rows = len(b)
        self.sorted = [self._sorted(b[at:at + ROWS]) for at in range(0, len(b), ROWS)]

    def _sorted(self, parts: np.ndarray):
        """Of a group of background rows, by pair of centroids: the differences of each coalition in order, and by place
        the rows from there on as bits, an array a word; and all rows as bits."""
        n, words = len(parts), -(-len(parts) // 64)
        outside = np.einsum("sj,bjc->csb", 1 - self.inside, parts, optimize=True)
        bit = np.zeros((n, words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        pairs = {}
        for c, e in itertools.combinations(range(len(self.centers)), 2):
            gap = outside[e] - outside[c]
            order = np.argsort(gap, axis=1)
            sets = np.zeros((words, len(gap), n + 1), np.uint64)
            sets[:, :, :n] = np.moveaxis(np.bitwise_or.accumulate(bit[order][:, ::-1], axis=1)[:, ::-1], 2, 0)
            pairs[c, e] = np.take_along_axis(gap, order, axis=1), sets
        return pairs, np.bitwise_or.reduce(bit, axis=0)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """Squared scaled differences (row, feature, centroid)."""
        return (((x - self.mean) / self.scale)[:, :, None] - self.centers.T[None]) ** 2

    def clusters(self, x: np.ndarray) -> np.ndarray:
        return self._parts(x).sum(axis=1).argmin(axis=1)

    def values(self, x: np.ndarray) -> np.ndarray:
        """v(S) of every coalition (row, coalition)."""
        own = np.ascontiguousarray(np.einsum("sj,xjc->csx", self.inside, self._parts(x), optimize=True))
        k, width = len(self.centers), len(self.inside)
        total = np.zeros((width, len(x)))
        for pairs, every in self.sorted:
            for at in range(0, width, STEP):
                end = min(at + STEP, width)
                nearer = {}
                for (c, e), (cuts, sets) in pairs.items():
                    gap = own[c, at:end] - own[e, at:end]
                    gap[np.isnan(gap)] = -np.inf        # the first centroid, as on ties
                    places = np.stack([cut.searchsorted(g) for cut, g in zip(cuts[at:end], gap)])
                    places += np.arange(end - at)[:, None] * sets.shape[2]
                    nearer[c, e] = [word[at:end].ravel().take(places) for word in sets]
                for w, full in enumerate(every):
                    for e in range(1, k):
                        nearest = np.broadcast_to(full, places.shape)
                        for c in range(k):
                            if c != e:
                                nearest = nearest & (~nearer[c, e][w] if c < e else nearer[e, c][w])
                        total[at:end] += e * np.bitwise_count(nearest).astype(float)
        return total.T / self.rows

    def explain(self, x: np.ndarray):
        """(contributions, their standard errors, base values) of the rows of ``x``."""
        v, d = self.values(x), x.shape[1]
        phi, error = np.zeros(x.shape), np.zeros(x.shape)
        if self.method == "exact":
            for j in range(d):
                without = self.ids[~self.masks[:, j]]
                phi[:, j] = (v[:, without | (1 << j)] - v[:, without]) @ self.weight[without]
            return phi, error, v[:, 0]
        steps = np.diff(v.reshape(len(x), len(self.walks), d + 1), axis=2)
        gain = np.empty_like(steps)
        np.put_along_axis(gain, np.broadcast_to(self.walks, steps.shape), steps, axis=2)
        pairs = len(self.walks) // 2
        both = (gain[:, :pairs] + gain[:, pairs:]) / 2
        if pairs > 1:
            error = both.std(axis=1, ddof=1) / math.sqrt(pairs)
        return both.mean(axis=1), error, v[:, 0]


def explain(features: DataFrame, cols: list[str], mean: list[float], scale: list[float],
            centers: np.ndarray, background: DataFrame, id_col: str = "CustomerID",
            n_background: int = BACKGROUND, seed: int = 42, exact_features: int = MAX_EXACT_FEATURES,
            pairs: int = PAIRS) -> DataFrame:
    """Per customer: predicted cluster, persona, base value and the
    contributions sorted by absolute size (importance 6 digits, direction,
    standard error), the method and the background rows it used."""
    bg = (background.select(*[F.col(c).cast("double") for c in cols]).na.fill(0.0)
          .orderBy(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))).limit(n_background).toPandas()
          .to_numpy(dtype=float))
    sc = features.sparkSession.sparkContext
    b = sc.broadcast((mean, scale, centers, bg, exact_features, pairs, seed))
    names = list(cols)
    pmap = dict(PERSONA_MAP)

    def run(it):
        model = Explainer(*b.value)
        for pdf in it:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at: at + BLOCK]
                x = part[names].to_numpy(dtype=float)
                phi, error, base = model.explain(x)
                cluster = model.clusters(x)
                contributions = [sorted(
                    ({"feature": f, "importance": round(abs(float(v)), 6), "direction": "positive" if v > 0 else "negative",
                      "standard_error": float(e)} for f, v, e in zip(names, p, q)), key=lambda c: -c["importance"])
                    for p, q in zip(phi, error)]
                yield pd.DataFrame({
                    id_col: part[id_col].to_numpy(), "cluster": cluster.astype(int),
                    "persona": [pmap.get(int(c), UNKNOWN) for c in cluster], "base_value": base, "contributions": contributions,
                    "contribution_sum": phi.sum(axis=1), "method": model.method, "background_rows": len(bg)})

    id_type = dict(features.dtypes)[id_col]
    schema = (f"{id_col} {id_type}, cluster int, persona string, base_value double, "
              "contributions array<struct<feature:string,importance:double,direction:string,standard_error:double>>, "
              "contribution_sum double, method string, background_rows int")
    data = features.select(id_col, *[F.col(c).cast("double") for c in cols]).na.fill(0.0, subset=cols)
    # a few large files would make as few tasks of long work
    return stored(data, TASK_ROWS).mapInPandas(run, schema)
