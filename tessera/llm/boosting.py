"""Gradient-boosted regression trees for log loss, and isotonic calibration.

:class:`Boosted` fits rows that are at hand. :func:`fit_table` fits the rows of a table where they
are, by rounds: a task adds up its rows' gradients by node, feature and bin, and the driver chooses
the cuts from the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Rows that a task sums up in a round, about, unless more than ``MOST_TASKS`` would be needed; trees between two writes of the margins.
TASK_ROWS, MOST_TASKS, TREES_A_WRITE = 50_000, 256, 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Boosted:
    """Complete trees of a fixed depth over quantile bins; leaves hold shrunken Newton steps."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, l2: float = 1.0, bins: int = 64, least_hessian: float = 1.0):
        self.trees, self.depth, self.rate, self.l2, self.bins, self.least = trees, depth, rate, l2, bins, least_hessian

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, d = x.shape
        weight = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        p = np.clip(np.average(y, weights=weight) if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        f = np.full(n, self.base)
        for t in range(self.trees):
            q = _sigmoid(f)
            g, h = weight * (q - y), weight * np.maximum(q * (1 - q), 1e-9)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                best, where = np.zeros(count), [(0, np.inf, 1 << 30)] * count
                for j in range(d):
                    key = (at - first) * self.bins + binned[:, j]
                    gs = np.bincount(key, g, count * self.bins).reshape(count, -1).cumsum(1)
                    hs = np.bincount(key, h, count * self.bins).reshape(count, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain[:, len(self.edges[j]) :] = 0
                    k = gain.argmax(1)
                    for c in np.flatnonzero(gain[np.arange(count), k] > best + 1e-12):
                        best[c] = gain[c, k[c]]
                        where[c] = (j, self.edges[j][k[c]], k[c])
                right = np.zeros(n, bool)
                for c, (j, cut, k) in enumerate(where):
                    self.feature[t, first + c], self.cut[t, first + c] = j, cut
                    mine = at == first + c
                    right[mine] = binned[mine, j] > k
                at = 2 * at + 1 + right
            leaf = at - inner
            step = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            self.leaf[t] = self.rate * step
            f += self.leaf[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            f += leaf[at - len(cut)]
        return f


class _Growing:
    """Trees being grown: by tree and inner node a feature and a bin, rows of bins above which go right, and by leaf a step."""

    def __init__(self, depth: int):
        self.depth, self.feature, self.bin, self.leaf = depth, [], [], []

    def node(self, x: np.ndarray, tree: int, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            at = 2 * at + 1 + (x[rows, self.feature[tree][at]] > self.bin[tree][at])
        return at

    def margin(self, x: np.ndarray, first: int) -> np.ndarray:
        f = np.zeros(len(x))
        for t in range(first, len(self.leaf)):
            f += self.leaf[t][self.node(x, t, self.depth) - len(self.bin[t])]
        return f


def _columns(batch: pa.RecordBatch, d: int, models: int) -> tuple[np.ndarray, ...]:
    """fold, y, bins (rows of ``d``) and margins (rows of ``models``)."""
    bins, f = (np.asarray(batch.column(i).flatten()) for i in (2, 3))
    return np.asarray(batch.column(0)), np.asarray(batch.column(1)), bins.reshape(-1, d), f.reshape(-1, models)


def _cuts(g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of (node, feature, bin) sums the best feature and bin, and both sides' Newton steps."""
    gs, hs = g.cumsum(2), h.cumsum(2)
    gt, ht = gs[..., -1:], hs[..., -1:]
    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
    gain[(hs < least) | (ht - hs < least)] = 0
    for j, e in enumerate(edges):
        gain[:, j, len(e) :] = 0
    n = np.arange(len(g))
    k = gain.argmax(2)
    top = np.take_along_axis(gain, k[..., None], 2)[..., 0]
    j = (top >= top.max(1, keepdims=True) - 1e-12).argmax(1)
    none = top[n, j] <= 1e-12
    k = np.where(none, g.shape[2] - 1, k[n, j])  # without a cut all rows go left
    j = np.where(none, 0, j)
    left, right = (gs[n, j, k], hs[n, j, k]), (gt[n, j, 0] - gs[n, j, k], ht[n, j, 0] - hs[n, j, k])
    right = tuple(np.where(none, 0.0, r) for r in right)
    return j, k, np.stack([-a / (b + l2) for a, b in (left, right)], axis=1)


def fit_table(rows: DataFrame, d: int, folds: int, class_weight: tuple[float, float], like: Boosted | None = None) -> tuple[Boosted, DataFrame]:
    """(trees of all rows, rows with their margin by the trees of the other folds): all ``folds`` + 1 models grow together.

    ``rows``: fold int, y int, x array<double> of ``d`` numbers; every row counts, with the weight of its class.
    """
    like = like or Boosted()
    depth, nbins, models = like.depth, like.bins, folds + 1
    n = rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()
    count = np.zeros((folds, 2))
    for r in n:
        count[r["fold"], r["y"]] = r["n"]
    weight = np.array(class_weight) * count.sum() / (count.sum(0) * class_weight).sum()
    # edges from all rows, by Spark's quantiles
    probabilities = np.linspace(0, 1, nbins + 1)[1:-1].tolist()
    got = rows.agg(*(F.percentile_approx(F.col("x")[j], probabilities, 10000).alias(f"q{j}") for j in range(d))).first()
    edges = [np.unique(got[f"q{j}"]) for j in range(d)]
    base = []
    for m in range(models):
        total = (count * weight)[[k for k in range(folds) if k != m]].sum(0)
        p = np.clip(total[1] / total.sum() if total.sum() else 0.5, 1e-3, 1 - 1e-3)
        base.append(float(np.log(p / (1 - p))))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, d)
            at = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(at), pa.list_(pa.int16())), pa.array([base] * len(x), pa.list_(pa.float64()))], names=["fold", "y", "b", "f"])

    kind = "fold int, y int, b array<smallint>, f array<double>"
    tasks = int(min(MOST_TASKS, count.sum() // TASK_ROWS + 1))
    state = materialise(rows.select("fold", "y", "x").mapInArrow(binned, kind).repartition(tasks), "binned")
    grown, written = [_Growing(depth) for _ in range(models)], 0

    def sums(level: int) -> np.ndarray:
        """(2, model, node, feature, bin): gradients and Hessians of the nodes of a level."""
        t, nodes = len(grown[0].leaf), 1 << level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, models, nodes * d * nbins))
            for batch in batches:
                fold, y, x, f = _columns(batch, d, models)
                for m in range(models):
                    mine = fold != m  # the last model's fold has no rows
                    xm, ym = x[mine], y[mine]
                    q = _sigmoid(f[mine, m] + grown[m].margin(xm, written))
                    w = weight[ym]
                    at = grown[m].node(xm, t, level) - (nodes - 1)
                    key = ((at[:, None] * d + np.arange(d)) * nbins + xm).ravel()
                    for i, v in enumerate((w * (q - ym), w * np.maximum(q * (1 - q), 1e-9))):
                        out[i, m] += np.bincount(key, np.repeat(v, d), out.shape[2])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

        total = sum(np.frombuffer(r["s"]) for r in state.mapInArrow(run, "s binary").collect())
        return np.reshape(total, (2, models, nodes, d, nbins))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, x, f = _columns(batch, d, models)
            f = f + np.stack([g.margin(x, written) for g in grown], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(f), pa.list_(pa.float64()))], names=["fold", "y", "b", "f"])

    for t in range(like.trees):
        for g in grown:
            g.feature.append(np.zeros(0, np.int64))
            g.bin.append(np.zeros(0, np.int64))
        for level in range(depth):
            s = sums(level)
            for m, g in enumerate(grown):
                j, k, steps = _cuts(s[0, m], s[1, m], edges, like.l2, like.least)
                g.feature[t], g.bin[t] = np.append(g.feature[t], j), np.append(g.bin[t], k)
                if level == depth - 1:
                    g.leaf.append(like.rate * steps.ravel())
        if (t + 1) % TREES_A_WRITE == 0 or t + 1 == like.trees:
            last, state = state, materialise(state.mapInArrow(moved, kind), "margins")
            release(last)
            written = t + 1
    final = grown[-1]
    like.edges, like.base = edges, base[-1]
    like.feature, like.leaf = np.stack(final.feature), np.stack(final.leaf)
    like.cut = np.array([[edges[j][k] if k < len(edges[j]) else np.inf for j, k in zip(js, ks, strict=True)] for js, ks in zip(final.feature, final.bin, strict=True)])
    return like, state.select("fold", "y", F.col("f")[F.col("fold")].alias("margin"))


class Isotonic:
    """Non-decreasing least-squares fit by pooling adjacent violators, linear between block means."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        weight = np.ones(len(y)) if weight is None else weight
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of scores, sum of labels, weight
        for s, v, w in zip(score[order], y[order], weight[order], strict=True):
            blocks.append([float(s * w), float(v * w), float(w)])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[0] / b[2] for b in blocks])
        # one pseudo row at the overall rate in each block keeps end blocks off 0 and 1
        rate = float(np.average(y, weights=weight))
        self.y = np.maximum.accumulate([(b[1] + rate) / (b[2] + 1) for b in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
