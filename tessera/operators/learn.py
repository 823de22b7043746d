"""Logistic models: Newton steps whose sums are one aggregation each."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Logistic:
    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        z = F.lit(self.bias)
        for name, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True):
            z = z + (F.col(name) - m) / s * w
        return z

    def probability(self) -> Column:
        z = self.score()
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The same for the rows of a matrix."""
        z = ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def to_json(self) -> str:
        return json.dumps({"model": "logistic"} | asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Logistic:
        d = json.loads(text)
        if len({len(d[k]) for k in ("features", "mean", "scale", "weights")}) != 1:
            raise ValueError("logistic model: inconsistent sizes")
        return cls(d["features"], d["mean"], d["scale"], d["weights"], d["bias"])


def train(df: DataFrame, features: list[str], label: str, l2: float = 1e-2, iterations: int = 25) -> Logistic:
    """Iteratively reweighted least squares; l2 times n on the weights, none on the bias.

    Each step reads the table once for its gradient and Hessian sums; the driver solves a system as
    small as the feature list. A feature without spread has scale 1.
    """
    s = df.agg(F.count("*").alias("n"), *(F.avg(f).alias("m_" + f) for f in features), *(F.stddev_pop(f).alias("s_" + f) for f in features)).first()
    mean, scale = [float(s["m_" + f]) for f in features], [float(s["s_" + f]) or 1.0 for f in features]
    k, n = len(features), s["n"]
    w = np.zeros(k + 1)
    for _ in range(iterations):
        p = Logistic(features, mean, scale, w[:k].tolist(), float(w[k])).probability()
        x = [(F.col(f) - m) / c for f, m, c in zip(features, mean, scale, strict=True)] + [F.lit(1.0)]
        r, h = F.col(label) - F.col("_p"), F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12))
        sums = df.withColumn("_p", p).agg(*(F.sum(r * a).alias(f"g{i}") for i, a in enumerate(x)), *(F.sum(h * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).first()
        g = np.array([sums[f"g{i}"] for i in range(k + 1)])
        hess = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                hess[i, j] = hess[j, i] = sums[f"h{i}_{j}"]
        penalty = np.array([l2 * n] * k + [0.0])
        step = np.linalg.solve(hess + np.diag(penalty), g - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return Logistic(features, mean, scale, w[:k].tolist(), float(w[k]))
