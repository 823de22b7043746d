"""Graphs that fit a task are contracted there; only links between tasks go through rounds."""

import random

import numpy as np
import pytest

from tessera.operators import fixpoint
from tessera.operators.kernels.contract import roots


def _wanted(nodes, edges):
    label = {k: k for k in nodes}
    while True:
        new = dict(label)
        for g, u, v in edges:
            new[g, u] = min(new[g, u], new[g, v])
            new[g, v] = min(new[g, u], new[g, v])
        if new == label:
            return {(*k, v[1]) for k, v in label.items()}
        label = new


def test_roots_of_random_graphs():
    r = np.random.default_rng(1)
    for n, m in ((1, 0), (30, 20), (400, 380), (1000, 5000)):
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        want = _wanted([(0, int(k)) for k in range(n)], [(0, int(a), int(b)) for a, b in zip(u, v, strict=True)])
        assert {(0, k, int(x)) for k, x in enumerate(roots(u, v, n))} == want


@pytest.mark.parametrize(("task_rows", "rounds"), [(1_000_000, 0), (20, 1)])
def test_components_of_many_graphs(spark, monkeypatch, task_rows, rounds):
    monkeypatch.setattr(fixpoint, "TASK_ROWS", task_rows)
    asked, whole = [], fixpoint._rounds
    monkeypatch.setattr(fixpoint, "_rounds", lambda *a: asked.append(1) or whole(*a))
    r = random.Random(5)
    nodes = [(g, k) for g in "abc" for k in range(60)]
    edges = [(g, r.randrange(60), r.randrange(60)) for g in "aab" for _ in range(35)]
    df = spark.createDataFrame(edges + [(None, 1, 2)], "g string, u bigint, v bigint")
    got = fixpoint.components(spark.createDataFrame(nodes + nodes, "g string, n bigint"), df, ["g"], node="n").collect()
    assert len(got) == 180 and {tuple(x) for x in got} == _wanted(nodes, edges)
    assert len(asked) == rounds
