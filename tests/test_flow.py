"""Minimum cuts against the enumeration of all cuts and against augmenting paths."""

import itertools
import random

import pytest

from tessera.operators.flow import minimum_cut
from tessera.operators.kernels.cuts import MaxFlow

TERMINALS, EDGES = "g string, v long, source long, sink long", "g string, u long, v long, cap long"


def run(spark, terminals, edges):
    sides, values = minimum_cut(spark.createDataFrame(terminals, TERMINALS), spark.createDataFrame(edges, EDGES), ["g"])
    return {(r["g"], r["v"]): r["source_side"] for r in sides.collect()}, {r["g"]: r["value"] for r in values.collect()}


def enumerated(terminals, edges):
    """value and nodes of the smallest source side of each graph."""
    out = {}
    for g in {t[0] for t in terminals} | {e[0] for e in edges}:
        t, e = [x[1:] for x in terminals if x[0] == g], [x[1:] for x in edges if x[0] == g]
        nodes = sorted({x[0] for x in t} | {n for x in e for n in x[:2]})
        cuts = []
        for chosen in itertools.product((False, True), repeat=len(nodes)):
            s = {n for n, c in zip(nodes, chosen, strict=True) if c}
            cuts.append((sum(b or 0 if v in s else a or 0 for v, a, b in t) + sum(c or 0 for u, v, c in e if u in s and v not in s), len(s), s))
        out[g] = min(cuts, key=lambda c: c[:2])
    return out


def test_small_graphs_equal_the_enumeration_of_cuts(spark):
    r = random.Random(5)
    terminals, edges = [], []
    for k in range(30):
        n = r.randint(1, 8)
        cap = r.choice([1, 3, 50])
        for v in range(n):
            terminals.append((f"r{k}", v, r.choice([0, 0, r.randint(0, cap)]), r.choice([0, 0, r.randint(0, cap)])))
        edges += [(f"r{k}", r.randrange(n), r.randrange(n), r.randint(0, cap)) for _ in range(r.randint(0, 3 * n))]
    # a path whose ends are all there is, ties all along it; repeats, loops, nulls; no way; neither source nor sink
    terminals += [("path", 0, 4, 0), ("path", 6, 0, 4), ("odd", 0, 5, None), ("odd", 0, 5, 2), ("odd", 1, None, 7), ("apart", 0, 3, 0), ("apart", 1, 0, 3)]
    edges += [("path", i, i + 1, 4) for i in range(6)] + [("odd", 0, 1, 2), ("odd", 0, 1, 3), ("odd", 0, 0, 9), ("odd", 1, 0, None), ("apart", 1, 0, 8), ("none", 0, 1, 1)]
    sides, values = run(spark, terminals, edges)
    want = enumerated(terminals, edges)
    assert values == {g: c[0] for g, c in want.items()}
    assert all(on == (v in want[g][2]) for (g, v), on in sides.items())
    assert {k for k in sides if k[0] == "path"} == {("path", i) for i in range(7)} and not any(sides["path", i] for i in range(7))


def test_a_grid_equals_augmenting_paths(spark):
    r, n = random.Random(2), 7
    at = [(i, j) for i in range(n) for j in range(n)]
    terminals = [("grid", n * i + j, r.randint(0, 30) if j < 3 else 0, r.randint(0, 30) if j > 3 else 0) for i, j in at]
    edges = [("grid", n * i + j, n * a + b, r.randint(0, 9)) for i, j in at for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < n and 0 <= b < n]
    sides, values = run(spark, terminals, edges)
    flow = MaxFlow(n * n)
    for _, v, a, b in terminals:
        flow.add_terminal(v, a, b)
    for _, u, v, c in edges:
        flow.add_edge(u, v, c)
    assert values["grid"] == flow.solve()
    assert [sides["grid", v] for v in range(n * n)] == flow.source_side().tolist()


def test_no_rows_and_wrong_capacities(spark):
    assert run(spark, [], []) == ({}, {})
    with pytest.raises(ValueError, match="below 0"):
        run(spark, [("g", 0, 1, 1)], [("g", 0, 1, -1)])
