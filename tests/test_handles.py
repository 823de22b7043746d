"""Handle loops against the kernel, forests against Kruskal's, ways against walks."""

import random

import numpy as np
import pytest

from tessera.operators.handles import handle_loops, spanning_forest, ways_up
from tessera.operators.kernels.rewrite import handle_loops as kernel_loops
from tessera.operators.model import tables
from tessera.sources import meshes as M


def kruskal(links):
    root, out = {}, set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for w, i, a, b in sorted(((w, i, a, b) for i, a, b, w in links), reverse=True):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add(i)
    return out


def test_forest_equals_kruskal(spark):
    rng = random.Random(4)
    # ties, parallel edges, a loop on one node, a hub, several parts
    graphs = {g: [(i, rng.randrange(n), rng.randrange(n), float(rng.randrange(4))) for i in range(m)] for g, n, m in (("a", 12, 40), ("b", 30, 25), ("c", 2, 6))}
    graphs["hub"] = [(i, 0, i % 20 + 1, float(i % 7)) for i in range(80)] + [(99, 3, 3, 9.0)]
    rows = [(g, *r) for g, rs in graphs.items() for r in rs]
    got = spanning_forest(spark.createDataFrame(rows, "g string, id long, a long, b long, w double"), ["g"]).collect()
    assert len(got) == len({(r["g"], r["id"]) for r in got})
    for g, rs in graphs.items():
        assert {r["id"] for r in got if r["g"] == g} == kruskal(rs)


def test_forest_of_nothing(spark):
    assert spanning_forest(spark.createDataFrame([], "g string, id long, a long, b long, w double"), ["g"]).isEmpty()
    assert spanning_forest(spark.createDataFrame([("a", 1, 5, 5, 1.0)], "g string, id long, a long, b long, w double"), ["g"]).isEmpty()


def test_ways_up_equal_walks(spark):
    rng = random.Random(5)
    parent = {0: None, **{v: v - 1 if v < 20 else rng.randrange(v) for v in range(1, 60)}}
    starts = [("k1", 59), ("k2", 19), ("k3", 0), ("k4", 40)]
    got = ways_up(spark.createDataFrame([("m", v, p) for v, p in parent.items()], "g string, v long, parent long"), spark.createDataFrame([("m", *s) for s in starts], "g string, key string, v long"), ["g"]).collect()
    want = []
    for key, v in starts:
        step = 0
        while v is not None:
            want.append((key, v, step))
            v, step = parent[v], step + 1
    assert sorted((r["key"], r["v"], r["step"]) for r in got) == sorted(want)


def bent(m, seed):
    """Places moved a little, so that no two ways are equally long."""
    return M.Mesh(m.x + np.random.default_rng(seed).normal(scale=0.01, size=m.x.shape), m.f)


@pytest.fixture(scope="module")
def shapes():
    double = M.append(M.torus(9, 6), M.torus(7, 5))
    raw = {"torus": M.torus(12, 6), "plate": M.plate_with_handle(), "two": double, "sphere": M.icosphere(1), "holes": M.grid_with_holes(6, 6, [(1, 1), (4, 3)]), "cylinder": M.cylinder(10, 3)}
    return {k: bent(m, i) for i, (k, m) in enumerate(raw.items())}


def test_loops_equal_the_kernel(spark, shapes):
    loops, places = handle_loops(*tables(spark, shapes))
    got, at = loops.collect(), places.collect()
    assert not [r for r in got if r["mesh_id"] in ("sphere", "holes", "cylinder")]
    for name, m in shapes.items():
        want = kernel_loops(m)
        mine = sorted((r for r in got if r["mesh_id"] == name), key=lambda r: r["loop"])
        assert [r["loop"] for r in mine] == list(range(len(want)))
        assert [r["length"] for r in mine] == pytest.approx([l for _, l in want])
        side = {frozenset(map(int, (f[i], f[i - 1]))) for f in m.f for i in range(3)}
        for r, (cycle, _) in zip(mine, want):
            way = [p["v"] for p in sorted((p for p in at if p["mesh_id"] == name and p["loop"] == r["loop"]), key=lambda p: p["position"])]
            assert way[0] == r["u"] and way[-1] == r["v"] and len(way) == len(set(way)) == r["size"]
            assert set(way) == set(cycle)
            assert all(frozenset((way[i - 1], way[i])) in side for i in range(len(way)))
            assert r["length"] == pytest.approx(sum(float(np.linalg.norm(m.x[way[i - 1]] - m.x[way[i]])) for i in range(len(way))))


def test_no_faces_no_loops(spark):
    v, f = tables(spark, {"a": M.torus(6, 4)})
    loops, places = handle_loops(v, f.limit(0))
    assert loops.isEmpty() and places.isEmpty()
