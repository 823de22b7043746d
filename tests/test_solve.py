"""Conjugate gradients against dense solves, diffusion against the kernels, reachable sets against searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import patches, topology
from tessera.operators.kernels.surface import Intrinsic, Operators
from tessera.operators.kernels.teeth import diffuse as kernel_diffuse
from tessera.operators.model import tables
from tessera.operators.solve import conjugate_gradient, diffuse, prominence
from tessera.sources import meshes as M

TRIPLETS, LOADS = "g string, i long, j long, a double", "g string, i long, b double"


def systems():
    rng = np.random.default_rng(3)
    out = {}
    for k, n in enumerate((1, 4, 12, 25)):
        q = rng.normal(size=(n, n))
        out[f"s{k}"] = (q @ q.T + np.diag(1 + rng.random(n) * 50), rng.normal(size=n))
    out["zero"] = (np.eye(3), np.zeros(3))
    return out


def test_solutions_equal_dense_ones(spark):
    sys_ = systems()
    # entries come in two parts, right sides that are 0 not at all
    a = [(g, i, j, float(x) / 2) for g, (m, _) in sys_.items() for (i, j), x in np.ndenumerate(m) for _ in range(2)]
    b = [(g, i, float(x)) for g, (_, v) in sys_.items() for i, x in enumerate(v) if x]
    got = conjugate_gradient(spark.createDataFrame(a, TRIPLETS), spark.createDataFrame(b, LOADS), ["g"]).collect()
    assert len(got) == sum(len(v) for _, v in sys_.values())
    for r in got:
        m, v = sys_[r["g"]]
        assert r["x"] == pytest.approx(np.linalg.solve(m, v)[r["i"]], abs=1e-8)


def test_what_has_no_solution_is_an_error(spark):
    def solve(a, b):
        return conjugate_gradient(spark.createDataFrame([("g", *x) for x in a], TRIPLETS), spark.createDataFrame([("g", *x) for x in b], LOADS), ["g"]).collect()

    with pytest.raises(ValueError, match="diagonal"):
        solve([(0, 0, 1.0), (1, 0, 1.0)], [(0, 1.0)])
    with pytest.raises(ValueError, match="no row"):
        solve([(0, 0, 1.0)], [(0, 1.0), (1, 1.0)])
    with pytest.raises(ValueError, match="positive definite"):
        solve([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 3.0), (1, 0, 3.0)], [(0, 1.0), (1, -1.0)])
    assert solve([(0, 0, 2.0)], []) and conjugate_gradient(spark.createDataFrame([], TRIPLETS), spark.createDataFrame([], LOADS), ["g"]).count() == 0


def test_diffusion_equals_the_kernel_of_one_mesh(spark):
    shapes = {"torus": M.torus(10, 6), "grid": M.grid(5, 4)}
    v, f = tables(spark, shapes)
    stray = spark.createDataFrame([("grid", 99, 5.0, 5.0, 5.0)], v.schema)
    v = v.union(stray)
    field = v.select("mesh_id", "v", (F.col("x") * 3 + F.col("z") * F.col("z") + F.col("y")).alias("u"))
    got = {(r["mesh_id"], r["v"]): r["u"] for r in diffuse(v, f, field, 0.4, 1e-12).collect()}
    out = {(r["mesh_id"], r["v"]): r["u"] for r in prominence(v, f, field, 0.4, 1e-12).collect()}
    for name, m in shapes.items():
        u = m.x[:, 0] * 3 + m.x[:, 2] ** 2 + m.x[:, 1]
        want = kernel_diffuse(Operators(Intrinsic(m)), u, 0.4, 1e-12)
        assert np.allclose([got[name, i] for i in range(len(u))], want, atol=1e-8)
        assert np.allclose([out[name, i] for i in range(len(u))], u - want, atol=1e-8)
    assert got["grid", 99] == 45.0 and out["grid", 99] == 0.0 and len(got) == 60 + 30 + 1


LINKS, SEEDS = "g string, u long, v long", "g string, v long, reach int"


def searched(links, seeds):
    near = {}
    for g, a, b in links:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    best = {}
    for g, s, bound in seeds:
        level, k, seen = {s}, 0, {s}
        while level and (bound is None or k <= bound):
            for n in level:
                best[g, n] = min(best.get((g, n), k), k)
            level = {m for n in level for m in near.get((g, n), ()) if m not in seen}
            seen |= level
            k += 1
    return best


@pytest.mark.parametrize("bounds", [[None], [0, 1, 2, 5], [None, 1, 3]])
def test_reachable_sets_equal_searches(spark, bounds):
    r = random.Random(len(bounds))
    links = [(g, r.randrange(60), r.randrange(60)) for g in "ab" for _ in range(70)] + [("a", 3, 3), ("a", 1, 2), ("a", 1, 2), ("path", 0, 1)] + [("path", i, i + 1) for i in range(20)]
    seeds = [(g, r.randrange(60), r.choice(bounds)) for g in "ab" for _ in range(3)] + [("a", 500, bounds[0]), ("path", 0, bounds[-1]), ("path", 9, bounds[0])]
    got = {(x["g"], x["v"]): x["hops"] for x in patches.reachable(spark.createDataFrame(links, LINKS), spark.createDataFrame(seeds + [("a", None, 1)], SEEDS), ["g"]).collect()}
    assert got == searched(links, seeds)


def test_punched_holes(spark):
    v, f = tables(spark, {"grid": M.grid(12, 12), "sphere": M.icosphere(3)})
    left, gone = patches.punch(f, spark.createDataFrame([("grid", 6 * 13 + 6, 2)], "mesh_id string, v long, reach int"))
    assert gone.count() == 24 and left.count() == f.count() - 24
    balls = spark.createDataFrame([("sphere", 0.0, 0.0, 1.0, 0.5)], "mesh_id string, x double, y double, z double, radius double")
    left, gone = patches.punch_balls(f, v, balls)
    m = M.icosphere(3)
    inside = np.linalg.norm(m.x - (0, 0, 1), axis=1) < 0.5
    assert gone.count() == int(inside[m.f].all(axis=1).sum()) > 10
    loops = topology.boundary_components(left).groupBy("mesh_id").agg(F.count_distinct("label").alias("n")).collect()
    assert {r["mesh_id"]: r["n"] for r in loops} == {"grid": 1, "sphere": 1}
    assert patches.punch(f, spark.createDataFrame([], "mesh_id string, v long, reach int"))[1].count() == 0
