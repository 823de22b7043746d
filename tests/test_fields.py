"""Isosurfaces and samples against the kernels, splats against a plain loop, and the defined cases."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessera.operators import fields, topology
from tessera.operators.kernels import grids as kernels
from tessera.operators.model import tables
from tessera.sources import meshes as M

NODES, GRIDS = "mesh_id string, i long, j long, k long, value double", "mesh_id string, ox double, oy double, oz double, h double, nx long, ny long, nz long"


def rows(name, values):
    return [(name, *map(int, at), float(v)) for at, v in np.ndenumerate(values)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    # noise across two blocks; whole numbers, so that many nodes lie on the surface; a smooth field; one that stays above
    out = {"noise": rng.normal(size=(10, 5, 4)), "whole": rng.integers(-1, 2, size=(5, 4, 9)).astype(float), "above": np.ones((3, 3, 3))}
    x, y, z = np.meshgrid(*(np.linspace(-1.5, 1.5, 19),) * 3, indexing="ij")
    out["torus"] = np.sqrt((np.sqrt(x * x + y * y) - 0.8) ** 2 + z * z) - 0.33
    return {k: kernels.Grid(v, np.array([0.5, -1.0, 2.0]), 0.25) for k, v in out.items()}


@pytest.fixture(scope="module")
def nodes_and_grids(spark, corpus):
    n = spark.createDataFrame([r for k, g in corpus.items() for r in rows(k, g.values)], NODES)
    return n, spark.createDataFrame([(k, *map(float, g.origin), g.h, *map(int, g.values.shape)) for k, g in corpus.items()], GRIDS)


def soup(x, f):
    """Triangles by rounded corners, turned so that the least comes first."""
    out = []
    for t in f:
        p = [tuple(np.round(x[v], 7) + 0.0) for v in t]
        k = p.index(min(p))
        out.append(tuple(p[k:] + p[:k]))
    return sorted(out)


@pytest.mark.parametrize("iso", [0.0, 0.125])
def test_surfaces_equal_the_kernel(spark, corpus, nodes_and_grids, iso):
    v, f = (t.toPandas() for t in fields.isosurface(*nodes_and_grids, iso))
    assert "above" not in set(v["mesh_id"])
    for name, grid in corpus.items():
        want = kernels.isosurface(grid, iso)
        mine = {r.v: np.array([r.x, r.y, r.z]) for r in v[v["mesh_id"] == name].itertuples()}
        faces = f[f["mesh_id"] == name][["v0", "v1", "v2"]].to_numpy()
        assert set(faces.ravel()) == set(mine)
        # the kernel turns triangles by their places, which for slivers is a matter of rounding: compare corners
        assert sorted(tuple(sorted(t)) for t in soup(mine, faces)) == sorted(tuple(sorted(t)) for t in soup(want.x, want.f))
        if name == "torus":
            assert soup(mine, faces) == soup(want.x, want.f)


def test_surface_is_closed(spark, nodes_and_grids):
    n, g = nodes_and_grids
    v, f = fields.isosurface(n.where("mesh_id = 'torus'"), g)
    (r,) = topology.component_report(v, f).collect()
    assert (r["boundary_edges"], r["manifold"], r["orientable"], r["genus"]) == (0, True, True, 1)


def test_absent_and_repeated_nodes(spark):
    at = [("a", i, j, k, float(i) - 0.5) for i in range(3) for j in range(2) for k in range(2)]
    g = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 1.0, 3, 2, 2)], GRIDS)
    cells = lambda rows: fields.isosurface(spark.createDataFrame(rows, NODES), g)[1].count()
    whole = cells(at)
    assert whole > 0
    assert cells(at + at + [("a", 0, 0, 0, -9.0)]) == whole
    for bad in (None, math.nan, math.inf, -math.inf):
        assert cells([r if r[1:4] != (1, 1, 1) else (*r[:4], bad) for r in at]) == 0
    assert cells([]) == 0
    with pytest.raises(PySparkException, match="a node lies outside"):
        cells([*at, ("a", -1, 0, 0, 1.0)])


def test_samples_equal_the_kernel(spark, corpus, nodes_and_grids):
    rng = np.random.default_rng(2)
    points = {k: rng.uniform(-1, 5, size=(40, 3)) for k in corpus}
    at = [(k, i, *map(float, p)) for k, ps in points.items() for i, p in enumerate(ps)] + [("noise", 99, math.nan, 0.0, 0.0), ("noise", 98, None, 0.0, 0.0)]
    got = {(r["mesh_id"], r["p"]): r["value"] for r in fields.trilinear(*nodes_and_grids, spark.createDataFrame(at, "mesh_id string, p long, x double, y double, z double")).collect()}
    assert set(got) == {(k, i) for k in corpus for i in range(40)}
    for k, g in corpus.items():
        assert [got[k, i] for i in range(40)] == pytest.approx(list(g.sample(points[k])))


def test_sample_beside_an_absent_node(spark):
    n = spark.createDataFrame([("a", i, j, k, 1.0) for i in range(3) for j in range(2) for k in range(2) if (i, j, k) != (2, 0, 0)], NODES)
    g = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 1.0, 3, 2, 2)], GRIDS)
    p = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.5), ("a", 1, 1.5, 0.5, 0.5), ("a", 2, 1.0, 0.0, 0.0)], "mesh_id string, p long, x double, y double, z double")
    assert {r["p"]: r["value"] for r in fields.trilinear(n, g, p).collect()} == {0: 1.0, 1: None, 2: 1.0}


def test_splat_equals_a_loop(spark):
    h, origin = 0.4, np.array([-2.0, -2.0, -2.0])
    shapes = {"torus": M.torus(7, 5), "ball": M.icosphere(1), "flat": M.Mesh(np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0]]), np.array([[0, 1, 2]]))}
    g = spark.createDataFrame([(k, *map(float, origin), h, 0, 0, 0) for k in shapes], GRIDS)
    got = {(r["mesh_id"], r["i"], r["j"], r["k"]): (r["x"], r["y"], r["z"]) for r in fields.normal_splat(*tables(spark, shapes), g).collect()}
    want = {}
    for name, m in shapes.items():
        for a, b, c in m.x[m.f]:
            n = np.cross(b - a, c - a) / 2
            if not n.any():
                continue
            parts = max(1, math.ceil(max(np.linalg.norm(b - a), np.linalg.norm(c - b), np.linalg.norm(a - c)) / (h / 2)))
            node = lambda p, q: a + (b - a) * p / parts + (c - a) * q / parts  # noqa: E731, B023
            for p in range(parts):
                for q in range(parts - p):
                    small = [(node(p, q) + node(p + 1, q) + node(p, q + 1)) / 3]
                    if p + q < parts - 1:
                        small.append((node(p + 1, q) + node(p, q + 1) + node(p + 1, q + 1)) / 3)
                    for at in small:
                        at = (at - origin) / h
                        base = np.floor(at).astype(int)
                        for d in np.ndindex(2, 2, 2):
                            w = np.prod(np.where(d, at - base, 1 - (at - base)))
                            key = (name, *map(int, base + d))
                            want[key] = want.get(key, 0) + w * n / (parts**2 * h**3)
    big = lambda d: {k for k, v in d.items() if np.abs(v).max() > 1e-9}
    assert big(got) == big(want) and "flat" not in {k[0] for k in got}
    for k in big(want):
        assert got[k] == pytest.approx(tuple(want[k]), abs=1e-9)
