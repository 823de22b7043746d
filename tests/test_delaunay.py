"""Intrinsic Delaunay flips against the kernel's, and what flips must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import delaunay
from tessera.operators.kernels.surface import Intrinsic
from tessera.operators.model import tables
from tessera.sources import meshes as M


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(6)
    x = M.grid(6, 5)
    skew = M.Mesh(x.x @ np.array([[1, 0, 0], [0.7, 1, 0], [0, 0, 1]]) + rng.normal(scale=0.004, size=x.x.shape), x.f)
    t = M.torus(11, 5)
    # a tetrahedron whose flat edge can't be flipped: its opposite corners have an edge
    roof = M.Mesh(np.array([[0.0, 0, 0], [10, 0, 0], [5, 0.1, 0.1], [5, -0.1, 0.1]]), np.array([[0, 1, 2], [1, 0, 3], [2, 3, 0], [3, 2, 1]]))
    return {"skew": skew, "torus": M.Mesh(t.x + rng.normal(scale=0.05, size=t.x.shape), t.f), "roof": roof, "one": M.Mesh(np.eye(3), np.array([[0, 1, 2]]))}


@pytest.fixture(scope="module")
def result(spark, shapes):
    v, f = tables(spark, shapes)
    before = delaunay.intrinsic(v, f.withColumn("extra", F.lit(1)))
    return before, *delaunay.to_delaunay(before)


def lengths(df, name):
    return sorted(x for r in df.where(F.col("mesh_id") == name).collect() for x in (r["l0"], r["l1"], r["l2"]))


def test_flips_equal_the_kernel(shapes, result):
    _, tri, report = result
    rows = {r["mesh_id"]: r for r in report.collect()}
    quality = {r["mesh_id"]: r for r in delaunay.quality(tri).collect()}
    assert set(rows) == set(quality) == set(shapes)
    for name, m in shapes.items():
        t = Intrinsic(m)
        t.to_delaunay()
        assert (quality[name]["bad"] == 0) == t.is_delaunay()
        assert rows[name]["skipped"] == t.skipped
        # a Delaunay triangulation without ties is the only one
        if t.is_delaunay():
            assert lengths(tri, name) == pytest.approx(sorted(t.len))
    assert rows["skew"]["flips"] > 0 and rows["torus"]["flips"] > 0
    assert rows["roof"]["flips"] == 0 and rows["roof"]["skipped"] > 0
    assert quality["one"]["worst"] is None


def test_flips_keep_area_count_and_angles(shapes, result):
    before, tri, _ = result
    a, b = ({r["mesh_id"]: r for r in delaunay.quality(x).collect()} for x in (before, tri))
    for name in shapes:
        assert a[name]["n_faces"] == b[name]["n_faces"]
    # a flip unfolds two faces into the plane, so neither angles around a vertex nor area change
    p, q = ({(r["mesh_id"], r["v"]): r["angle"] for r in delaunay.angle_sums(x).collect()} for x in (before, tri))
    assert p.keys() == q.keys()
    for k in p:
        assert p[k] == pytest.approx(q[k])
    assert a["torus"]["area"] == pytest.approx(b["torus"]["area"])


def test_nothing(spark):
    v, f = tables(spark, {"a": M.torus(6, 4)})
    tri, report = delaunay.to_delaunay(delaunay.intrinsic(v, f.limit(0)))
    assert tri.isEmpty() and report.isEmpty()
