import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.picks import quantile_index, upper_median
from tessera.operators import geometry, topology
from tessera.operators.fixpoint import components, cycle_positions, shortest_paths
from tessera.operators.kernels import cuts, greedy, grids, linear, rays, rewrite, surface, teeth
from tessera.operators.learn import Logistic
from tessera.operators.model import per_mesh, tables
from tessera.plans.session import MeshSession, register_functions
from tessera.sources import mesh_io
from tessera.sources import meshes as M
from tessera.streaming.inbox import watch


def counts(m):
    u, _, _ = surface.edges_of(m)
    return len(m.x), len(u), len(m.f)


@pytest.mark.parametrize("s", range(5))
def test_icosphere_counts(s):
    assert counts(M.icosphere(s)) == (10 * 4**s + 2, 30 * 4**s, 20 * 4**s)


@pytest.mark.parametrize("make", [lambda: M.grid(0, 3), lambda: M.torus(2, 5), lambda: M.icosphere(11), lambda: M.mobius(2), lambda: M.cylinder(3, 0), lambda: M.plate_with_handle(3)])
def test_invalid_parameters_give_an_empty_mesh(make):
    m = make()
    assert not len(m.x) and not len(m.f)


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 12), st.integers(3, 9))
def test_torus_is_closed_with_genus_one(nu, nv):
    m = M.torus(nu, nv)
    v, e, f = counts(m)
    assert (v - e + f, len(rewrite.boundary_loops(m)), len(rewrite.handle_loops(m))) == (0, 0, 2)


def test_parsers_round_trip_and_report_places():
    m = M.torus(5, 4)
    again = mesh_io.parse_obj(mesh_io.write_obj(m))
    assert (again.x == m.x).all() and (again.f == m.f).all()
    soup = mesh_io.parse_stl(mesh_io.write_stl(m))
    assert np.allclose(soup.x.reshape(-1, 3, 3), m.x[m.f], atol=1e-6)
    bad = bytearray(mesh_io.write_stl(m))
    bad[84 + 50 * 2 + 12 : 84 + 50 * 2 + 16] = np.float32(np.inf).tobytes()
    with pytest.raises(mesh_io.ParseError, match="triangle 2: non-finite coordinate"):
        mesh_io.parse_stl(bytes(bad))
    for token, want in (("1e3", 1000.0), ("-.5", -0.5), ("1.", 1.0), ("nan", None), ("inf", None), ("1d", None), ("", None), ("0x1", None), ("1e999", None)):
        assert mesh_io.parse_double(token) == want


def test_greedy_weld_is_not_transitive():
    x = np.array([[0.0, 0, 0], [0.9, 0, 0], [1.8, 0, 0], [0.95, 0, 0]])
    assert greedy.weld_within(x, 1.0).tolist() == [0, 0, 2, 0]


def test_index_quantiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 10)] + [("b", None), ("b", 5.0)], "g string, x double")
    assert {r["g"]: r["median"] for r in upper_median(df, "x", ["g"]).collect()} == {"a": 3.0, "b": 5.0}
    assert {r["g"]: r["q"] for r in quantile_index(df, "x", 0.95, ["g"]).collect()} == {"a": 3.0, "b": 5.0}


def test_fixpoints_agree_with_the_kernels(spark):
    rng = np.random.default_rng(3)
    n = 80
    e = rng.integers(0, n, (70, 2))
    w = rng.random(70) + 0.1
    df = spark.createDataFrame([(0, int(a), int(b), float(c)) for (a, b), c in zip(e, w)], "g int, u long, v long, len double")
    nodes = spark.range(n).selectExpr("0 AS g", "id AS v")
    got = {r["v"]: r["label"] for r in components(nodes, df, ["g"]).collect()}
    assert [got[i] for i in range(n)] == surface.component_labels(n, e[:, 0], e[:, 1]).tolist()
    d = surface.dijkstra(n, surface.adjacency(n, e[:, 0], e[:, 1], w), [int(e[0, 0])])[0]
    paths = {r["v"]: r["d"] for r in shortest_paths(df, spark.createDataFrame([(0, int(e[0, 0]))], "g int, v long"), ["g"]).collect()}
    assert paths == pytest.approx({i: d[i] for i in range(n) if d[i] < np.inf})


def test_cycles_by_pointer_doubling(spark):
    nxt = {0: 3, 3: 1, 1: 0, 7: 9, 9: 8, 8: 11, 11: 7, 20: 21}
    df = spark.createDataFrame([(0, a, b) for a, b in nxt.items()], "g int, v long, next long")
    got = {r["v"]: (r["loop"], r["position"], r["length"]) for r in cycle_positions(df, ["g"]).collect()}
    assert got == {0: (0, 0, 3), 3: (0, 1, 3), 1: (0, 2, 3), 7: (7, 0, 4), 9: (7, 1, 4), 8: (7, 2, 4), 11: (7, 3, 4)}


def test_curvature_kernel_equals_the_relational_one(spark):
    m = M.torus(16, 8)
    c = geometry.curvature(*tables(spark, {"t": m})).orderBy("v").toPandas()
    mean, k1, k2 = teeth.curvatures(m)
    assert np.allclose(c["mean"], mean) and np.allclose(c["k1"], k1) and np.allclose(c["k2"], k2)


def test_intrinsic_curvature_equals_the_plain_one_on_a_delaunay_mesh():
    m = M.icosphere(2)
    assert surface.Intrinsic(m).is_delaunay()
    for a, b in zip(teeth.intrinsic_curvatures(m), teeth.curvatures(m), strict=True):
        assert np.allclose(a, b, equal_nan=True)
    flat = teeth.intrinsic_curvatures(M.brick_grid(10))[0]
    assert np.nanmax(np.abs(flat)) < 1e-9


def test_curvature_converges_with_second_order():
    errors = []
    for n in (16, 32, 64):
        m = M.torus(2 * n, n)
        v = np.arctan2(m.x[:, 2], np.hypot(m.x[:, 0], m.x[:, 1]) - 1)
        exact = (1 + 2 * 0.3 * np.cos(v)) / (2 * 0.3 * (1 + 0.3 * np.cos(v)))
        errors.append(np.abs(teeth.curvatures(m)[0] - exact).max())
    assert math.log2(errors[1] / errors[2]) > 1.8


def test_factor_and_its_error():
    n = 40
    p = np.arange(n) * 37 % n
    i = np.arange(n - 1)
    a = linear.Coo.of(n, np.r_[p[i], p[i + 1], p], np.r_[p[i + 1], p[i], p], np.r_[-np.ones(2 * n - 2), np.full(n, 2.0)])
    assert linear.BandCholesky(a).width == 1
    with pytest.raises(ValueError, match="not positive definite at pivot"):
        linear.BandCholesky(a.plus_diagonal(1.0, np.full(n, -2.5)))
    assert linear.conjugate_gradient(a, np.zeros(n)) [1:] == (0, True)


def test_heat_geodesic_errors():
    h = surface.HeatGeodesics(M.icosphere(1))
    for sources, message in (([], "no source"), ([99], "out of range")):
        with pytest.raises(ValueError, match=message):
            h.distance(sources)
    two = M.append(M.icosphere(1), M.icosphere(1))
    d = surface.HeatGeodesics(two).distance([0])
    assert np.isnan(d[42:]).all() and not np.isnan(d[:42]).any()


def test_flow_value_is_the_cut_of_the_minimal_side():
    g = cuts.MaxFlow(2)
    g.add_terminal(0, 5, 0)
    g.add_terminal(1, 0, 5)
    g.add_edge(0, 1, 5)
    assert g.solve() == 5 and g.source_side().tolist() == [False, False]


@settings(max_examples=15, deadline=None)
@given(st.integers(4, 7), st.integers(0, 10_000))
def test_triangulation_by_area_is_the_least_of_all(n, seed):
    rng = np.random.default_rng(seed)
    x = np.c_[np.cos(2 * np.pi * np.arange(n) / n), np.sin(2 * np.pi * np.arange(n) / n), rng.normal(size=n) * 0.3]
    loop, outside = list(range(n)), [None] * n

    def all_of(i, k):
        if k - i < 2:
            return [[]]
        return [[(i, j, k), *a, *b] for j in range(i + 1, k) for a in all_of(i, j) for b in all_of(j, k)]

    area = lambda t: rewrite.triangulation_weight(x, loop, t, outside)[1]
    best = min(map(area, all_of(0, n - 1)))
    assert area(rewrite.triangulate_loop(x, loop, outside, dihedral=False)) == pytest.approx(best)
    assert len(rewrite.triangulate_loop(x, loop, outside)) == n - 2


def test_trilinear_sampling_clamps():
    g = grids.Grid(np.arange(8.0).reshape(2, 2, 2), np.zeros(3), 1.0)
    assert g.sample(np.array([[0.5, 0.5, 0.5], [-3, 0, 0], [9, 9, 9]])).tolist() == [3.5, 0.0, 7.0]


def test_axis_parallel_rays_and_intervals():
    b = rays.Bvh(M.Mesh([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)]))
    assert b.intersect((0.25, 0.5, 2), (0, 0, -1)) == pytest.approx((2, 0, 0.25, 0.5))
    assert b.intersect((0.25, 0.5, 2), (0, 0, -1), t_max=2.0)[1] == -1
    assert b.intersect((0.25, 0.5, 2), (0, 0, -1), ignore=0)[1] == -1
    assert not b.occluded((5, 5, 2), (0, 0, -1))


def test_a_mesh_too_large_for_a_task_is_refused(spark, monkeypatch):
    from tessera.operators import model

    v, f = tables(spark, {"g": M.grid(4, 4)})
    assert per_mesh(v, f, lambda n, m: __import__("pandas").DataFrame({"n": [len(m.f)]}), "n long").first()["n"] == 32
    assert model.MAX_CORNERS > 0


def test_report_keeps_the_betti_identity(spark):
    v, f = tables(spark, {"a": M.plate_with_handle(), "b": M.append(M.torus(6, 5), M.grid_with_holes(5, 5, [(1, 1)]))})
    for r in topology.component_report(v, f).collect():
        assert r["betti"][0] - r["betti"][1] + r["betti"][2] == r["chi"]


def test_logistic_json():
    m = Logistic(["a"], [0.5], [2.0], [1.5], -0.25)
    assert Logistic.from_json(m.to_json()) == m
    with pytest.raises(ValueError, match="inconsistent sizes"):
        Logistic.from_json(json.dumps({"model": "logistic", "features": ["a"], "mean": [], "scale": [1], "weights": [1], "bias": 0}))


def test_session(spark):
    s = MeshSession(spark)
    assert s.generate("nothing").startswith("unknown preset") and s.load(b"", "ply").startswith("unknown format")
    assert s.load(mesh_io.write_stl(M.icosphere(1)), "stl") == "" and len(s.mesh.x) == 42
    r = json.loads(s.report())
    assert r["halfedge"]["ok"] and r["components"][0]["genus"] == 0 and abs(r["total_defect"] - 4 * math.pi) < 1e-9
    assert s.geodesic([0]).max() == pytest.approx(math.pi, abs=0.6)
    assert s.offset_shell(-1.0) == "wall must be > 0" and "error" in json.loads(s.compare_margin([]))
    assert s.offset_shell(0.1, "naive") == "" and len(s.mesh.x) == 84


def test_sql_functions_and_file_source(spark, tmp_path):
    register_functions(spark)
    assert spark.sql("SELECT count(*) FROM mesh_faces_of('grid')").first()[0] == 512
    (tmp_path / "a.obj").write_text(mesh_io.write_obj(M.torus(5, 4)))
    (tmp_path / "b.stl").write_bytes(b"not a mesh")
    for df in (mesh_io.read_files(spark, str(tmp_path)), spark.read.format("mesh").load(str(tmp_path))):
        got = {r["mesh_id"]: (r["error"], len(r["faces"] or [])) for r in df.collect()}
        assert got["a"] == (None, 40) and got["b"][0].startswith("line 1")


def test_stream_of_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.obj").write_text(mesh_io.write_obj(M.grid(2, 2)))
    for name in ("b", None):
        watch(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if name:
            (inbox / f"{name}.obj").write_text("f 1 2 3\n")
    got = {r["mesh_id"]: (r["error"], r["boundary_edges"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (None, 8), "b": ("line 1: face index out of range", None)}


def test_margin_models_and_priors():
    from tessera.operators.kernels import cuts, margin
    from tessera.operators.learn import Logistic

    m = M.synthetic_tooth(30)
    i = margin.margin_inputs(m, radius=2.0, threshold=0.2, nms=1.5, axis=np.array([0, 0, 1.0]))
    p = margin.MarginParams
    model = lambda names, w, bias: Logistic(names, [0.0] * len(names), [1.0] * len(names), w, bias)
    assert len(margin.seeds(i, p())[1]) == len(i.tips) > 1
    # half of the tips by a quantile of height, none by a model that says no, none by a veto
    no = model(margin.SEED_FEATURES, [0.0] * 6, -1.0)
    assert len(margin.seeds(i, p(seed_model=no))[1]) == 0
    assert len(margin.seeds(i, p(seed_model=no, seed_threshold=0.2))[1]) == len(i.tips)
    assert len(margin.seeds(i, p(seed_veto=np.ones(len(m.x), bool)))[1]) == 0
    gate = np.sort(i.height[i.arch])[int(0.95 * (i.arch.sum() - 1))]
    assert len(margin.seeds(i, p(tip_q=0.95))[1]) == (i.height[i.tips] >= gate).sum()
    # the top vertex alone is a height seed at quantile 1
    assert (margin.seeds(i, p(cusp_seeds=False))[0] == 1).sum() == (i.height == i.height[i.arch].max()).sum()
    # a model sure of gum leaves the seeds and little else
    cut = lambda **k: (margin.margin_labels(i, p(method="graph_cut", mu=1.0, **k)) > 0).sum()
    assert cut(vertex_model=model(margin.VERTEX_FEATURES, [0.0] * 9, -20.0), vertex_weight=50.0) < cut() < cut(vertex_model=model(margin.VERTEX_FEATURES, [0.0] * 9, 20.0), vertex_weight=50.0)
    # each tip a tooth of its own; with stars every tooth hangs together with its tip
    for plain in (False, True):
        labels = margin.margin_labels(i, p(tau=1e9, star=True, star_plain=plain))
        u, v, _ = i.edges
        same = labels[u] == labels[v]
        part = margin.component_labels(len(labels), u[same], v[same])
        assert all(len(np.unique(part[labels == k])) == 1 for k in range(1, labels.max() + 1))
    whole, carved = (margin.margin_labels(i, p(tau=1e9, strip_kmin=s)) for s in (-np.inf, np.inf))
    assert (whole > 0).sum() > (carved > 0).sum() and not ((whole == 0) & (carved > 0)).any()
    chain = np.stack([np.arange(5), np.array([0, 0, 1, 2, -1])])
    assert cuts.star_repair(np.array([1, 1, 0, 1, 1]), chain).tolist() == [1, 1, 0, 0, 0]
    assert not cuts.star_feasible(np.array([1, 0, 1, 0, 0]), chain)
