"""Nearest points, rays, undercuts, thickness, offsets, grids, cuts, rewriting, teeth."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry, metrics, voxels
from tessera.operators.fixpoint import suppressed_maxima
from tessera.operators.kernels import cuts, grids, margin, rays, rewrite, surface, teeth
from tessera.operators.model import per_mesh, tables
from tessera.operators.topology import edges
from tessera.sources import meshes as M

from .q_geometry import FRAME_SQL
from .q_topology import torus_corpus
from .registry import query, table


def _points(spark: SparkSession, sf_dir: str, remainder: int, name: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == remainder)
    return e.select("label", F.col("vec_id").alias(name), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))


_HALVES = """WITH e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM e a JOIN e b USING (label) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""


@query(_HALVES + " SELECT label, i, arg_min(j, (d, j)) AS j, round(min(d), 6) AS d FROM d GROUP BY ALL")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each even embedding the nearest odd one of its label, by a widening cell join."""
    n = metrics.nearest(_points(spark, sf_dir, 0, "i"), _points(spark, sf_dir, 1, "j"), ["label"], 0.25)
    return n.select("label", "i", "j", F.round("d", 6).alias("d"))


@query(_HALVES + """, s AS (SELECT label, 'p' AS side, i AS k, min(d) AS d FROM d GROUP BY ALL UNION ALL SELECT label, 't', j, min(d) FROM d GROUP BY ALL),
r AS (SELECT label, side, d, row_number() OVER (PARTITION BY label, side ORDER BY d) AS r, count(*) OVER (PARTITION BY label, side) AS n FROM s),
q AS (SELECT label, max(d) AS hd95 FROM r WHERE r = floor(0.95::DOUBLE * (n - 1)) + 1 GROUP BY label)
SELECT s.label, round(avg(d), 6) AS assd, round(any_value(hd95), 6) AS hd95 FROM s JOIN q USING (label) GROUP BY s.label""")
def boundary_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASSD and HD95 between the even and odd embeddings of each label."""
    b = metrics.boundary_metrics(_points(spark, sf_dir, 0, "i"), _points(spark, sf_dir, 1, "i"), ["label"])
    return b.select("label", F.round("assd", 6).alias("assd"), F.round("hd95", 6).alias("hd95"))


@query("SELECT l_returnflag AS g, round(sum(CASE WHEN l_quantity > 25 AND l_discount > 0.05::DOUBLE THEN l_extendedprice ELSE 0 END) / sum(CASE WHEN l_quantity > 25 OR l_discount > 0.05::DOUBLE THEN l_extendedprice ELSE 0 END), 6) AS iou FROM lineitem GROUP BY 1")
def region_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-weighted overlap of two predicates over order lines, as areas of two regions."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") > 25).cast("int").alias("pred"), (F.col("l_discount") > F.lit(0.05)).cast("int").alias("truth"), F.col("l_extendedprice").alias("area"))
    return metrics.region_iou(l, ["g"]).select("g", F.round("iou", 6).alias("iou"))


@query("SELECT * FROM (VALUES (1), (3)) t(v)")
def nms_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 0.5, 0.0, 0.0, 2.0), (2, 3.0, 0.0, 0.0, 0.5), (3, 3.2, 0.0, 0.0, 0.7)], "v long, x double, y double, z double, score double").withColumn("g", F.lit(1))
    near = metrics.within(p.withColumnRenamed("v", "i"), p.withColumnRenamed("v", "j"), 1.0, ["g"]).where("i <> j AND d < 1.0").select("g", F.col("i").alias("v"), F.col("j").alias("w"))
    return suppressed_maxima(p, near, ["g"]).select(F.col("v").cast("int").alias("v"))


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slanted ray per customer towards a supplier's torus; values that avoid edges."""
    s = table(spark, sf_dir, "supplier").count()
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("ray_id"), F.concat(F.lit("s"), k % s).alias("mesh_id"), ((k % 37) * 0.0713 - 1.3).alias("ox"), ((k % 41) * 0.0637 - 1.29).alias("oy"), F.lit(3.0).alias("oz"), ((k % 7) * 0.011 + 0.013).alias("dx"), ((k % 5) * 0.017 - 0.031).alias("dy"), F.lit(-1.0).alias("dz"))


_RAY_SQL = FRAME_SQL + """, ns AS (SELECT count(*) AS s FROM supplier),
ry AS (SELECT c_custkey AS ray_id, 's' || (c_custkey % s) AS mesh_id, (c_custkey % 37) * 0.0713::DOUBLE - 1.3::DOUBLE AS ox, (c_custkey % 41) * 0.0637::DOUBLE - 1.29::DOUBLE AS oy, 3.0::DOUBLE AS oz,
  (c_custkey % 7) * 0.011::DOUBLE + 0.013::DOUBLE AS dx, (c_custkey % 5) * 0.017::DOUBLE - 0.031::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM customer, ns),
t1 AS (SELECT ray_id, n.mesh_id, f, ox - ax AS sx, oy - ay AS sy, oz - az AS sz, dx, dy, dz, bx - ax AS ex, "by" - ay AS ey, bz - az AS ez, cx - ax AS fx, cy - ay AS fy, cz - az AS fz FROM ry JOIN n USING (mesh_id)),
t2 AS (SELECT *, dy * fz - dz * fy AS px, dz * fx - dx * fz AS py, dx * fy - dy * fx AS pz, sy * ez - sz * ey AS qx, sz * ex - sx * ez AS qy, sx * ey - sy * ex AS qz FROM t1),
t3 AS (SELECT *, ex * px + ey * py + ez * pz AS det FROM t2),
hit AS (SELECT ray_id, mesh_id, f, (fx * qx + fy * qy + fz * qz) / det AS t FROM t3 WHERE abs(det) >= 1e-18 AND (sx * px + sy * py + sz * pz) / det >= -1e-10
  AND (qx * dx + qy * dy + qz * dz) / det >= -1e-10 AND (sx * px + sy * py + sz * pz + qx * dx + qy * dy + qz * dz) / det <= 1 + 1e-10 AND (fx * qx + fy * qy + fz * qz) / det > 0)
"""


@query(_RAY_SQL + " SELECT ray_id, arg_min(f, (t, f)) AS f, round(min(t), 6) AS t FROM hit GROUP BY ray_id")
def ray_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = torus_corpus(spark, sf_dir)
    return voxels.nearest_hits(_rays(spark, sf_dir), f, v).select("ray_id", "f", F.round("t", 6).alias("t"))


@query(_RAY_SQL + " SELECT ray_id, EXISTS (SELECT 1 FROM hit WHERE hit.ray_id = ry.ray_id) AS occluded FROM ry")
def ray_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = torus_corpus(spark, sf_dir)
    return voxels.occluded(_rays(spark, sf_dir), f, v).select("ray_id", "occluded")


def _segment(a: str, b: str) -> str:
    """Squared distance from the origin to the segment of relative corners, as SQL."""
    ax, ay, az, bx, by, bz = (f'"{k}{c}"' for k in (a, b) for c in "xyz")
    e = [f"({bx} - {ax})", f"({by} - {ay})", f"({bz} - {az})"]
    t = f"greatest(0, least(1, -({ax} * {e[0]} + {ay} * {e[1]} + {az} * {e[2]}) / ({e[0]} ** 2 + {e[1]} ** 2 + {e[2]} ** 2)))"
    return " + ".join(f"({k} + {t} * {d}) ** 2" for k, d in zip((ax, ay, az), e, strict=True))


def _side(a: str, b: str) -> str:
    """Whether the origin is on the inner side of the edge."""
    ax, ay, az, bx, by, bz = (f'"{k}{c}"' for k in (a, b) for c in "xyz")
    u, w = [f"({bx} - {ax})", f"({by} - {ay})", f"({bz} - {az})"], [f"(-{ax})", f"(-{ay})", f"(-{az})"]
    return f"({u[1]} * {w[2]} - {u[2]} * {w[1]}) * nx + ({u[2]} * {w[0]} - {u[0]} * {w[2]}) * ny + ({u[0]} * {w[1]} - {u[1]} * {w[0]}) * nz >= 0"


@query(FRAME_SQL + f""", ns AS (SELECT count(*) AS s FROM supplier),
pt AS (SELECT c_custkey AS point_id, 's' || (c_custkey % s) AS mesh_id, (c_custkey % 37) * 0.1713::DOUBLE - 3.01::DOUBLE AS px, (c_custkey % 41) * 0.0637::DOUBLE - 1.29::DOUBLE AS py, (c_custkey % 11) * 0.37::DOUBLE - 1.777::DOUBLE AS pz FROM customer, ns),
r AS (SELECT point_id, n.mesh_id, ax - px AS ax, ay - py AS ay, az - pz AS az, bx - px AS bx, "by" - py AS "by", bz - pz AS bz, cx - px AS cx, cy - py AS cy, cz - pz AS cz, nx, ny, nz FROM pt JOIN n USING (mesh_id)),
m AS (SELECT point_id, mesh_id, CASE WHEN {_side("a", "b")} AND {_side("b", "c")} AND {_side("c", "a")} THEN (ax * nx + ay * ny + az * nz) ** 2 / (nx * nx + ny * ny + nz * nz)
  ELSE least({_segment("a", "b")}, {_segment("b", "c")}, {_segment("c", "a")}) END AS d2 FROM r)
SELECT point_id, mesh_id, round(sqrt(min(d2)), 6) AS d FROM m GROUP BY ALL""")
def closest_on_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per customer and its distance from a supplier's torus, by rings of cells."""
    v, f = torus_corpus(spark, sf_dir)
    s, k = table(spark, sf_dir, "supplier").count(), F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("point_id"), F.concat(F.lit("s"), k % s).alias("mesh_id"), ((k % 37) * 0.1713 - 3.01).alias("x"), ((k % 41) * 0.0637 - 1.29).alias("y"), ((k % 11) * 0.37 - 1.777).alias("z"))
    return voxels.closest_on_mesh(p, f, v).select("point_id", "mesh_id", F.round("d", 6).alias("d"))


@query("SELECT * FROM (VALUES ('sphere', 200, true, true), ('torus', 200, true, true)) t(mesh_id, n, rays_equal, closest_equal)")
def bvh_equals_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's nearest hits and closest points are those of a search over all faces."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        rng, b, ok, near = np.random.default_rng(5), rays.Bvh(m), True, True
        for _ in range(200):
            o, d = rng.normal(size=3) * 2, rng.normal(size=3)
            t = rays.ray_triangles(o, d, *(m.x[m.f[:, k]] for k in range(3)), 0.0, np.inf)[0].min()
            h = b.intersect(o, d)[0]
            ok &= bool(h == t or abs(h - t) < 1e-12)
            q = min(float(np.linalg.norm(o - rays.closest_on_triangle(o, *m.x[f]))) for f in m.f)
            near &= abs(b.closest(o)[1] - q) < 1e-12
        return pd.DataFrame({"mesh_id": [name], "n": [200], "rays_equal": [ok], "closest_equal": [near]})

    return per_mesh(*tables(spark, {"sphere": M.icosphere(1), "torus": M.torus(12, 6)}), kernel, "mesh_id string, n int, rays_equal boolean, closest_equal boolean")


def _plates() -> M.Mesh:
    """A unit plate, and above its quarter another one: the shadow is a quarter of the lower area."""
    low, up = M.grid(8, 8), M.grid(4, 4)
    return M.append(low, M.Mesh(up.x * (0.5, 0.5, 1) + (0, 0, 0.5), up.f))


@query("SELECT true AS no_worse, true AS clean, true AS within")
def insertion_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaning frustum is undercut along z; the search finds an axis within the tilt that isn't."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        region, z = np.ones(len(m.f), bool), np.array([0, 0, 1.0])
        start = rays.undercut_fraction(m, rays.undercut_faces(m, rays.Bvh(m), z, region), region)
        axis, value, _ = rays.best_axis(m, region, z, samples=40)
        return pd.DataFrame({"no_worse": [value <= start and start > 0.1], "clean": [value < 1e-9], "within": [bool(axis @ z >= math.cos(math.radians(30)) - 1e-9)]})

    c = M.cylinder(16, 3, 1.0, 2.0)
    lean = math.tan(math.radians(15))
    taper = 1 - 0.05 * c.x[:, 2]
    m = M.Mesh(np.stack([c.x[:, 0] * taper + lean * c.x[:, 2], c.x[:, 1] * taper, c.x[:, 2]], axis=1), c.f)
    return per_mesh(*tables(spark, {"frustum": m}), kernel, "no_worse boolean, clean boolean, within boolean")


def offset_shell(vertices: DataFrame, faces: DataFrame, wall: float) -> tuple[DataFrame, DataFrame]:
    """Outer surface, inner copy moved against the vertex normals and turned, and a wall on the rim."""
    n = geometry.vertex_normals(faces, vertices)
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    top = vertices.groupBy("mesh_id").agg((F.max("v") + 1).alias("nv"))
    moved = vertices.join(n, ["mesh_id", "v"], "left").join(top, "mesh_id").select("mesh_id", (F.col("v") + F.col("nv")).alias("v"), *((F.col(c) - wall * F.coalesce(F.try_divide(F.col("n" + c), size), F.lit(0.0))).alias(c) for c in "xyz"))
    count = faces.groupBy("mesh_id").agg((F.max("f") + 1).alias("nf"))
    f = faces.join(top, "mesh_id").join(count, "mesh_id")
    inner = f.select("mesh_id", (F.col("f") + F.col("nf")).alias("f"), (F.col("v0") + F.col("nv")).alias("v0"), (F.col("v2") + F.col("nv")).alias("v1"), (F.col("v1") + F.col("nv")).alias("v2"))
    from tessera.operators.topology import twins

    rim = twins(faces).where("twin IS NULL").join(top, "mesh_id").join(count, "mesh_id")
    side = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), a.alias("v0"), b.alias("v1"), c.alias("v2")) for k, (a, b, c) in enumerate(((F.col("dest"), F.col("origin"), F.col("origin") + F.col("nv")), (F.col("dest"), F.col("origin") + F.col("nv"), F.col("dest") + F.col("nv")))))))
    wall_ = rim.select("mesh_id", "h", "nf", side.alias("s")).select("mesh_id", (2 * F.col("nf") + 2 * F.col("h") + F.col("s.k")).alias("f"), "s.v0", "s.v1", "s.v2")
    return vertices.unionByName(moved), faces.unionByName(inner).unionByName(wall_)


@query("SELECT true AS poisson, true AS sign, true AS near, 2 AS chi, 0 AS loops, 2 AS shell_components")
def grid_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine solves invert the Laplacian; the signed distance of a sphere, its zero set, and a shell."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        rng = np.random.default_rng(3)
        b = rng.random((6, 7, 5))
        b -= b.mean()
        y = grids.solve_poisson(b)
        lap = np.zeros_like(b)
        for a in range(3):
            w = np.pad(y, [(1, 1) if k == a else (0, 0) for k in range(3)], mode="edge")
            n = b.shape[a]
            lap += w.take(range(2, n + 2), a) + w.take(range(n), a) - 2 * y
        g = grids.signed_heat_distance(m, 0.08)
        d = rng.normal(size=(200, 3))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        s = grids.isosurface(g)
        u, v, _ = surface.edges_of(s)
        shell = grids.offset_shell_sdf(m, 0.2, 40)
        parts = surface.component_labels(len(shell.x), *surface.edges_of(shell)[:2])
        return pd.DataFrame({
            "poisson": [bool(np.abs(lap - b).max() < 1e-9)],
            "sign": [bool((g.sample(d * 0.7) < 0).all() and (g.sample(d * 1.3) > 0).all())],
            "near": [bool(np.abs(np.linalg.norm(s.x, axis=1) - 1).mean() < 0.02)],
            "chi": [len(s.x) - len(u) + len(s.f)], "loops": [len(rewrite.boundary_loops(s))], "shell_components": [len(np.unique(parts))],
        })

    return per_mesh(*tables(spark, {"s": M.icosphere(3)}), kernel, "poisson boolean, sign boolean, near boolean, chi int, loops int, shell_components int")


@query("SELECT 1 AS genus, 0 AS loops")
def isosurface_torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero set of an analytic torus field on a grid has genus 1."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        i, j, k = np.meshgrid(*(np.arange(24),) * 3, indexing="ij")
        x, y, z = (-1.6 + 3.2 / 23 * a for a in (i, j, k))
        s = grids.isosurface(grids.Grid(np.sqrt((np.sqrt(x * x + y * y) - 1) ** 2 + z * z) - 0.4, np.full(3, -1.6), 3.2 / 23))
        u, _, _ = surface.edges_of(s)
        return pd.DataFrame({"genus": [(2 - (len(s.x) - len(u) + len(s.f))) // 2], "loops": [len(rewrite.boundary_loops(s))]})

    return per_mesh(*tables(spark, {"any": M.grid(1, 1)}), kernel, "genus int, loops int")


@query("SELECT 23.0::DOUBLE AS textbook, 60 AS cuts_equal, 40 AS expansions_ok, true AS start_kept")
def graph_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow equals the least of all cuts; expansion moves never raise the energy and stay within twice the optimum."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        g = cuts.MaxFlow(4)
        for v, s, t in ((0, 16, 0), (1, 13, 0), (2, 0, 20), (3, 0, 4)):
            g.add_terminal(v, s, t)
        for e in ((0, 2, 12), (1, 0, 4), (2, 1, 9), (1, 3, 14), (3, 2, 7)):
            g.add_edge(*e)
        rng, equal, fine = np.random.default_rng(2), 0, 0
        for _ in range(60):
            n = 6
            term = rng.integers(0, 9, (n, 2))
            arcs = [(i, j, int(rng.integers(0, 7)), int(rng.integers(0, 7))) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.6]
            h = cuts.MaxFlow(n)
            for v in range(n):
                h.add_terminal(v, *term[v])
            for a in arcs:
                h.add_edge(*a)
            cost = lambda s: sum(term[v][1] if s[v] else term[v][0] for v in range(n)) + sum(c * (s[i] and not s[j]) + r * (s[j] and not s[i]) for i, j, c, r in arcs)  # noqa: E731, B023
            flow = h.solve()
            equal += abs(flow - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-9 and abs(flow - cost(h.source_side())) < 1e-9
        for _ in range(40):
            n, l = 6, 3
            u = rng.random((n, l)) * 3
            e = np.array([x for x in itertools.combinations(range(n), 2) if rng.random() < 0.5] or [(0, 1)])
            w = rng.random(len(e))
            energy = lambda x: cuts.potts_energy(u, e[:, 0], e[:, 1], w, np.array(x))  # noqa: E731, B023
            got = energy(cuts.alpha_expansion(u, e[:, 0], e[:, 1], w, u.argmin(1), 10))
            fine += got <= energy(u.argmin(1)) + 1e-9 and got <= 2 * min(map(energy, itertools.product(range(l), repeat=n))) + 1e-9
        kept = cuts.alpha_expansion(np.array([[0.0, 1.0]] * 3), np.array([0, 1]), np.array([1, 2]), np.ones(2), np.zeros(3, int))
        return pd.DataFrame({"textbook": [g.solve()], "cuts_equal": [int(equal)], "expansions_ok": [int(fine)], "start_kept": [bool((kept == 0).all())]})

    return per_mesh(*tables(spark, {"any": M.grid(1, 1)}), kernel, "textbook double, cuts_equal int, expansions_ok int, start_kept boolean")


@query("SELECT true AS parents_first, true AS feasible")
def star_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With star constraints every node of a label has its parent in it too."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        rng, ok, bad = np.random.default_rng(4), True, False
        n = 7
        parents = np.stack([np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)])
        for _ in range(30):
            u = rng.random((n, 2)) * 4
            start = np.zeros(n, int)
            x = cuts.alpha_expansion(u, np.arange(n - 1), np.arange(1, n), rng.random(n - 1), start, 5, parents=parents)
            ok &= cuts.star_feasible(x, parents)
            bad |= not cuts.star_feasible(u.argmin(1), parents)
        return pd.DataFrame({"parents_first": [bad], "feasible": [ok]})

    return per_mesh(*tables(spark, {"any": M.grid(1, 1)}), kernel, "parents_first boolean, feasible boolean")


@query("SELECT * FROM (VALUES ('cap', 1, 0, 0, true), ('punched', 2, 0, 0, true)) t(mesh_id, filled, skipped, loops, near)")
def hole_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All holes close; a sphere's missing cap comes back within .05, a grid's hole stays flat."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        out, filled, skipped = rewrite.fill_holes(m)
        used = out.x[np.unique(out.f)]
        near = np.abs(np.linalg.norm(used, axis=1) - 1).max() < 0.05 if name == "cap" else np.abs(used[:, 2]).max() < 1e-9
        return pd.DataFrame({"mesh_id": [name], "filled": [filled], "skipped": [skipped], "loops": [len(rewrite.boundary_loops(out))], "near": [bool(near)]})

    s = M.icosphere(3)
    cap = M.Mesh(s.x, s.f[s.x[s.f].mean(1)[:, 2] <= 0.9])
    return per_mesh(*tables(spark, {"cap": cap, "punched": M.grid_with_holes(8, 8, [(3, 3)])}), kernel, "mesh_id string, filled int, skipped int, loops int, near boolean")


@query("SELECT * FROM (VALUES ('sphere', 2, true, true), ('torus', 0, true, true)) t(mesh_id, chi, better, closed)")
def remeshing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remeshing keeps the Euler characteristic, stays closed, and evens out the edge lengths."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        r = rewrite.remesh(m)
        u, _, _ = surface.edges_of(r)
        return pd.DataFrame({"mesh_id": [name], "chi": [len(r.x) - len(u) + len(r.f)], "better": [rewrite.quality(r)[1] < rewrite.quality(m)[1] + 0.05], "closed": [not rewrite.boundary_loops(r)]})

    return per_mesh(*tables(spark, {"torus": M.torus(24, 10), "sphere": M.icosphere(2)}), kernel, "mesh_id string, chi int, better boolean, closed boolean")


def bumps(n: int = 60) -> M.Mesh:
    g = M.grid(n, n)
    x, y = 10 * g.x[:, 0], 10 * g.x[:, 1]
    z = sum(0.8 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * 0.8**2)) for a, b in ((2.5, 2.5), (7, 3), (3, 7.5), (7.5, 7.5)))
    return M.Mesh(np.stack([x, y, z], axis=1), g.f)


@query("SELECT * FROM (VALUES ('smoothed', 4, true), ('prominence', 4, true)) t(method, tips, near)")
def cusp_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both detectors find the four bumps of a patch and nothing else."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        rows = []
        for method, threshold in (("smoothed", 0.05), ("prominence", 0.1)):
            k, _ = teeth.cusps(m, method, 0.5, 2.0, 0.5, threshold, 1.5, axis=np.array([0, 0, 1.0]))
            want = np.array([(2.5, 2.5), (7, 3), (3, 7.5), (7.5, 7.5)])
            d = np.linalg.norm(m.x[k][:, None, :2] - want[None], axis=2)
            rows.append((method, len(k), bool(len(k) and d.min(1).max() < 0.4 and d.min(0).max() < 0.4)))
        return pd.DataFrame(rows, columns=["method", "tips", "near"])

    return per_mesh(*tables(spark, {"bumps": bumps()}), kernel, "method string, tips int, near boolean")


@query("SELECT * FROM (VALUES ('voronoi', true, true), ('graph_cut', true, true), ('per_tooth', true, true)) t(method, close, overlap)")
def margin_synthetic_tooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelling's boundary stays within .3 of the crown's and overlaps it by over .9."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        i = margin.margin_inputs(m, radius=2.0, threshold=0.2, nms=1.5, axis=np.array([0, 0, 1.0]))
        truth = M.tooth_labels(m) > 0
        mid = lambda l: m.x[margin.margin_edges(m, l.astype(int))].mean(1)
        rows = []
        for method in ("voronoi", "graph_cut", "per_tooth"):
            got = margin.margin_labels(i, margin.MarginParams(method=method)) > 0
            rows.append((method, margin.compare_boundaries(mid(got), mid(truth))["assd"] < 0.3, (got & truth).sum() / (got | truth).sum() > 0.9))
        return pd.DataFrame(rows, columns=["method", "close", "overlap"]).astype({"close": bool, "overlap": bool})

    return per_mesh(*tables(spark, {"tooth": M.synthetic_tooth(60)}), kernel, "method string, close boolean, overlap boolean")


def domes(gap: float) -> M.Mesh:
    g = M.grid(60, 40)
    x, y = 12 * g.x[:, 0] - 6, 8 * g.x[:, 1] - 4
    z = np.maximum(*(np.sqrt(np.maximum(0, 4 - (x - c) ** 2 - y**2)) for c in (-gap, gap)))
    return M.Mesh(np.stack([x, y, z], axis=1), g.f)


@query("SELECT * FROM (VALUES ('apart', 2), ('joined', 1)) t(mesh_id, groups)")
def cusp_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two domes' tips make two groups across the valley between them, one without a curvature limit."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        k = teeth.curvatures(m)[2]
        tips = np.array([np.linalg.norm(m.x - (c, 0, 2), axis=1).argmin() for c in (-1.8, 1.8)])
        group = margin.group_tips(m, tips, np.isfinite(k), np.nan_to_num(k), -0.5 if name == "apart" else -1e9)
        return pd.DataFrame({"mesh_id": [name], "groups": [len(set(group.tolist()))]})

    d = domes(1.8)
    keep = d.f[(d.x[d.f][:, :, 2] > 1e-9).any(1)]
    d = M.Mesh(d.x, keep)
    return per_mesh(*tables(spark, {"apart": d, "joined": d}), kernel, "mesh_id string, groups int")
