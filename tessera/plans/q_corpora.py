"""Operators over corpora whose sizes and measures come from the tables, so that the answers have a closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.picks import quantile_index
from tessera.operators import geometry, metrics, topology, voxels
from tessera.operators.kernels import margin, rays
from tessera.operators.model import per_mesh
from tessera.sources import corpora
from tessera.sources import meshes as M

from .q_geometry import FRAME_SQL
from .q_spatial import _HALVES, _points, offset_shell
from .q_topology import TORUS_SQL, torus_corpus
from .q_views import fdi_category
from .registry import query, table


def key() -> Column:
    return F.col("n_nationkey")


def _nations(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("mesh_id"), *(c.alias(name) for name, c in columns.items()))


def _arches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A flat square grid per nation, of its own size and spacing."""
    p = _nations(spark, sf_dir, nx=6 + key() % 4, ny=6 + key() % 4, h=0.5 + 0.1 * key())
    v, f = corpora.grids(p)
    v = v.join(p, "mesh_id").select("mesh_id", "v", *((F.col(c) * F.col("nx") * F.col("h")).alias(c) for c in "xyz"))
    return v, f


def _arch_inputs(m: M.Mesh) -> margin.Inputs:
    """The middle vertex is the one tip, its score the spacing; the axis leans over the plane."""
    n = math.isqrt(len(m.x)) - 1
    return margin.margin_inputs(m, axis=np.array([0.6, 0.0, 0.8]), tips=(np.array([n // 2 * (n + 2)]), np.array([m.x[1, 0]])))


_ARCH = """WITH p AS (SELECT 'n' || n_nationkey AS mesh_id, (6 + n_nationkey % 4)::BIGINT AS n, 0.5::DOUBLE + 0.1::DOUBLE * n_nationkey AS h FROM nation),
g AS (SELECT *, id % (n + 1) AS i, id // (n + 1) AS j, n // 2 AS c, floor(0.15::DOUBLE * ((n + 1) * (n + 1) - 1))::BIGINT // (n + 1) AS k FROM p, range(0, 100) r(id) WHERE id < (n + 1) * (n + 1)),
d AS (SELECT *, h * least(i, j, n - i, n - j) AS rim, h * greatest(0, least(i - k, j, n - i, n - j)) AS gum,
  h * CASE WHEN (i - c) * (j - c) >= 0 THEN sqrt(2.0::DOUBLE) * least(abs(i - c), abs(j - c)) + abs(abs(i - c) - abs(j - c)) ELSE abs(i - c) + abs(j - c) END AS tooth FROM g)
"""


@query(_ARCH + """SELECT mesh_id, id AS v, round(ln(gum + 1e-9) - ln(tooth + 1e-9), 5) AS "log_dG_over_dT", round(i / (n + 1), 6) AS height_quantile, 0.8::DOUBLE AS normal_dot_axis, 0.0::DOUBLE AS kappa_min, 0.0::DOUBLE AS kappa_max,
round(ln(1 + rim), 5) AS log1p_dist_to_cut, round(ln(1 + tooth), 5) AS log1p_dist_to_tooth_seed, round((i / (n + 1)) ** 2, 6) AS height_quantile_sq, 0.64::DOUBLE AS normal_dot_axis_sq FROM d""")
def margin_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex model's nine inputs on flat arches: distances to rim, gum seeds and tip in closed form."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        x = pd.DataFrame(margin.vertex_features(_arch_inputs(m), margin.MarginParams(valley_weight=0.0)), columns=margin.VERTEX_FEATURES)
        x.insert(0, "v", np.arange(len(m.x)))
        x.insert(0, "mesh_id", name)
        return x

    places = dict.fromkeys(margin.VERTEX_FEATURES, 6) | {"log_dG_over_dT": 5, "log1p_dist_to_cut": 5, "log1p_dist_to_tooth_seed": 5}
    x = per_mesh(*_arches(spark, sf_dir), kernel, "mesh_id string, v bigint, " + ", ".join(f"{c} double" for c in margin.VERTEX_FEATURES))
    return x.select("mesh_id", "v", *((F.round(c, n) + 0.0).alias(c) for c, n in places.items()))


@query(_ARCH + """SELECT mesh_id, round(h, 6) AS prominence_mm, round(c / (n + 1), 6) AS height_quantile, 0.8::DOUBLE AS normal_dot_axis, round(rim, 6) AS distance_to_cut_mm,
0.0::DOUBLE AS smoothed_mean_curvature, 0.0::DOUBLE AS smoothed_gaussian_curvature FROM d WHERE i = c AND j = c""")
def seed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed model's six inputs for the tip of each flat arch."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        x = pd.DataFrame(margin.seed_features(_arch_inputs(m)), columns=margin.SEED_FEATURES)
        x.insert(0, "mesh_id", name)
        return x

    x = per_mesh(*_arches(spark, sf_dir), kernel, "mesh_id string, " + ", ".join(f"{c} double" for c in margin.SEED_FEATURES))
    return x.select("mesh_id", *((F.round(c, 6) + 0.0).alias(c) for c in margin.SEED_FEATURES))


@query(_ARCH + "SELECT mesh_id, count(*) AS plane FROM g WHERE i >= floor(0.5::DOUBLE * ((n + 1) * (n + 1) - 1))::BIGINT // (n + 1) GROUP BY mesh_id")
def margin_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tooth vertices of the height plane on flat arches."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        return pd.DataFrame({"mesh_id": [name], "plane": [int((margin.margin_labels(_arch_inputs(m), margin.MarginParams(method="plane")) > 0).sum())]})

    return per_mesh(*_arches(spark, sf_dir), kernel, "mesh_id string, plane bigint")


@query("SELECT 'n' || n_nationkey AS mesh_id, round(((1 + n_nationkey % 7) / 8) ** 2, 9) AS fraction FROM nation")
def undercut_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From above a floating plate hides its footprint on the plate below."""
    p = _nations(spark, sf_dir, nx=F.lit(8), ny=F.lit(8), side=(1 + key() % 7) / 8.0)
    low_v, low_f = corpora.grids(p)
    up_v, up_f = corpora.grids(p.select("mesh_id", F.lit(4).alias("nx"), F.lit(4).alias("ny")))
    up_v = up_v.join(p, "mesh_id").select("mesh_id", (F.col("v") + 81).alias("v"), (F.col("x") * F.col("side")).alias("x"), (F.col("y") * F.col("side")).alias("y"), F.lit(0.5).alias("z"))
    up_f = up_f.select("mesh_id", (F.col("f") + 128).alias("f"), *((F.col(c) + 81).alias(c) for c in ("v0", "v1", "v2")))

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        region = np.arange(len(m.f)) < 128
        hidden = rays.undercut_faces(m, rays.Bvh(m), np.array([0, 0, 1.0]), region)
        return pd.DataFrame({"mesh_id": [name], "fraction": [round(float(rays.undercut_fraction(m, hidden, region)), 9)]})

    return per_mesh(low_v.unionByName(up_v), low_f.unionByName(up_f), kernel, "mesh_id string, fraction double")


@query("SELECT 'n' || n_nationkey AS mesh_id, round(0.3::DOUBLE + 0.04::DOUBLE * n_nationkey, 9) AS least, round(0.3::DOUBLE + 0.04::DOUBLE * n_nationkey, 9) AS along FROM nation")
def wall_thickness_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slab per nation: the least thickness, and that along the normal."""
    p = _nations(spark, sf_dir, nx=F.lit(3), ny=F.lit(3), wall=0.3 + 0.04 * key())
    v, f = corpora.grids(p)
    at = [(F.col("x") * 4).alias("x"), (F.col("y") * 4).alias("y")]
    top = v.join(p, "mesh_id").select("mesh_id", "v", *at, F.col("wall").alias("z"))
    low = v.select("mesh_id", (F.col("v") + 16).alias("v"), *at, "z")
    turned = f.select("mesh_id", (F.col("f") + 18).alias("f"), (F.col("v0") + 16).alias("v0"), (F.col("v2") + 16).alias("v1"), (F.col("v1") + 16).alias("v2"))

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        w = rays.wall_thickness(m)
        return pd.DataFrame({"mesh_id": [name], "least": [round(float(np.nanmin(w[:, 0])), 9)], "along": [round(float(np.nanmax(w[:, 2])), 9)]})

    return per_mesh(top.unionByName(low), f.unionByName(turned), kernel, "mesh_id string, least double, along double")


@query("WITH p AS (SELECT n_nationkey AS k, 5 + n_nationkey % 5 AS a, 4 + n_nationkey % 3 AS b FROM nation) SELECT 'n' || k AS mesh_id, 2 * (a + 1) * (b + 1) AS n_vertices, 4 * a * b + 4 * (a + b) AS n_faces, 0 AS boundary_edges FROM p")
def naive_offset_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface, turned inward copy and side walls: closed, with 2 F + 2 rim faces."""
    out_v, out_f = offset_shell(*corpora.grids(_nations(spark, sf_dir, nx=5 + key() % 5, ny=4 + key() % 3)), 0.1)
    rim = topology.edges(out_f).groupBy("mesh_id").agg(F.count_if(F.col("kind") == "boundary").cast("int").alias("boundary_edges"))
    return out_v.groupBy("mesh_id").agg(F.count("*").cast("int").alias("n_vertices")).join(out_f.groupBy("mesh_id").agg(F.count("*").cast("int").alias("n_faces")), "mesh_id").join(rim, "mesh_id")


@query("SELECT 'n' || n_nationkey AS mesh_id, 72::BIGINT AS n, (n_nationkey + 1)::DOUBLE AS gx, (-(n_nationkey % 4) - 1)::DOUBLE AS gy, 0.0::DOUBLE AS gz, 1::BIGINT AS distinct_gradients FROM nation")
def gradient_of_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a linear function is its coefficients on every face of a jittered grid."""
    p = _nations(spark, sf_dir, nx=F.lit(6), ny=F.lit(6), cx=key() + 1.0, cy=-(key() % 4) - 1.0)
    v, f = corpora.grids(p)
    inner = (F.col("x") > 0.01) & (F.col("x") < 0.99) & (F.col("y") > 0.01) & (F.col("y") < 0.99)
    v = v.select("mesh_id", "v", *((F.col(c) + F.when(inner, 0.05 * F.sin(12.9898 * (F.col("v") + s))).otherwise(0.0)).alias(c) for c, s in (("x", 0), ("y", 7))), "z")
    u = v.join(p, "mesh_id").select("mesh_id", "v", (F.col("cx") * F.col("x") + F.col("cy") * F.col("y") + 1).alias("u"))
    g = geometry.face_gradient(v, f, u).select("mesh_id", *((F.round(c, 9) + 0.0).alias("g" + c) for c in "xyz"))
    return g.groupBy("mesh_id").agg(F.count("*").alias("n"), *(F.min("g" + c).alias("g" + c) for c in "xyz"), F.count_distinct("gx", "gy", "gz").alias("distinct_gradients"))


@query(f"WITH {TORUS_SQL} SELECT mesh_id, true AS agree, count(*) AS n FROM x GROUP BY mesh_id")
def divergence_of_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """div grad u = L u at every vertex of every torus."""
    v, f = torus_corpus(spark, sf_dir)
    u = v.select("mesh_id", "v", (F.col("x") * F.col("y") + F.col("z")).alias("u"))
    d = geometry.divergence(v, f, geometry.face_gradient(v, f, u))
    lu = geometry.laplacian(v, f).join(u.withColumnRenamed("v", "j"), ["mesh_id", "j"]).groupBy("mesh_id", F.col("i").alias("v")).agg(F.sum(F.col("a") * F.col("u")).alias("lu"))
    return d.join(lu, ["mesh_id", "v"]).groupBy("mesh_id").agg((F.max(F.abs(F.col("div") - F.col("lu"))) < 1e-9).alias("agree"), F.count("*").alias("n"))


@query("SELECT 'n' || n_nationkey AS mesh_id, v::BIGINT AS v, round((n_nationkey + 1) * (n_nationkey + 1) * share, 6) AS area FROM nation, (VALUES (0, 0.25::DOUBLE), (1, 0.25::DOUBLE), (2, 0.5::DOUBLE)) t(v, share)")
def obtuse_mixed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An obtuse triangle gives half its area to the obtuse corner and a quarter to the others."""
    p = _nations(spark, sf_dir, s=key() + 1.0)
    corner = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("v"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(((0.0, 0.0), (4.0, 0.0), (2.0, 0.5))))))
    v = p.select("mesh_id", "s", corner.alias("c")).select("mesh_id", "c.v", (F.col("c.x") * F.col("s")).alias("x"), (F.col("c.y") * F.col("s")).alias("y"), F.lit(0.0).alias("z"))
    f = p.select("mesh_id", F.lit(0).cast("bigint").alias("f"), *(F.lit(k).cast("bigint").alias(f"v{k}") for k in range(3)))
    return geometry.curvature(v, f).select("mesh_id", "v", F.round("area", 6).alias("area"))


@query("WITH p AS (SELECT n_nationkey AS g, (2 * n_nationkey + 1.5::DOUBLE) / 100 AS gap FROM nation) SELECT g, round(gap, 9) AS assd, round(gap, 9) AS hd95, (gap <= 0.25)::INT::DOUBLE AS f1_025, 1.0::DOUBLE AS f1_050 FROM p")
def parallel_lines_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parallel lines per nation at its own distance."""
    n = table(spark, sf_dir, "nation").select(key().alias("g"), ((2 * key() + 1.5) / 100).alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    line = lambda y: n.select("g", "i", (F.col("i") * 0.1).alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return metrics.boundary_metrics(line(F.lit(0.0)), line(F.col("gap")), ["g"]).select("g", *(F.round(c, 9).alias(c) for c in ("assd", "hd95", "f1_025", "f1_050")))


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
t AS (SELECT *, least(greatest(x, 0), 1) AS a, least(greatest(y, 0), 1) AS b, least(greatest((1 - x + y) / 2, 0), 1) AS c FROM e)
SELECT vec_id, round(sqrt(z * z + CASE WHEN x >= 0 AND y >= 0 AND x + y <= 1 THEN 0 ELSE least((x - a) ** 2 + y ** 2, x ** 2 + (y - b) ** 2, (x - 1 + c) ** 2 + (y - c) ** 2) END), 6) AS d FROM t""")
def closest_point_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the embeddings' first coordinates to one right triangle."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias("p" + c) for k, c in enumerate("xyz")))
    t = p.select("*", *(F.lit(float(x)).alias(n + c) for n, xyz in (("a", (0, 0, 0)), ("b", (1, 0, 0)), ("c", (0, 1, 0))) for c, x in zip("xyz", xyz, strict=True)))
    return t.select("vec_id", F.round(F.sqrt(voxels.closest_on_triangle()["d2"]), 6).alias("d"))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE (s_suppkey % 4 + 1) * 10 + s_suppkey % 8 + 1 END AS fdi FROM supplier)
SELECT s_suppkey, CASE WHEN fdi = 0 THEN NULL ELSE ['incisor', 'incisor', 'canine', 'premolar', 'premolar', 'molar', 'molar', 'molar'][fdi % 10] END AS category FROM t""")
def fdi_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(k, F.when(k % 9 == 0, 0).otherwise((k % 4 + 1) * 10 + k % 8 + 1).alias("fdi"))
    return t.select("s_suppkey", fdi_category(F.col("fdi")).alias("category"))


@query(FRAME_SQL + """, s AS (SELECT mesh_id, (bx - ax) ** 2 + ("by" - ay) ** 2 + (bz - az) ** 2 AS p, (cx - bx) ** 2 + (cy - "by") ** 2 + (cz - bz) ** 2 AS q, (ax - cx) ** 2 + (ay - cy) ** 2 + (az - cz) ** 2 AS r FROM n),
a AS (SELECT mesh_id, least(acos((p + r - q) / (2 * sqrt(p * r))), acos((p + q - r) / (2 * sqrt(p * q))), acos((q + r - p) / (2 * sqrt(q * r)))) AS a FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY a) AS k, count(*) OVER (PARTITION BY mesh_id) AS m FROM a) SELECT mesh_id, round(degrees(a), 6) AS p10 FROM o WHERE k = floor(0.1::DOUBLE * (m - 1)) + 1""")
def least_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10th percentile of the faces' least angles, by index."""
    v, f = torus_corpus(spark, sf_dir)
    c = geometry.corners(f, v).groupBy("mesh_id", "f").agg(F.min("angle").alias("a"))
    return quantile_index(c, "a", 0.1, ["mesh_id"], "p10").select("mesh_id", F.round(F.degrees("p10"), 6).alias("p10"))


@query(f"WITH {TORUS_SQL}, a AS (SELECT mesh_id, count(*)::INT AS n_vertices FROM x GROUP BY mesh_id), b AS (SELECT mesh_id, count(*)::INT AS n_faces FROM f GROUP BY mesh_id) SELECT mesh_id, n_vertices, n_faces, 1 AS components, 0 AS loops, 1 AS genus, 0 AS misoriented FROM a JOIN b USING (mesh_id)")
def scan_quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quality row per mesh: sizes, components, loops, genus, misoriented edges."""
    v, f = torus_corpus(spark, sf_dir)
    c = topology.component_report(v, f).groupBy("mesh_id").agg(*(F.sum(x).cast("int").alias(x) for x in ("n_vertices", "n_faces")), F.count("*").cast("int").alias("components"), F.sum("loops").cast("int").alias("loops"), F.coalesce(F.sum("genus"), F.lit(0)).cast("int").alias("genus"))
    return c.join(topology.edges(f).groupBy("mesh_id").agg(F.count_if(F.col("kind") == "misoriented").cast("int").alias("misoriented")), "mesh_id")


@query("""WITH RECURSIVE e AS (SELECT label, vec_id AS v, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, row_number() OVER (PARTITION BY label ORDER BY embedding[4] DESC, vec_id) AS r FROM embeddings),
k(label, r, kept) AS (SELECT DISTINCT label, 0::BIGINT, []::STRUCT(v BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] FROM e UNION ALL
  SELECT k.label, e.r, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(k.kept) AS q) WHERE sqrt((q.x - e.x) * (q.x - e.x) + (q.y - e.y) * (q.y - e.y) + (q.z - e.z) * (q.z - e.z)) < 0.5) THEN kept ELSE list_append(kept, {'v': e.v::BIGINT, 'x': e.x, 'y': e.y, 'z': e.z}) END
  FROM k JOIN e ON e.label = k.label AND e.r = k.r + 1),
l AS (SELECT label, arg_max(kept, r) AS kept FROM k GROUP BY label) SELECT label, unnest(kept).v AS v FROM l""")
def nms_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings kept by greedy suppression within .5 of a better one of their label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("v"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")), F.col("embedding")[3].cast("double").alias("score"))
    return metrics.suppressed_within(e, 0.5, ["label"])


@query(_HALVES.replace("WITH e", "WITH RECURSIVE e", 1) + """, p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, i, j) AS r FROM d WHERE d <= 0.5),
k(label, r, a, b) AS (SELECT DISTINCT label, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM p UNION ALL
  SELECT k.label, p.r, CASE WHEN list_contains(a, p.i) OR list_contains(b, p.j) THEN a ELSE list_append(a, p.i) END, CASE WHEN list_contains(a, p.i) OR list_contains(b, p.j) THEN b ELSE list_append(b, p.j) END FROM k JOIN p ON p.label = k.label AND p.r = k.r + 1),
l AS (SELECT label, arg_max(a, r) AS a, arg_max(b, r) AS b FROM k GROUP BY label) SELECT label, unnest(a) AS i, unnest(b) AS j FROM l""")
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd embeddings of a label matched one to one by ascending distance, up to .5."""
    return metrics.matched_within(_points(spark, sf_dir, 0, "i"), _points(spark, sf_dir, 1, "j"), 0.5, ["label"]).select("label", "i", "j")
