"""Aggregations over corners and edges: areas, curvature, operators, sparse matrices, paths."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import geometry, topology
from tessera.operators.fixpoint import shortest_paths
from tessera.operators.kernels.linear import BandCholesky, Coo, conjugate_gradient, reverse_cuthill_mckee
from tessera.operators.kernels.surface import HeatGeodesics, Intrinsic, Operators
from tessera.operators.model import per_mesh, tables
from tessera.sources import corpora
from tessera.sources import meshes as M

from .q_topology import TORUS_SQL, torus_corpus
from .registry import query, table

FRAME_SQL = f"""
WITH {TORUS_SQL},
g AS (SELECT f.mesh_id, f.f, v0, v1, v2, a.x ax, a.y ay, a.z az, b.x bx, b.y "by", b.z bz, c.x cx, c.y cy, c.z cz
  FROM f JOIN x a ON a.mesh_id = f.mesh_id AND a.v = v0 JOIN x b ON b.mesh_id = f.mesh_id AND b.v = v1 JOIN x c ON c.mesh_id = f.mesh_id AND c.v = v2),
n AS (SELECT *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS nz FROM g)
"""


@query(FRAME_SQL + "SELECT mesh_id, f, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area FROM n")
def face_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = torus_corpus(spark, sf_dir)
    return geometry.face_frames(f, v).select("mesh_id", "f", F.round("area", 6).alias("area"))


@query(FRAME_SQL + """, s AS (SELECT mesh_id, v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT mesh_id, v0 AS v, nx, ny, nz FROM n UNION ALL SELECT mesh_id, v1, nx, ny, nz FROM n UNION ALL SELECT mesh_id, v2, nx, ny, nz FROM n) GROUP BY ALL)
SELECT mesh_id, v, round(sqrt(nx * nx + ny * ny + nz * nz), 6) AS size FROM s""")
def vertex_normal_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = torus_corpus(spark, sf_dir)
    n = geometry.vertex_normals(f, v)
    return n.select("mesh_id", "v", F.round(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), 6).alias("size"))


@query(FRAME_SQL + """SELECT mesh_id, round(sum(ax * ("by" * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - "by" * cx)) / 6, 6) AS volume FROM n GROUP BY mesh_id""")
def signed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = torus_corpus(spark, sf_dir)
    return geometry.signed_volume(f, v).select("mesh_id", F.round("volume", 6).alias("volume"))


@query(f"WITH {TORUS_SQL} SELECT mesh_id, round(min(x), 6) + 0 AS lo_x, round(max(x), 6) + 0 AS hi_x, round(min(z), 6) + 0 AS lo_z, round(max(z), 6) + 0 AS hi_z FROM x GROUP BY mesh_id")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = torus_corpus(spark, sf_dir)
    b = geometry.bounding_box(f, v)
    return b.select("mesh_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("lo_x", "hi_x", "lo_z", "hi_z")))


@query(f"""WITH {TORUS_SQL} SELECT DISTINCT mesh_id, 0.0::DOUBLE AS total, true AS tiles FROM p""")
def gauss_bonnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle defects sum to 2 pi chi, and mixed areas tile the surface."""
    v, f = torus_corpus(spark, sf_dir)
    c = geometry.curvature(v, f).groupBy("mesh_id").agg((F.round(F.sum("defect"), 6) + 0.0).alias("total"), F.sum("area").alias("mixed"))
    a = geometry.face_frames(f, v).groupBy("mesh_id").agg(F.sum("area").alias("area"))
    return c.join(a, "mesh_id").select("mesh_id", "total", (F.abs(F.col("mixed") - F.col("area")) < 1e-9).alias("tiles"))


@query("""SELECT * FROM (VALUES ('sphere', 162, 162, true, true), ('grid', 49, 25, true, true)) t(mesh_id, n, inner_n, mean_ok, gauss_ok)""")
def pointwise_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sphere of radius 2: mean .5 and gauss .25 nearly; flat grid: both 0; none on boundaries."""
    c = geometry.curvature(*tables(spark, {"sphere": M.icosphere(2, 2.0), "grid": M.grid(6, 6)}))
    sphere = F.col("mesh_id") == "sphere"
    return c.groupBy("mesh_id").agg(
        F.count("*").cast("int").alias("n"),
        F.count("mean").cast("int").alias("inner_n"),
        (F.max(F.abs(F.col("mean") - F.when(sphere, 0.5).otherwise(0.0))) < 1e-4).alias("mean_ok"),
        (F.max(F.abs(F.col("gauss") - F.when(sphere, 0.25).otherwise(0.0))) < 0.02).alias("gauss_ok"),
    )


@query(f"WITH {TORUS_SQL} SELECT DISTINCT mesh_id, true AS rows_vanish, true AS symmetric, true AS areas FROM p")
def laplacian_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L 1 = 0, L = L', and the lumped areas sum to the surface."""
    v, f = torus_corpus(spark, sf_dir)
    l = geometry.laplacian(v, f)
    t = l.select("mesh_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b"))
    rows = l.groupBy("mesh_id", "i").agg(F.sum("a").alias("s")).groupBy("mesh_id").agg((F.max(F.abs("s")) < 1e-9).alias("rows_vanish"))
    sym = l.join(t, ["mesh_id", "i", "j"], "left").groupBy("mesh_id").agg((F.max(F.abs(F.col("a") - F.coalesce("b", F.lit(1e9)))) < 1e-9).alias("symmetric"))
    area = geometry.star0(v, f).groupBy("mesh_id").agg(F.sum("area").alias("s0")).join(geometry.face_frames(f, v).groupBy("mesh_id").agg(F.sum("area").alias("s")), "mesh_id").select("mesh_id", (F.abs(F.col("s0") - F.col("s")) < 1e-9).alias("areas"))
    return rows.join(sym, "mesh_id").join(area, "mesh_id")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.assemble(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("a")))


_M = "WITH m AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS a FROM lineitem GROUP BY ALL)"


@query(_M + " SELECT i, j, a FROM m")
def triplets_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as triplets (part, supplier, quantity), duplicates summed."""
    return _matrix(spark, sf_dir)


@query(_M + " SELECT i, round(sum(a * s_acctbal), 2) AS y FROM m JOIN supplier ON s_suppkey = j GROUP BY i")
def sparse_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("x"))
    return geometry.spmv(_matrix(spark, sf_dir), x).select("i", F.round("y", 2).alias("y"))


@query(_M + ", d AS (SELECT i, a AS d FROM m WHERE i = j) SELECT (SELECT count(*) FROM m)::BIGINT AS nonzeros, (SELECT count(*) FROM d)::BIGINT AS diagonal, (SELECT sum(d) FROM d) AS trace")
def transpose_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = geometry.transpose(_matrix(spark, sf_dir))
    on = F.when(F.col("i") == F.col("j"), F.col("a"))
    return t.agg(F.count("*").alias("nonzeros"), F.count(on).alias("diagonal"), F.sum(on).alias("trace"))


@query("""WITH m AS (SELECT l_orderkey AS i, l_linenumber AS j, sum(l_quantity) AS a FROM lineitem GROUP BY ALL), w AS (SELECT o_orderkey AS i, o_totalprice AS w FROM orders)
SELECT p.j AS i, q.j AS j, round(sum(w.w * p.a * q.a) / 1e6, 0) AS a FROM m p JOIN m q ON p.i = q.i JOIN w ON w.i = p.i GROUP BY ALL""")
def weighted_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D' W D of the order x line matrix, weighted by the orders' prices."""
    m = geometry.assemble(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("a")))
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("w"))
    return geometry.weighted_gram(m, w).select("i", "j", F.round(F.col("a") / 1e6, 0).alias("a"))


def _jittered(n: int) -> M.Mesh:
    g = M.grid(n, n)
    k = np.arange(len(g.x))
    inner = (g.x[:, :2] > 1e-9).all(1) & (g.x[:, :2] < 1 - 1e-9).all(1)
    for d in range(2):
        g.x[inner, d] += 0.3 / n * np.sin(12.9898 * (k[inner] + 7 * d))
    return g


def _grid_edges(spark: SparkSession, sf_dir: str, n: int = 12) -> DataFrame:
    """One n x n grid per nation, scaled to unit spacing times the nation's number."""
    p = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("mesh_id"), F.lit(n).alias("nx"), F.lit(n).alias("ny"), (F.col("n_nationkey") + 1.0).alias("scale"))
    v, f = corpora.grids(p)
    v = v.join(p.select("mesh_id", "scale"), "mesh_id").select("mesh_id", "v", *((F.col(c) * n * F.col("scale")).alias(c) for c in "xyz"))
    return geometry.edge_lengths(v, f).select("mesh_id", "u", "v", "len")


_GRID = "WITH g AS (SELECT 'n' || n_nationkey AS mesh_id, n_nationkey + 1.0::DOUBLE AS s, id % 13 AS i, id // 13 AS j, id FROM nation, range(0, 169) r(id))"


@query(_GRID + " SELECT mesh_id, id AS v, round(s * (sqrt(2.0::DOUBLE) * least(i, j) + abs(i - j)), 6) AS d FROM g")
def dijkstra_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge distances from one corner of every grid; diagonals run the same way."""
    e = _grid_edges(spark, sf_dir)
    return shortest_paths(e, e.select("mesh_id", F.lit(0).cast("bigint").alias("v")).distinct(), ["mesh_id"]).select("mesh_id", "v", F.round("d", 6).alias("d"))


@query(_GRID + """, t AS (SELECT *, sqrt(2.0::DOUBLE) * least(i, j) + abs(i - j) AS a, sqrt(2.0::DOUBLE) * least(12 - i, 12 - j) + abs(i - j) AS b FROM g)
SELECT mesh_id, id AS v, round(s * least(a, b), 4) AS d, CASE WHEN a <= b + 1e-9 THEN 0 ELSE 168 END::BIGINT AS owner FROM t""")
def multi_source_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearer of two opposite corners and its owner, ties to the smaller id."""
    e = _grid_edges(spark, sf_dir)
    s = e.select("mesh_id").distinct().select("mesh_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(168).cast("bigint"))).alias("v"))
    r = shortest_paths(e.withColumn("len", F.round("len", 9)), s, ["mesh_id"])
    return r.select("mesh_id", "v", F.round("d", 4).alias("d"), "owner")


@query(_GRID + " SELECT mesh_id, count(*) AS n FROM g WHERE s * (sqrt(2.0::DOUBLE) * least(i, j) + abs(i - j)) <= 30.1 GROUP BY mesh_id")
def bounded_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _grid_edges(spark, sf_dir)
    return shortest_paths(e, e.select("mesh_id", F.lit(0).cast("bigint").alias("v")).distinct(), ["mesh_id"], max_distance=30.1).groupBy("mesh_id").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('s2', true), ('s3', true), ('s4', true)) t(mesh_id, in_band)")
def heat_geodesics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error against great circles stays within .05, .03 and .02 as the sphere is refined."""
    band = {"s2": 0.05, "s3": 0.03, "s4": 0.02}

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        d = HeatGeodesics(m).distance([5])
        return pd.DataFrame({"mesh_id": [name], "in_band": [bool(np.abs(d - np.arccos(np.clip(m.x @ m.x[5], -1, 1))).mean() < band[name])]})

    return per_mesh(*tables(spark, {f"s{k}": M.icosphere(k) for k in (2, 3, 4)}), kernel, "mesh_id string, in_band boolean")


@query("SELECT * FROM (VALUES ('grid', true, true, true), ('sphere', true, true, true), ('torus', true, true, true)) t(mesh_id, cg, factor, permutation)")
def linear_solvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjugate gradients and the banded factor solve (star0 - t L) x = b; the ordering is a permutation."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        o = Operators(Intrinsic(m))
        a: Coo = o.l.plus_diagonal(-0.1, o.star0)
        x = np.sin(np.arange(o.n) * 0.7)
        ok = lambda y: bool(np.abs(y - x).max() < 1e-6)
        return pd.DataFrame({"mesh_id": [name], "cg": [ok(conjugate_gradient(a, a @ x, 1e-12)[0])], "factor": [ok(BandCholesky(a).solve(a @ x))], "permutation": [sorted(reverse_cuthill_mckee(a)) == list(range(o.n))]})

    return per_mesh(*tables(spark, {"grid": M.grid(9, 7), "sphere": M.icosphere(2), "torus": M.torus(16, 8)}), kernel, "mesh_id string, cg boolean, factor boolean, permutation boolean")


@query("SELECT * FROM (VALUES ('brick', false, true, true, true), ('grid', true, true, false, true)) t(mesh_id, was_delaunay, is_delaunay, flipped, same_area)")
def delaunay_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        t = Intrinsic(m)
        before, area = t.is_delaunay(), t.areas().sum()
        t.to_delaunay()
        return pd.DataFrame({"mesh_id": [name], "was_delaunay": [before], "is_delaunay": [t.is_delaunay()], "flipped": [t.flips > 0], "same_area": [bool(abs(t.areas().sum() - area) < 1e-9)]})

    return per_mesh(*tables(spark, {"brick": M.brick_grid(20), "grid": M.grid(8, 8)}), kernel, "mesh_id string, was_delaunay boolean, is_delaunay boolean, flipped boolean, same_area boolean")


@query(f"WITH {TORUS_SQL}, d AS (SELECT mesh_id, o AS v, max(d) AS top FROM (SELECT mesh_id, o, d FROM he UNION ALL SELECT mesh_id, d, o FROM he) GROUP BY ALL) SELECT mesh_id, v FROM d WHERE top * 7919 % 101 < v * 7919 % 101 AND NOT EXISTS (SELECT 1 FROM (SELECT mesh_id, o, d FROM he UNION ALL SELECT mesh_id, d, o FROM he) e WHERE e.mesh_id = d.mesh_id AND e.o = d.v AND e.d * 7919 % 101 >= d.v * 7919 % 101)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices whose hashed score beats every neighbour's."""
    e = topology.edges(torus_corpus(spark, sf_dir)[1])
    both = e.select("mesh_id", "u", "v").union(e.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
    score = lambda c: F.col(c) * 7919 % 101
    return both.groupBy("mesh_id", F.col("u").alias("v")).agg(F.max(score("v")).alias("top")).where(F.col("top") < score("v")).select("mesh_id", "v")


@query("""WITH e AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)
SELECT label, round(covar_pop(x, x), 6) AS xx, round(covar_pop(x, y), 6) AS xy, round(covar_pop(y, z), 6) AS yz FROM e GROUP BY label""")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums behind a principal axis, per label of the first three embedding coordinates."""
    e = table(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return e.groupBy("label").agg(*(F.round(F.covar_pop(a, b), 6).alias(a + b) for a, b in ("xx", "xy", "yz")))


@query("""WITH e AS (SELECT label, vec_id, embedding[3]::DOUBLE AS z, row_number() OVER (PARTITION BY label ORDER BY embedding[3]) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
g AS (SELECT label, z AS gate FROM e WHERE r = floor(0.75 * (n - 1)) + 1) SELECT e.label, count(*) AS n FROM e JOIN g USING (label) WHERE e.z >= gate GROUP BY e.label""")
def height_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at or above the index quantile of their label's heights."""
    w = Window.partitionBy("label")
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[2].cast("double").alias("z"))
    r = e.withColumns({"r": F.row_number().over(w.orderBy("z")), "n": F.count("*").over(w)})
    gate = r.where(F.col("r") == F.floor(F.lit(0.75) * (F.col("n") - 1)) + 1).select("label", F.col("z").alias("gate"))
    return e.join(gate, "label").where("z >= gate").groupBy("label").agg(F.count("*").alias("n"))
