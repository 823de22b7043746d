"""Fields on grids whose sizes and shapes come from the tables, with surfaces of known area."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fields, topology
from tessera.operators.fixpoint import cut
from tessera.operators.geometry import signed_volume
from tessera.operators.model import face_positions
from tessera.sources import corpora

from .registry import query, table


def _nodes(grids: DataFrame) -> DataFrame:
    """Every node of a grid (mesh_id, ox, oy, oz, h, nx, ny, nz, ...), with its place."""
    at = grids
    for a, c in zip("ijk", "xyz", strict=True):
        at = at.withColumn(a, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n" + c) - 1)))
    return at.withColumns({c: F.col("o" + c) + F.col("h") * F.col(a) for a, c in zip("ijk", "xyz", strict=True)})


def _area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    p = face_positions(faces, vertices)
    u, v = ([F.col(q + c) - F.col("a" + c) for c in "xyz"] for q in "bc")
    n = sum((u[(a + 1) % 3] * v[(a + 2) % 3] - u[(a + 2) % 3] * v[(a + 1) % 3]) ** 2 for a in range(3))
    return p.groupBy("mesh_id").agg(F.sum(F.sqrt(n) / 2).alias("area"), F.count("*").alias("n_faces"))


@query("SELECT 'n' || n_nationkey AS mesh_id, 2::BIGINT AS chi, 0::BIGINT AS open_edges, true AS area_close, true AS volume_close FROM nation")
def isosurface_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sphere per nation out of its distance field: closed, of one piece's chi, area and volume within 2 % of the sphere's."""
    k = F.col("n_nationkey").cast("bigint")
    g = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k).alias("mesh_id"), *(F.lit(-1.6).alias("o" + c) for c in "xyz"), F.lit(0.1).alias("h"), *(F.lit(33).cast("bigint").alias("n" + c) for c in "xyz"), (0.6 + 0.03 * k).alias("r"))
    at = _nodes(g).withColumn("value", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - F.col("r"))
    v, f = (cut(t) for t in fields.isosurface(at, g))
    e = topology.edges(f).groupBy("mesh_id").agg(F.count("*").alias("e"), F.count_if(F.col("kind") != "manifold").alias("open_edges"))
    r = v.groupBy("mesh_id").agg(F.count("*").alias("n")).join(e, "mesh_id").join(_area(v, f), "mesh_id").join(signed_volume(f, v), "mesh_id").join(g.select("mesh_id", "r"), "mesh_id")
    near = F.abs(F.col("area") / (4 * math.pi * F.col("r") ** 2) - 1) < 0.02
    full = F.abs(F.col("volume") / (4 / 3 * math.pi * F.col("r") ** 3) - 1) < 0.02
    return r.select("mesh_id", (F.col("n") - F.col("e") + F.col("n_faces")).alias("chi"), "open_edges", near.alias("area_close"), full.alias("volume_close"))


_PLANE = "WITH p AS (SELECT 'n' || n_nationkey AS mesh_id, n_nationkey % 5 + 6 AS n, 0.05::DOUBLE * (n_nationkey % 7) AS a, 0.02::DOUBLE * (n_nationkey % 4) AS b FROM nation)"


@query(_PLANE + " SELECT mesh_id, round(n * n * 0.25::DOUBLE * sqrt(1 + a * a + b * b), 6) AS area, round(1.13::DOUBLE + a * n * 0.25 + b * n * 0.25, 6) AS middle FROM p")
def isosurface_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tilted plane per nation cut out of a box: its area, and its height over the box's middle sampled from the field."""
    k = F.col("n_nationkey").cast("bigint")
    n = k % 5 + 6
    g = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), k).alias("mesh_id"), F.lit(-1.0).alias("ox"), F.lit(2.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.5).alias("h"),
        (n + 1).alias("nx"), (n + 1).alias("ny"), F.lit(16).cast("bigint").alias("nz"), (0.05 * (k % 7)).alias("a"), (0.02 * (k % 4)).alias("b"),
    )
    at = _nodes(g).withColumn("value", F.col("z") - 1.13 - F.col("a") * (F.col("x") + 1) - F.col("b") * (F.col("y") - 2))
    v, f = fields.isosurface(at, g)
    middle = g.select("mesh_id", F.lit(0).alias("p"), (F.col("ox") + (F.col("nx") - 1) * 0.25).alias("x"), (F.col("oy") + (F.col("ny") - 1) * 0.25).alias("y"), F.lit(3.3).alias("z"))
    height = fields.trilinear(at, g, middle).select("mesh_id", F.round(3.3 - F.col("value"), 6).alias("middle"))
    return _area(v, f).select("mesh_id", F.round("area", 6).alias("area")).join(height, "mesh_id")


@query("""SELECT 'n' || n_nationkey AS mesh_id, round(-0.1::DOUBLE * n_nationkey, 6) AS ax, round(0.5::DOUBLE - 0.05::DOUBLE * n_nationkey, 6) AS ay, 1.0::DOUBLE AS az, 0.5::DOUBLE AS mx, round(0.05::DOUBLE * n_nationkey + 0.5 * (0.05::DOUBLE * n_nationkey - 0.5), 6) AS mz FROM nation""")
def splatted_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sloping square per nation splatted onto nodes: the area vector (ax, ay, az) and the mean place by its z part, as the square's own."""
    k = F.col("n_nationkey").cast("bigint")
    nation = table(spark, sf_dir, "nation")
    p = nation.select(F.concat(F.lit("n"), k).alias("mesh_id"), (k % 4 + 1).alias("nx"), (k % 3 + 1).alias("ny"), (0.1 * k).alias("a"), (0.05 * k - 0.5).alias("b"))
    v, f = corpora.grids(p)
    v = v.join(p.select("mesh_id", "a", "b"), "mesh_id").select("mesh_id", "v", "x", "y", (F.col("a") * F.col("x") + F.col("b") * F.col("y")).alias("z"))
    g = nation.select(F.concat(F.lit("n"), k).alias("mesh_id"), F.lit(-0.4).alias("ox"), F.lit(-0.3).alias("oy"), F.lit(-1.0).alias("oz"), (0.15 + 0.01 * (k % 5)).alias("h"))
    d = fields.normal_splat(v, f, g.withColumn("extra", F.lit(1))).join(g, "mesh_id").withColumn("w", F.pow("h", F.lit(3)))
    sums = {"a" + c: F.sum(F.col(c) * F.col("w")) for c in "xyz"}
    sums |= {"m" + c: F.sum((F.col("o" + c) + F.col("h") * F.col(a)) * F.col("z") * F.col("w")) for a, c in (("i", "x"), ("k", "z"))}
    # + 0.0: no negative zeros
    return d.groupBy("mesh_id").agg(*((F.round(s, 6) + 0.0).alias(name) for name, s in sums.items()))
