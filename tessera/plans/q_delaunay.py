"""Flips to intrinsic Delaunay triangulations of sheared grids, which stay flat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import delaunay
from tessera.sources import corpora

from .registry import query, table


@query("""WITH p AS (SELECT 'n' || n_nationkey AS mesh_id, n_nationkey % 5 + 4 AS nx, n_nationkey % 3 + 4 AS ny, n_nationkey % 4 AS s, 1 + 0.1::DOUBLE * n_nationkey AS h FROM nation)
SELECT mesh_id, 2 * nx * ny AS n_faces, round(h * h, 6) AS area, 0 AS bad, 0 AS skipped, s > 0 AS flipped, (nx - 1) * (ny - 1) AS flat_inside FROM p""")
def sheared_delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheared square per nation: every cell's long diagonal flips, and area, faces and flatness around inner vertices stay."""
    k = F.col("n_nationkey").cast("bigint")
    p = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k).alias("mesh_id"), (k % 5 + 4).alias("nx"), (k % 3 + 4).alias("ny"), (0.3 * (k % 4)).alias("shear"), (1 + 0.1 * k).alias("h"))
    v, f = corpora.grids(p)
    inside = (F.col("v") % (F.col("nx") + 1)).between(1, F.col("nx") - 1) & F.floor(F.col("v") / (F.col("nx") + 1)).between(1, F.col("ny") - 1)
    at = v.join(p, "mesh_id").select("mesh_id", "v", ((F.col("x") + F.col("shear") * F.col("y")) * F.col("h")).alias("x"), (F.col("y") * F.col("h")).alias("y"), "z")
    tri, report = delaunay.to_delaunay(delaunay.intrinsic(at, f))
    flat = delaunay.angle_sums(tri).join(p, "mesh_id").where(inside).groupBy("mesh_id").agg(F.count_if(F.abs(F.col("angle") - 2 * math.pi) < 1e-7).alias("flat_inside"))
    # each cell's own diagonal is the long one wherever there is a shear
    enough = (F.col("flips") >= F.col("nx") * F.col("ny")) & (F.col("shear") > 0)
    r = delaunay.quality(tri).join(report, "mesh_id").join(flat, "mesh_id").join(p, "mesh_id")
    return r.select("mesh_id", "n_faces", F.round("area", 6).alias("area"), "bad", "skipped", enough.alias("flipped"), "flat_inside")
