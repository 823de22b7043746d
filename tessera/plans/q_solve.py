"""Linear systems and reachable sets over grids whose sizes come from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import patches, topology
from tessera.operators.solve import conjugate_gradient
from tessera.sources import corpora

from .registry import query, table


@query("""WITH p AS (SELECT n_nationkey AS g, n_nationkey % 5 + 4 AS nx, n_nationkey % 3 + 4 AS ny FROM nation),
v AS (SELECT g, nx, ny, i, j FROM p, range(0, 10) a(i), range(0, 10) b(j) WHERE i < nx AND j < ny),
m AS (SELECT g, k, l, 3 - 2 * cos(pi() * k / nx) + 2 - 2 * cos(pi() * l / ny) AS mu, (CASE WHEN k = 0 THEN 1 ELSE 2 END) / nx::DOUBLE * (CASE WHEN l = 0 THEN 1 ELSE 2 END) / ny::DOUBLE * cos(pi() * k * 0.5 / nx) * cos(pi() * l * 0.5 / ny) AS c
  FROM p, range(0, 10) a(k), range(0, 10) b(l) WHERE k < nx AND l < ny)
SELECT v.g, v.j * v.nx + v.i AS v, round((1 + v.g) * sum(c / mu * cos(pi() * k * (i + 0.5) / nx) * cos(pi() * l * (j + 0.5) / ny)), 6) AS x FROM v JOIN m USING (g) GROUP BY v.g, v.j, v.nx, v.i""")
def grid_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(I + graph Laplacian) x = b for a grid per nation and a load on one corner; its cosine modes give x in closed form."""
    k = F.col("n_nationkey").cast("bigint")
    p = table(spark, sf_dir, "nation").select(k.alias("g"), (k % 5 + 4).alias("nx"), (k % 3 + 4).alias("ny"))
    at = p.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") * F.col("ny") - 1)).alias("v"))
    right = at.where((F.col("v") + 1) % F.col("nx") != 0).select("g", "v", (F.col("v") + 1).alias("w"))
    up = at.where(F.col("v") + F.col("nx") < F.col("nx") * F.col("ny")).select("g", "v", (F.col("v") + F.col("nx")).alias("w"))
    part = F.explode(F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(a).alias("a")) for i, j, a in (("v", "w", -1.0), ("w", "v", -1.0), ("v", "v", 1.0), ("w", "w", 1.0)))))
    matrix = right.union(up).select("g", part.alias("t")).select("g", "t.*").union(at.select("g", F.col("v").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("a")))
    load = p.select("g", F.lit(0).cast("bigint").alias("i"), (F.col("g") + 1.0).alias("b"))
    return conjugate_gradient(matrix, load, ["g"]).select("g", F.col("i").alias("v"), F.round("x", 6).alias("x"))


@query("""WITH p AS (SELECT 'n' || n_nationkey AS mesh_id, n_nationkey % 3 + 1 AS k, 2 * (n_nationkey % 5 + 9) * (n_nationkey % 4 + 9) AS f FROM nation)
SELECT mesh_id, 3 * k * k + 3 * k + 1 AS reached, k AS farthest, 6 * k * k AS punched, f - 6 * k * k AS kept, 2 AS loops, 6 * k AS rim FROM p""")
def punched_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of some hops punched out of the middle of a grid per nation: a hexagon of known size."""
    k = F.col("n_nationkey").cast("bigint")
    p = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k).alias("mesh_id"), (k % 5 + 9).alias("nx"), (k % 4 + 9).alias("ny"), (k % 3 + 1).cast("int").alias("reach"))
    _, f = corpora.grids(p)
    seeds = p.select("mesh_id", (F.floor(F.col("ny") / 2) * (F.col("nx") + 1) + F.floor(F.col("nx") / 2)).alias("v"), "reach")
    reached = patches.reachable(topology.edges(f), seeds, ["mesh_id"]).groupBy("mesh_id").agg(F.count("*").alias("reached"), F.max("hops").alias("farthest"))
    left, gone = patches.punch(f, seeds)
    size = p.select("mesh_id", (2 * (F.col("nx") + F.col("ny"))).alias("_outer"))
    e = topology.edges(left).where("kind = 'boundary'").groupBy("mesh_id").agg(F.count("*").alias("_rim")).join(size, "mesh_id").select("mesh_id", (F.col("_rim") - F.col("_outer")).alias("rim"))
    counts = [gone.groupBy("mesh_id").agg(F.count("*").alias("punched")), left.groupBy("mesh_id").agg(F.count("*").alias("kept")), topology.boundary_components(left).groupBy("mesh_id").agg(F.count_distinct("label").alias("loops")), e]
    out = reached
    for c in counts:
        out = out.join(c, "mesh_id")
    return out.select("mesh_id", "reached", "farthest", "punched", "kept", "loops", "rim")
