"""Handles of a torus per nation, whose shortest loop goes once around the tube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.handles import handle_loops
from tessera.sources import corpora

from .registry import query, table


@query("""SELECT 'n' || n_nationkey AS mesh_id, 2 AS loops, round((5 + n_nationkey % 4) * 2 * (0.2 + n_nationkey * 0.01) * sin(pi() / (5 + n_nationkey % 4)), 6) AS shortest,
  (5 + n_nationkey % 4)::BIGINT AS shortest_size, 1 AS turns FROM nation""")
def torus_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loops a torus, the shorter one the tube's polygon, that turn around both ways independently.

    ``turns`` is the determinant of how often each loop goes around the axis and around the tube.
    """
    k = F.col("n_nationkey").cast("bigint")
    p = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k).alias("mesh_id"), (k % 5 + 9).alias("nu"), (k % 4 + 5).alias("nv"), F.lit(1.5).alias("big"), (0.2 + k * 0.01).alias("small"))
    loops, places = handle_loops(*corpora.tori(p))
    shape = loops.join(p.select("mesh_id", "nu", "nv"), "mesh_id")
    nxt = places.select("mesh_id", "loop", F.col("position").alias("_p"), F.col("v").alias("w"))
    step = places.join(shape, ["mesh_id", "loop"]).select("mesh_id", "loop", "nu", "nv", places["v"], ((F.col("position") + 1) % F.col("size")).alias("_p")).join(nxt, ["mesh_id", "loop", "_p"])

    def moved(a, b, n):
        d = F.pmod(b - a, n)
        return F.when(d == n - 1, -1).otherwise(d)

    du = moved(F.col("v") % F.col("nu"), F.col("w") % F.col("nu"), F.col("nu"))
    dv = moved(F.floor(F.col("v") / F.col("nu")), F.floor(F.col("w") / F.col("nu")), F.col("nv"))
    turns = step.groupBy("mesh_id", "loop", "nu", "nv").agg((F.sum(du) / F.col("nu")).cast("int").alias("tu"), (F.sum(dv) / F.col("nv")).cast("int").alias("tv"))
    first = F.expr("max(CASE WHEN loop = 0 THEN struct(tu, tv) END)")
    second = F.expr("max(CASE WHEN loop = 1 THEN struct(tu, tv) END)")
    det = turns.groupBy("mesh_id").agg(first.alias("p"), second.alias("q")).select("mesh_id", F.abs(F.col("p.tu") * F.col("q.tv") - F.col("p.tv") * F.col("q.tu")).alias("turns"))
    short = loops.groupBy("mesh_id").agg(F.count("*").alias("loops"), F.round(F.min("length"), 6).alias("shortest"), F.min_by("size", "loop").alias("shortest_size"))
    return short.join(det, "mesh_id").select("mesh_id", "loops", "shortest", "shortest_size", "turns")
