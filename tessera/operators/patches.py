"""Reachable sets without distances, and the patches and holes cut along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import cut
from .topology import edges, valid_faces


def reachable(links: DataFrame, seeds: DataFrame, by: list[str], node: str = "v", max_rounds: int = 100_000) -> DataFrame:
    """by..., v, hops of every node that a seed of its group reaches: the least number of links to any seed.

    ``links``: by, u, v (undirected, repeats and loops allowed). ``seeds``: by, v and optionally
    ``reach``, a bound on the hops from it (null: none); where seeds of several bounds meet, a node is
    reached if any of them gets there. A seed without links reaches itself; null seeds and ends reach
    nothing. All groups advance together, a round for each hop; a round reads the frontier and the
    nodes found so far by its group only as far as the frontier's neighbours.
    """
    both = links.select(*by, F.col("u").alias("_a"), F.col("v").alias("_b")).union(links.select(*by, F.col("v").alias("_a"), F.col("u").alias("_b")))
    both = cut(both.where("_a <> _b").distinct())
    bound = F.col("reach").cast("int") if "reach" in seeds.columns else F.lit(None).cast("int")
    # what is left of a seed's bound travels with the frontier: a node is taken again if it comes with more
    start = seeds.where(F.col(node).isNotNull()).select(*by, F.col(node).alias("_v"), F.coalesce(bound, F.lit(2**31 - 1)).alias("_left")).where("_left >= 0")
    frontier = cut(start.groupBy(*by, "_v").agg(F.max("_left").alias("_left")).withColumn("hops", F.lit(0)))
    seen = frontier
    for k in range(1, max_rounds + 1):
        step = both.join(frontier.where("_left > 0").select(*by, F.col("_v").alias("_a"), "_left"), [*by, "_a"]).groupBy(*by, F.col("_b").alias("_v")).agg((F.max("_left") - 1).alias("_left"))
        known = seen.join(step.select(*by, "_v"), [*by, "_v"], "left_semi").groupBy(*by, "_v").agg(F.max("_left").alias("_had"))
        new = step.join(known, [*by, "_v"], "left").where("_had IS NULL OR _left > _had")
        frontier = cut(new.select(*by, "_v", "_left", F.lit(k).alias("hops")))
        if frontier.isEmpty():
            return seen.groupBy(*by, F.col("_v").alias(node)).agg(F.min("hops").alias("hops"))
        seen = seen.union(frontier) if k % 16 else cut(seen.union(frontier))
    raise RuntimeError("the reachable set did not settle")


def patch_faces(faces: DataFrame, reached: DataFrame) -> DataFrame:
    """mesh_id, f of faces whose three corners are all among ``reached`` (mesh_id, v)."""
    corner = faces.select("mesh_id", "f", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    inside = corner.join(reached.select("mesh_id", "v").distinct(), ["mesh_id", "v"], "left_semi")
    return inside.groupBy("mesh_id", "f").agg(F.count("*").alias("_n")).where("_n = 3").select("mesh_id", "f")


def punch(faces: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces left, faces of the patches): patches are the faces within ``reach`` hops of a seed (mesh_id, v, reach).

    Faces with repeated corners are neither in a patch nor a link of the surface; they stay.
    """
    good = valid_faces(faces)
    gone = cut(patch_faces(good, reachable(edges(good), seeds, ["mesh_id"])))
    return faces.join(gone, ["mesh_id", "f"], "left_anti"), faces.join(gone, ["mesh_id", "f"], "left_semi")


def punch_balls(faces: DataFrame, vertices: DataFrame, balls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces left, faces of the patches) for balls (mesh_id, x, y, z, radius): faces with all corners inside one of them.

    A mesh's balls are held against all of its vertices: they are few by their purpose, one or some a mesh.
    """
    b = balls.select("mesh_id", *(F.col(c).alias("b" + c) for c in "xyz"), "radius").withColumn("_ball", F.monotonically_increasing_id())
    d = sum(((F.col(c) - F.col("b" + c)) * (F.col(c) - F.col("b" + c)) for c in "xyz"), F.lit(0.0))
    inside = cut(vertices.join(b, "mesh_id").where(d < F.col("radius") * F.col("radius")).select("mesh_id", "v", "_ball"))
    corner = valid_faces(faces).select("mesh_id", "f", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    gone = cut(corner.join(inside, ["mesh_id", "v"]).groupBy("mesh_id", "f", "_ball").agg(F.count("*").alias("_n")).where("_n = 3").select("mesh_id", "f").distinct())
    return faces.join(gone, ["mesh_id", "f"], "left_anti"), faces.join(gone, ["mesh_id", "f"], "left_semi")
