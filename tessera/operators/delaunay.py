"""Intrinsic Delaunay triangulations of all meshes at once, by rounds of flips that share no face.

A triangulation is a table of faces with ids and side lengths (mesh_id, f, v0, v1, v2, l0, l1, l2; side k runs
from corner k to the next): positions play no part any more. Meshes must be clean: an edge has
one face or two that agree in direction (topology.manifold_part).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vec import kahan_heron, norm, sub, vec

from .fixpoint import cut
from .model import face_positions

#: Sums of cotangents down to this one below 0 count as Delaunay.
TOLERANCE = 1e-12
_FACE = ["mesh_id", "f", "v0", "v1", "v2", "l0", "l1", "l2"]


def intrinsic(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The triangulation of a mesh in space; faces that name an absent vertex are left out."""
    p = [vec(c) for c in "abc"]
    return face_positions(faces, vertices).select("mesh_id", "f", "v0", "v1", "v2", *(norm(sub(p[(k + 1) % 3], p[k])).alias(f"l{k}") for k in range(3)))


def _area() -> Column:
    return kahan_heron(F.col("l0"), F.col("l1"), F.col("l2"))


def _sides(tri: DataFrame) -> DataFrame:
    """Per side: mesh_id, f, a, b (its ends), p (opposite), its length l, l_bp, l_pa, cot and angle opposite; in flat faces the cotangent is 0."""
    def side(k: int) -> Column:
        j, i = (k + 1) % 3, (k + 2) % 3
        num = F.col(f"l{j}") ** 2 + F.col(f"l{i}") ** 2 - F.col(f"l{k}") ** 2
        four = 4 * F.col("area")
        return F.struct(
            F.col(f"v{k}").alias("a"), F.col(f"v{j}").alias("b"), F.col(f"v{i}").alias("p"), F.col(f"l{k}").alias("l"), F.col(f"l{j}").alias("l_bp"),
            F.col(f"l{i}").alias("l_pa"), F.when(four > 0, F.try_divide(num, four)).otherwise(0.0).alias("cot"), F.atan2(four, num).alias("angle"),
        )

    return tri.withColumn("area", _area()).select("mesh_id", "f", F.explode(F.array(*map(side, range(3)))).alias("s")).select("mesh_id", "f", "s.*")


def _edges(tri: DataFrame) -> DataFrame:
    """mesh_id, u < v, s (the side from u to v), t (the side back); one of them is null on a boundary."""
    side = F.struct("f", "p", "l", "l_bp", "l_pa", "cot")
    by = ["mesh_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    return _sides(tri).groupBy(*by).agg(F.min(F.when(F.col("a") < F.col("b"), side)).alias("s"), F.min(F.when(F.col("a") > F.col("b"), side)).alias("t"))


def quality(tri: DataFrame) -> DataFrame:
    """mesh_id, n_faces, area, least sum of cotangents (null without inner edges) and how many are below tolerance."""
    total = F.col("s.cot") + F.col("t.cot")
    e = _edges(tri).groupBy("mesh_id").agg(F.min(total).alias("worst"), F.count_if(total < -TOLERANCE).alias("bad"))
    return tri.groupBy("mesh_id").agg(F.count("*").alias("n_faces"), F.sum(_area()).alias("area")).join(e, "mesh_id")


def angle_sums(tri: DataFrame) -> DataFrame:
    """mesh_id, v, angle: the face angles at each vertex added up."""
    return _sides(tri).groupBy("mesh_id", F.col("p").alias("v")).agg(F.sum("angle").alias("angle"))


def to_delaunay(tri: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(triangulation, report: mesh_id, flips, skipped) once no edge that may be flipped has a negative sum of cotangents.

    A round flips the edges that are worst in both their faces and the worst of those that would make the
    same edge, so flips of a round don't touch and the worst edge of a mesh is always among them. An edge
    isn't flipped where its opposite corners are one vertex or have an edge already; those left so are
    ``skipped``. A mesh leaves the rounds when nothing of it is flipped. Ties go to lesser ids. Per round a
    shuffle of sides by edge and small ones of the candidates. The result doesn't depend on partitioning.
    """
    now = cut(tri.select(*_FACE))
    done, flips, skipped = [], [], []
    for _ in range(max_rounds):
        e = cut(_edges(now))
        total = F.col("s.cot") + F.col("t.cot")
        bad = cut(e.where(total < -TOLERANCE).select("mesh_id", "u", "v", "s", "t", total.alias("c"), F.least("s.p", "t.p").alias("nu"), F.greatest("s.p", "t.p").alias("nv")))
        may = bad.where("nu <> nv").join(e.select("mesh_id", F.col("u").alias("nu"), F.col("v").alias("nv")), ["mesh_id", "nu", "nv"], "left_anti")
        zero = F.lit(-1).cast("bigint")
        claim = F.explode(F.array(F.struct(F.col("s.f").alias("x"), zero.alias("y")), F.struct(F.col("t.f").alias("x"), zero.alias("y")), F.struct(F.col("nu").alias("x"), F.col("nv").alias("y"))))
        claims = may.select("mesh_id", claim.alias("k"), F.struct("c", "u", "v").alias("r")).groupBy("mesh_id", "k").agg(F.min("r").alias("r"))
        wins = claims.groupBy("mesh_id", F.col("r.u").alias("u"), F.col("r.v").alias("v")).count().where("count = 3").drop("count")
        chosen = cut(bad.join(wins, ["mesh_id", "u", "v"]))
        active = chosen.select("mesh_id").distinct()
        done.append(now.join(active, "mesh_id", "left_anti"))
        skipped.append(bad.join(active, "mesh_id", "left_anti").groupBy("mesh_id").agg(F.count("*").alias("n")))
        if chosen.isEmpty():
            break
        flips.append(chosen.groupBy("mesh_id").agg(F.count("*").alias("n")))
        gone = chosen.select("mesh_id", F.explode(F.array("s.f", "t.f")).alias("f"))
        kept = now.join(active, "mesh_id", "left_semi").join(gone, ["mesh_id", "f"], "left_anti")
        now = cut(kept.unionByName(_flipped(chosen)))
    else:
        raise RuntimeError("flips did not settle")

    def added(parts: list[DataFrame], name: str) -> DataFrame:
        empty = tri.select("mesh_id", F.lit(0).cast("bigint").alias("n")).limit(0)
        return reduce(DataFrame.union, parts, empty).groupBy("mesh_id").agg(F.sum("n").alias(name))

    report = tri.select("mesh_id").distinct().join(added(flips, "flips"), "mesh_id", "left").join(added(skipped, "skipped"), "mesh_id", "left")
    return reduce(DataFrame.unionByName, done), report.fillna(0, ["flips", "skipped"])


def _flipped(chosen: DataFrame) -> DataFrame:
    """The two faces of each flipped edge: (p, u, q) and (q, v, p), p and q being opposite to it."""
    l, up, vp, uq, vq = (F.col(c) for c in ("s.l", "s.l_pa", "s.l_bp", "t.l_bp", "t.l_pa"))
    # both faces laid out in the plane, u at the origin and v on the axis
    px, qx = (F.try_divide(l**2 + a**2 - b**2, 2 * l) for a, b in ((up, vp), (uq, vq)))
    py, qy = (F.sqrt(F.greatest(a**2 - x**2, F.lit(0.0))) for a, x in ((up, px), (uq, qx)))
    new = F.hypot(px - qx, py + qy)

    def face(f: str, corners: tuple, sides: tuple) -> Column:
        return F.struct(F.col(f).alias("f"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(corners)), *(s.alias(f"l{k}") for k, s in enumerate(sides)))

    two = F.array(face("s.f", ("s.p", "u", "t.p"), (up, uq, new)), face("t.f", ("t.p", "v", "s.p"), (vq, vp, new)))
    return chosen.select("mesh_id", F.explode(two).alias("t")).select("mesh_id", "t.*")
