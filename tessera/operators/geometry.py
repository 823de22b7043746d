"""Areas, normals, curvature and discrete exterior calculus as projections and aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vec import add, angle, cot, cross, dot, named, norm, scale, sub, vec

from .fixpoint import BROADCAST_ROWS, counted
from .model import face_positions
from .topology import edges


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in columns.items()))


def face_frames(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with positions, the cross product n (twice the area long), area and centroid."""
    f = face_positions(faces, vertices)
    a, b, c = vec("a"), vec("b"), vec("c")
    n = cross(sub(b, a), sub(c, a))
    f = f.select("*", *named(n, "n"))
    third = F.lit(1.0) / F.lit(3.0)
    return f.withColumns({"area": F.lit(0.5) * norm(vec("n")), **{"g" + k: (F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) * third for k in "xyz"}})


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sums of the cross products of incident faces: mesh_id, v, nx, ny, nz."""
    f = face_frames(faces, vertices).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v"), "nx", "ny", "nz")
    return f.groupBy("mesh_id", "v").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz")))


def signed_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    f = face_positions(faces, vertices)
    return f.groupBy("mesh_id").agg((F.sum(dot(vec("a"), cross(vec("b"), vec("c")))) / 6).alias("volume"))


def bounding_box(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct().join(vertices, ["mesh_id", "v"])
    return used.groupBy("mesh_id").agg(*(g(c).alias(n + c) for c in "xyz" for n, g in (("lo_", F.min), ("hi_", F.max))))


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per face corner: v, angle, cotangent of the angle (null if flat), edge vectors and area."""
    f = face_frames(faces, vertices)
    p = {0: vec("a"), 1: vec("b"), 2: vec("c")}

    def corner(k: int) -> Column:
        o, d, e = p[k], p[(k + 1) % 3], p[(k + 2) % 3]
        u, w = sub(d, o), sub(e, o)
        return _struct(k=F.lit(k), v=F.col(f"v{k}"), d=F.col(f"v{(k + 1) % 3}"), e=F.col(f"v{(k + 2) % 3}"), angle=angle(u, w), cot=cot(u, w), ux=u[0], uy=u[1], uz=u[2], wx=w[0], wy=w[1], wz=w[2])

    return f.select("mesh_id", "f", "area", "nx", "ny", "nz", F.explode(F.array(*map(corner, range(3)))).alias("c")).select("mesh_id", "f", "area", "nx", "ny", "nz", "c.*")


def curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, v, area (mixed), defect, mean, gauss, k1, k2, boundary; one scatter per corner.

    On boundaries and where the area is zero mean, gauss, k1 and k2 are null. Vertices without
    faces have defect 0 and area 0.
    """
    f = face_frames(faces, vertices)
    p = {0: vec("a"), 1: vec("b"), 2: vec("c")}
    cots = {k: cot(sub(p[(k + 1) % 3], p[k]), sub(p[(k + 2) % 3], p[k])) for k in range(3)}
    angs = {k: angle(sub(p[(k + 1) % 3], p[k]), sub(p[(k + 2) % 3], p[k])) for k in range(3)}
    f = f.withColumns({f"cot{k}": cots[k] for k in range(3)} | {f"ang{k}": angs[k] for k in range(3)})
    obtuse = F.greatest("ang0", "ang1", "ang2") > math.pi / 2

    def corner(k: int) -> Column:
        i, j = (k + 1) % 3, (k + 2) % 3
        u, w = sub(p[i], p[k]), sub(p[j], p[k])
        # edge to i lies opposite corner j, edge to j opposite corner i
        pull = add(scale(u, -F.col(f"cot{j}")), scale(w, -F.col(f"cot{i}")))
        voronoi = (dot(u, u) * F.col(f"cot{j}") + dot(w, w) * F.col(f"cot{i}")) / 8
        mixed = F.when(obtuse, F.when(F.col(f"ang{k}") > math.pi / 2, F.col("area") / 2).otherwise(F.col("area") / 4)).otherwise(voronoi)
        flat = F.col("area") == 0
        return _struct(v=F.col(f"v{k}"), ang=F.col(f"ang{k}"), mixed=F.when(flat, 0.0).otherwise(mixed), kx=F.when(~flat, pull[0]), ky=F.when(~flat, pull[1]), kz=F.when(~flat, pull[2]))

    s = f.select("mesh_id", "nx", "ny", "nz", F.explode(F.array(*map(corner, range(3)))).alias("c")).select("mesh_id", "nx", "ny", "nz", "c.*")
    s = s.groupBy("mesh_id", "v").agg(F.sum("ang").alias("turn"), F.sum("mixed").alias("area"), *(F.sum(x).alias(x) for x in ("kx", "ky", "kz", "nx", "ny", "nz")))
    e = edges(faces).where("kind = 'boundary'")
    rim = e.select("mesh_id", F.col("u").alias("v")).union(e.select("mesh_id", "v")).distinct().withColumn("boundary", F.lit(True))
    t = vertices.select("mesh_id", "v").join(s, ["mesh_id", "v"], "left").join(rim, ["mesh_id", "v"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))
    alone = F.col("turn").isNull()
    defect = F.when(alone, 0.0).otherwise(F.when(F.col("boundary"), math.pi).otherwise(2 * math.pi) - F.col("turn"))
    t = t.withColumns({"defect": defect, "area": F.coalesce("area", F.lit(0.0))})
    inner = ~F.col("boundary") & (F.col("area") > 0)
    length = norm(vec("n"))
    # the cotangent normal is -sum(cot (q - p)) / (2 A); mean curvature is half its part along n
    along = F.when(length > 0, dot(vec("k"), vec("n")) / length).otherwise(0.0)
    mean = F.when(inner, along / (F.col("area") * 4))
    gauss = F.when(inner, F.try_divide(F.col("defect"), F.col("area")))
    root = F.sqrt(F.greatest(F.col("mean") * F.col("mean") - F.col("gauss"), F.lit(0.0)))
    t = t.withColumns({"mean": mean, "gauss": gauss})
    return t.select("mesh_id", "v", "area", "defect", "mean", "gauss", (F.col("mean") + root).alias("k1"), (F.col("mean") - root).alias("k2"), "boundary")


def star0(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lumped vertex areas, a third of each incident face: mesh_id, v, area."""
    f = face_frames(faces, vertices).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v"), (F.col("area") / 3).alias("a"))
    return f.groupBy("mesh_id", "v").agg(F.sum("a").alias("area"))


def star1(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Cotangent edge weights, half the sum of the opposite cotangents: mesh_id, u, v, w."""
    c = corners(faces, vertices)
    return c.select("mesh_id", F.least("d", "e").alias("u"), F.greatest("d", "e").alias("v"), (F.col("cot") / 2).alias("w")).groupBy("mesh_id", "u", "v").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """L = -d0' star1 d0 as triplets: off the diagonal w, on it -sum(w): mesh_id, i, j, a.

    The weights are written once; the parts of L read them, and not each the faces anew.
    """
    w, n = counted(star1(vertices, faces))
    both = w.select("mesh_id", F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("a")).union(w.select("mesh_id", F.col("v").alias("i"), F.col("u").alias("j"), F.col("w").alias("a")))
    out = both.union(both.groupBy("mesh_id", "i").agg((-F.sum("a")).alias("a")).select("mesh_id", "i", F.col("i").alias("j"), "a"))
    return out.hint("merge") if n > BROADCAST_ROWS else out


def edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, u, v, len of each undirected edge."""
    e = edges(faces)
    for key, p in (("u", "p"), ("v", "q")):
        e = e.join(vertices.select("mesh_id", F.col("v").alias(key), *(F.col(c).alias(p + c) for c in "xyz")), ["mesh_id", key])
    return e.select("mesh_id", "u", "v", "kind", "h_min", norm(sub(vec("p"), vec("q"))).alias("len"))


def face_gradient(vertices: DataFrame, faces: DataFrame, field: DataFrame) -> DataFrame:
    """Gradient of a vertex field (mesh_id, v, u) on each face: mesh_id, f, x, y, z; zero if flat."""
    f = face_frames(faces, vertices)
    for k in range(3):
        f = f.join(field.select("mesh_id", F.col("v").alias(f"v{k}"), F.col("u").alias(f"u{k}")), ["mesh_id", f"v{k}"])
    p = [vec("a"), vec("b"), vec("c")]
    n, size = vec("n"), norm(vec("n"))
    total = None
    for k in range(3):
        t = scale(cross(n, sub(p[(k + 2) % 3], p[(k + 1) % 3])), F.col(f"u{k}"))
        total = t if total is None else add(total, t)
    # n has twice the area as length, so N x e / 2A = n x e / |n|^2
    return f.select("mesh_id", "f", *(F.when(size > 0, t / (size * size)).otherwise(0.0).alias(c) for c, t in zip("xyz", total, strict=True)))


def divergence(vertices: DataFrame, faces: DataFrame, field: DataFrame) -> DataFrame:
    """Integrated divergence at vertices of a face field (mesh_id, f, x, y, z): mesh_id, v, div."""
    c = corners(faces, vertices).join(field, ["mesh_id", "f"])
    x = vec("")
    # cot at a corner weighs the opposite edge d -> e, which leaves d and enters e
    flow = (F.col("cot") / 2) * dot((F.col("wx") - F.col("ux"), F.col("wy") - F.col("uy"), F.col("wz") - F.col("uz")), x)
    part = F.explode(F.array(_struct(v=F.col("d"), g=flow), _struct(v=F.col("e"), g=-flow)))
    return c.select("mesh_id", part.alias("p")).groupBy("mesh_id", F.col("p.v").alias("v")).agg(F.sum("p.g").alias("div"))


# Sparse matrices as triplets (i, j, a)


def assemble(triplets: DataFrame) -> DataFrame:
    return triplets.groupBy("i", "j").agg(F.sum("a").alias("a"))


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """i, y for a matrix (i, j, a) and a vector (j, x)."""
    return matrix.join(x, "j").groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("y"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")


def weighted_gram(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """D' W D for rows weighted by (i, w): joined on the row, summed by column pair."""
    a = matrix.join(weights, "i")
    b = matrix.select("i", F.col("j").alias("k"), F.col("a").alias("b"))
    return a.join(b, "i").groupBy(F.col("j").alias("i"), F.col("k").alias("j")).agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("a"))


def scaled_plus_diagonal(matrix: DataFrame, s: float, diagonal: DataFrame) -> DataFrame:
    """s A + diag(d) for d as (i, d)."""
    return assemble(matrix.select("i", "j", (F.col("a") * s).alias("a")).union(diagonal.select("i", F.col("i").alias("j"), F.col("d").alias("a"))))
