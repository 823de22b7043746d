"""Linear systems of all meshes at once: conjugate gradients over triplets, and the diffusion they serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import cut
from .geometry import laplacian, star0


def conjugate_gradient(matrix: DataFrame, rhs: DataFrame, by: list[str], tolerance: float = 1e-10, max_rounds: int = 10_000) -> DataFrame:
    """by..., i, x with A x = b for symmetric positive definite A, one system for each value of ``by``.

    ``matrix``: by, i, j, a (triplets, summed where they repeat); ``rhs``: by, i, b (unknowns without a
    row have b = 0). All systems take their steps together, each with scalars of its own, which are
    two aggregations a round; a system leaves the loop once its residual is ``tolerance`` times its
    right side. Jacobi's preconditioner. Rounds are checkpointed, so a lost executor costs one.

    An unknown without a diagonal entry above 0, a right side for an unknown that the matrix doesn't
    have, and systems that don't settle (not positive definite, or not finite) are errors. A system
    with b = 0 has x = 0.
    """
    a = cut(matrix.groupBy(*by, "i", "j").agg(F.sum("a").alias("a")))
    diagonal = a.where("i = j").select(*by, "i", F.col("a").alias("diag"))
    unknowns = a.select(*by, "i").distinct()
    b = rhs.groupBy(*by, "i").agg(F.sum("b").alias("b"))
    state = cut(unknowns.join(diagonal, [*by, "i"], "left").join(b, [*by, "i"], "left").fillna(0.0, ["b"]))
    if not state.where("diag IS NULL OR NOT diag > 0").isEmpty():
        raise ValueError("the diagonal must be positive")
    if not b.join(unknowns, [*by, "i"], "left_anti").isEmpty():
        raise ValueError("a right side belongs to no row of the matrix")
    norms = state.groupBy(*by).agg(F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("b") * F.col("b") / F.col("diag")).alias("rz"))
    zero = state.join(norms.where("bb = 0"), by, "left_semi").select(*by, "i", F.lit(0.0).alias("x"))
    # r: residual, p: direction, rz: r . r / diag of the system
    step = F.col("b") / F.col("diag")
    open_ = cut(state.join(norms.where("NOT bb = 0"), by).select(*by, "i", "diag", F.lit(0.0).alias("x"), F.col("b").alias("r"), step.alias("p"), "rz", "bb"))
    solved = [zero]
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        ap = a.join(open_.select(*by, F.col("i").alias("j"), "p"), [*by, "j"]).groupBy(*by, "i").agg(F.sum(F.col("a") * F.col("p")).alias("q"))
        s = cut(open_.join(ap, [*by, "i"]))
        along = s.groupBy(*by).agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
        if not along.where("pq IS NULL OR NOT pq > 0").isEmpty():
            raise ValueError("a matrix isn't positive definite")
        alpha = F.col("rz") / F.col("pq")
        s = cut(s.join(along, by).withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("q")}).drop("q", "pq"))
        left = s.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("rz2"))
        s = s.join(left, by)
        small = F.col("rr") <= tolerance * tolerance * F.col("bb")
        s = cut(s)
        solved.append(s.where(small).select(*by, "i", "x"))
        open_ = s.where(~small).withColumn("p", F.col("r") / F.col("diag") + F.col("rz2") / F.col("rz") * F.col("p")).withColumn("rz", F.col("rz2")).drop("rr", "rz2")
        open_ = cut(open_)
    else:
        raise RuntimeError("systems did not settle")
    out = solved[0]
    for part in solved[1:]:
        out = out.union(part)
    return out


def diffuse(vertices: DataFrame, faces: DataFrame, field: DataFrame, sigma: float, tolerance: float = 1e-10) -> DataFrame:
    """mesh_id, v, u: the field (mesh_id, v, u) after one implicit step of heat flow of time t = sigma squared / 2.

    Solves (M - t L) u = M u0 with lumped areas M and the cotangent Laplacian L of each mesh. A vertex
    without area keeps its value, one without value has 0.
    """
    matrix, mass = _heat(vertices, faces, sigma)
    known = mass.join(field.select("mesh_id", "v", "u"), ["mesh_id", "v"], "left").fillna(0.0, ["u"])
    solved = conjugate_gradient(matrix.drop("stiff"), known.select("mesh_id", F.col("v").alias("i"), (F.col("area") * F.col("u")).alias("b")), ["mesh_id"], tolerance)
    alone = _alone(vertices, mass).join(field.select("mesh_id", "v", "u"), ["mesh_id", "v"], "left").fillna(0.0, ["u"])
    return solved.select("mesh_id", F.col("i").alias("v"), F.col("x").alias("u")).union(alone.select("mesh_id", "v", "u"))


def _heat(vertices: DataFrame, faces: DataFrame, sigma: float) -> tuple[DataFrame, DataFrame]:
    """(matrix, mass): triplets of M - t L, those of -t L marked ``stiff``, and the vertices' areas above 0."""
    mass = cut(star0(vertices, faces).where("area > 0"))
    stiff = laplacian(vertices, faces).select("mesh_id", "i", "j", (F.col("a") * (-sigma * sigma / 2)).alias("a"), F.lit(True).alias("stiff"))
    for end in "ij":  # rows and columns of vertices without area are left out
        stiff = stiff.join(mass.select("mesh_id", F.col("v").alias(end)), ["mesh_id", end], "left_semi")
    diagonal = mass.select("mesh_id", F.col("v").alias("i"), F.col("v").alias("j"), F.col("area").alias("a"), F.lit(False).alias("stiff"))
    return cut(stiff.select(*diagonal.columns).union(diagonal)), mass


def _alone(vertices: DataFrame, mass: DataFrame) -> DataFrame:
    return vertices.select("mesh_id", "v").join(mass.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti")


def prominence(vertices: DataFrame, faces: DataFrame, field: DataFrame, sigma: float, tolerance: float = 1e-10) -> DataFrame:
    """mesh_id, v, u: how far the field stands out from its own diffusion; 0 at vertices without faces.

    Solves (M - t L) p = -t L f, whose right side is as small as its solution.
    """
    matrix, mass = _heat(vertices, faces, sigma)
    given = field.select("mesh_id", F.col("v").alias("j"), "u")
    pull = matrix.where("stiff").join(given, ["mesh_id", "j"]).select("mesh_id", "i", (F.col("a") * F.col("u")).alias("b"))
    solved = conjugate_gradient(matrix.drop("stiff"), pull.join(mass.select("mesh_id", F.col("v").alias("i")), ["mesh_id", "i"], "left_semi"), ["mesh_id"], tolerance)
    return solved.select("mesh_id", F.col("i").alias("v"), F.col("x").alias("u")).union(_alone(vertices, mass).select("mesh_id", "v", F.lit(0.0).alias("u")))
