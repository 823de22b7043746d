"""Corpora of generated meshes as ranges: one mesh per row of a parameter table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that one task generates, about.
CELLS_PER_TASK = 50_000


def _cells(nu: Column, i: Column, j: Column, wrap_u: bool, wrap_v: Column | None, width: Column) -> tuple[Column, Column, Column, Column]:
    """Vertex ids a, b, c, d of cell (i, j), counterclockwise."""
    i1 = (i + 1) % nu if wrap_u else i + 1
    j1 = (j + 1) % wrap_v if wrap_v is not None else j + 1
    return j * width + i, j * width + i1, j1 * width + i1, j1 * width + i


def _two(df: DataFrame, a: Column, b: Column, c: Column, d: Column, cell: Column) -> DataFrame:
    t = F.explode(F.array(F.struct(F.lit(0).alias("k"), a.alias("v0"), b.alias("v1"), c.alias("v2")), F.struct(F.lit(1).alias("k"), a.alias("v0"), c.alias("v1"), d.alias("v2"))))
    return df.select("mesh_id", cell.alias("cell"), t.alias("t")).select("mesh_id", (F.col("cell") * 2 + F.col("t.k")).alias("f"), "t.v0", "t.v1", "t.v2")


def _long(c: str) -> Column:
    return F.col(c).cast("bigint")


def _dealt(params: DataFrame, cells: Column) -> tuple[DataFrame, bool]:
    """``params`` over as many tasks as their meshes ask for, and whether that is more than one.

    A file of parameters is small, so Spark reads it in one task, and takes what is generated from it to be as small.
    """
    total = params.agg(F.sum(cells)).first()[0] or 0
    tasks = math.ceil(total / CELLS_PER_TASK)
    return (params.repartition(tasks, "mesh_id"), True) if tasks > 1 else (params, False)


def _marked(large: bool, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Tables that Spark may take to be small; joins must not broadcast large ones."""
    return tuple(t.hint("merge") for t in tables) if large else tables


def tori(params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) for mesh_id, nu, nv, big, small."""
    nu, nv = _long("nu"), _long("nv")
    params, large = _dealt(params, nu * nv)
    g = params.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), nu * nv - 1)).alias("id"))
    i, j = F.col("id") % nu, F.floor(F.col("id") / nu)
    u, v = i * (2 * math.pi) / nu, j * (2 * math.pi) / nv
    w = F.col("big") + F.col("small") * F.cos(v)
    vertices = g.select("mesh_id", F.col("id").alias("v"), (w * F.cos(u)).alias("x"), (w * F.sin(u)).alias("y"), (F.col("small") * F.sin(v)).alias("z"))
    return _marked(large, vertices, _two(g, *_cells(nu, i, j, True, nv, nu), F.col("id")))


def grids(params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) for mesh_id, nx, ny and optionally holes, an array of cell ids j nx + i to leave out."""
    nx, ny = _long("nx"), _long("ny")
    params, large = _dealt(params, (nx + 1) * (ny + 1))
    p = params.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), (nx + 1) * (ny + 1) - 1)).alias("id"))
    i, j = F.col("id") % (nx + 1), F.floor(F.col("id") / (nx + 1))
    vertices = p.select("mesh_id", F.col("id").alias("v"), (i / nx).alias("x"), (j / ny).alias("y"), F.lit(0.0).alias("z"))
    c = params.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), nx * ny - 1)).alias("id"))
    if "holes" in params.columns:
        c = c.where(~F.array_contains(F.coalesce("holes", F.array().cast("array<bigint>")), F.col("id")))
    i, j = F.col("id") % nx, F.floor(F.col("id") / nx)
    return _marked(large, vertices, _two(c, *_cells(nx, i, j, False, None, nx + 1), F.col("id")))


def damaged(params: DataFrame, vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tori of ``params`` with the defects that its flags ask for.

    lost: face 0 is missing; repeated: the last face comes twice; flipped: the lower face of cell
    (3, 2) is turned; flat: vertex (2, 3) lies on (1, 3); stray: a vertex without faces; wild: a face
    names a vertex that isn't there. They need at least 6 by 4 cells, and don't touch each other.
    """
    nu, size = _long("nu"), _long("nu") * _long("nv")
    flags = params.select("mesh_id", "lost", "repeated", "flipped", "flat", "stray", "wild", nu.alias("_nu"), size.alias("_n"))
    at = vertices.select("mesh_id", "v", F.struct("x", "y", "z").alias("_p"))
    twin = flags.where("flat").select("mesh_id", (3 * F.col("_nu") + 1).alias("v")).join(at, ["mesh_id", "v"]).select("mesh_id", (F.col("v") + 1).alias("v"), F.col("_p").alias("_q"))
    moved = at.join(twin, ["mesh_id", "v"], "left").withColumn("_p", F.coalesce("_q", "_p")).select("mesh_id", "v", "_p.*")
    stray = flags.where("stray").select("mesh_id", F.col("_n").alias("v"), *(F.lit(9.0).alias(c) for c in "xyz"))
    f = faces.join(flags, "mesh_id").where("NOT (lost AND f = 0)")
    turned = F.col("flipped") & (F.col("f") == 2 * (2 * F.col("_nu") + 3))
    kept = f.select("mesh_id", "f", "v0", F.when(turned, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(turned, F.col("v1")).otherwise(F.col("v2")).alias("v2"))
    again = f.where(F.col("repeated") & (F.col("f") == 2 * F.col("_n") - 1)).select("mesh_id", (F.col("f") + 1).alias("f"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    wild = flags.where("wild").select("mesh_id", (2 * F.col("_n") + 1).alias("f"), F.lit(0).cast("bigint").alias("v0"), F.lit(1).cast("bigint").alias("v1"), (F.col("_n") + 100).alias("v2"))
    return moved.union(stray), kept.union(again).union(wild)
