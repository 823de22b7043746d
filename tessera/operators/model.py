"""Tables of a mesh corpus and the runner for per-mesh kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.meshes import Mesh

VERTICES = "mesh_id string, v bigint, x double, y double, z double"
FACES = "mesh_id string, f bigint, v0 bigint, v1 bigint, v2 bigint"
#: Corners of the largest mesh that one task takes as a whole; larger ones give an error row.
MAX_CORNERS = 15_000_000


def tables(spark: SparkSession, meshes: dict[str, Mesh]) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of meshes in memory, for fixtures and presets."""
    v = [pd.DataFrame({"mesh_id": k, "v": np.arange(len(m.x)), "x": m.x[:, 0], "y": m.x[:, 1], "z": m.x[:, 2]}) for k, m in meshes.items()]
    f = [pd.DataFrame({"mesh_id": k, "f": np.arange(len(m.f)), "v0": m.f[:, 0], "v1": m.f[:, 1], "v2": m.f[:, 2]}) for k, m in meshes.items()]
    return spark.createDataFrame(pd.concat(v), VERTICES), spark.createDataFrame(pd.concat(f), FACES)


def halfedges(faces: DataFrame) -> DataFrame:
    """mesh_id, h = 3f+k, f, k, origin, dest, apex."""
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("origin"), F.col(f"v{(k + 1) % 3}").alias("dest"), F.col(f"v{(k + 2) % 3}").alias("apex")) for k in range(3))))
    return faces.select("mesh_id", "f", corner.alias("c")).select("mesh_id", (F.col("f") * 3 + F.col("c.k")).alias("h"), "f", "c.k", "c.origin", "c.dest", "c.apex")


def with_positions(he: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds the corner positions o, d, a (x, y, z each) of every half-edge."""
    out = he
    for key, p in (("origin", "o"), ("dest", "d"), ("apex", "a")):
        out = out.join(vertices.select("mesh_id", F.col("v").alias(key), *(F.col(c).alias(p + c) for c in "xyz")), ["mesh_id", key])
    return out


def face_positions(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the positions a, b, c (x, y, z each) of their corners: three lookups, no scatter."""
    out = faces
    for key, p in (("v0", "a"), ("v1", "b"), ("v2", "c")):
        out = out.join(vertices.select("mesh_id", F.col("v").alias(key), *(F.col(c).alias(p + c) for c in "xyz")), ["mesh_id", key])
    return out


def packed(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per mesh: sorted arrays of its vertices and faces."""
    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("v", "x", "y", "z"))).alias("vs"))
    f = faces.groupBy(F.col("mesh_id").alias("m")).agg(F.array_sort(F.collect_list(F.struct("f", "v0", "v1", "v2"))).alias("fs"))
    return v.join(f, F.col("mesh_id") == F.col("m"), "left").drop("m")


def per_mesh(vertices: DataFrame, faces: DataFrame, kernel: Callable[[str, Mesh], pd.DataFrame], schema: str) -> DataFrame:
    """Run a kernel on each mesh; ``schema`` is that of its rows.

    Vertices and faces meet in one task per mesh by cogroup, keyed by mesh_id. A mesh above
    :data:`MAX_CORNERS` corners raises instead of taking the worker's memory with it.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if 3 * len(f) > MAX_CORNERS:
            raise ValueError(f"mesh {f['mesh_id'].iloc[0]}: {len(f)} faces are too many for one task")
        name = (v if len(v) else f)["mesh_id"].iloc[0]
        v, f = v.sort_values("v"), f.sort_values("f")
        out = kernel(name, Mesh(v[["x", "y", "z"]].to_numpy(), f[["v0", "v1", "v2"]].to_numpy()))
        return out[columns]

    # aliases: tables that come from one table of parameters would share the key's attribute
    v, f = (t.select(*(F.col(c).alias(c) for c in t.columns)) for t in (vertices, faces))
    return v.groupBy("mesh_id").cogroup(f.groupBy("mesh_id")).applyInPandas(run, schema)
