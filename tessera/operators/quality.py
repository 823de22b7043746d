"""Quality rows of scans: sizes, topology of the largest component, defects, what cleaning leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry, topology
from .fixpoint import cut


def scan_rows(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per mesh that has a vertex or a face.

    mesh_id, vertices, faces, components, and of the component with most vertices (the first, if
    several) largest_vertices, largest_chi, largest_loops, largest_genus and largest_manifold;
    nonmanifold_edges, nonmanifold_vertices, misoriented_edges, boundary_edges, invalid_faces,
    duplicate_faces, isolated_vertices; halfedge_ok: whether the faces left after cleaning make
    half-edges; zero_area_faces among those, null if they don't. Counts of what a mesh lacks are 0,
    and what describes a component is null for a mesh without one.
    """
    ok = cut(topology.valid_faces(faces, vertices))
    twice = cut(topology.duplicate_faces(ok))
    good = cut(ok.join(twice, ["mesh_id", "f"], "left_anti"))
    parts = cut(topology.component_report(vertices, faces))
    first = Window.partitionBy("mesh_id").orderBy(F.desc("n_vertices"), "component")
    largest = parts.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("mesh_id", *(F.col(a).alias(f"largest_{b}") for a, b in (("n_vertices", "vertices"), ("chi", "chi"), ("loops", "loops"), ("genus", "genus"), ("manifold", "manifold"))))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("mesh_id").agg(F.count("*").alias(name))

    kinds = topology.edges(good).groupBy("mesh_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_edges") for k in ("nonmanifold", "misoriented", "boundary")))
    left, _ = topology.manifold_part(vertices, faces)
    bad = topology.edges(left).where("kind IN ('nonmanifold', 'misoriented')").select("mesh_id").union(topology.nonmanifold_vertices(left).select("mesh_id")).distinct().withColumn("halfedge_ok", F.lit(False))
    flat = counted(geometry.face_frames(left, vertices).where("area = 0"), "zero_area_faces")
    out = vertices.select("mesh_id").union(faces.select("mesh_id")).distinct()
    numbers = ["vertices", "faces", "components", "nonmanifold_edges", "misoriented_edges", "boundary_edges", "nonmanifold_vertices", "invalid_faces", "duplicate_faces", "isolated_vertices", "zero_area_faces"]
    for part in (
        counted(vertices, "vertices"), counted(faces, "faces"), counted(parts, "components"), largest, kinds,
        counted(topology.nonmanifold_vertices(good), "nonmanifold_vertices"), counted(faces.join(ok, ["mesh_id", "f"], "left_anti"), "invalid_faces"),
        counted(twice, "duplicate_faces"), counted(topology.isolated_vertices(vertices, good), "isolated_vertices"), bad, flat,
    ):
        out = out.join(part, "mesh_id", "left")
    out = out.fillna(0, numbers).withColumn("halfedge_ok", F.coalesce("halfedge_ok", F.lit(True)))
    return out.withColumn("zero_area_faces", F.when(F.col("halfedge_ok"), F.col("zero_area_faces")))


def defects(rows: DataFrame) -> DataFrame:
    """Adds ``status``: clean, or defects where any count of them isn't 0 or half-edges can't be made."""
    any_ = sum((F.col(c) for c in ("nonmanifold_edges", "nonmanifold_vertices", "misoriented_edges", "invalid_faces", "duplicate_faces", "isolated_vertices")), F.coalesce("zero_area_faces", F.lit(0)))
    return rows.withColumn("status", F.when((any_ > 0) | ~F.col("halfedge_ok"), "defects").otherwise("clean"))
