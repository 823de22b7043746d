"""Overlay values, annotations, quality rows and features."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.functions.picks import quantile_index
from tessera.operators import geometry, topology
from tessera.operators.fixpoint import components
from tessera.operators.kernels import margin, rays, surface, teeth
from tessera.operators.model import per_mesh, tables
from tessera.sources import meshes as M
from tessera.sources.mesh_io import LABELS, landmarks

from .q_geometry import FRAME_SQL
from .q_topology import mixed_corpus, torus_corpus
from .registry import query, table


@query("""WITH e AS (SELECT event_type AS g, event_id, value AS v FROM events WHERE value IS NOT NULL), r AS (SELECT g, abs(v) AS a, row_number() OVER (PARTITION BY g ORDER BY abs(v)) AS r, count(*) OVER (PARTITION BY g) AS n FROM e),
t AS (SELECT g, a AS reach FROM r WHERE r = least(n - 1, floor(0.98::DOUBLE * n)) + 1),
c AS (SELECT e.g, event_id, least(greatest(v / reach / 2 + 0.5, 0), 1) AS c FROM e JOIN t USING (g))
SELECT event_id, round(CASE WHEN c < 0.5 THEN 0.23 + 0.72 * (c * 2) ELSE 0.95 - 0.24 * (c * 2 - 1) END, 6) AS red FROM c""")
def diverging_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values coloured over their type's robust range."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), "event_id", "value").where("value IS NOT NULL")
    r, _, _ = color.diverging(F.col("value"), F.col("reach"))
    return e.join(color.robust_range(e, "value", ["g"]), "g").select("event_id", F.round(r, 6).alias("red"))


@query("WITH t AS (SELECT event_type AS g, max(value) AS top FROM events GROUP BY 1) SELECT g, floor(value * 20 / top)::BIGINT AS band, count(*) AS n FROM events JOIN t ON g = event_type WHERE value IS NOT NULL GROUP BY ALL")
def isoline_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), "value").where("value IS NOT NULL")
    top = e.groupBy("g").agg(F.max("value").alias("top"))
    return e.join(F.broadcast(top), "g").groupBy("g", color.isoline_band(F.col("value"), F.col("top")).alias("band")).agg(F.count("*").alias("n"))


def fdi_category(fdi: Column) -> Column:
    """Incisor, canine, premolar or molar by a tooth number's last digit; null for gum."""
    d = fdi % 10
    return F.when(fdi == 0, F.lit(None)).when(d <= 2, "incisor").when(d == 3, "canine").when(d <= 5, "premolar").otherwise("molar")


@query("SELECT 36 AS fdi, 2::BIGINT AS cusps, 'ok' AS status UNION ALL SELECT NULL, 0, 'length mismatch' UNION ALL SELECT NULL, 0, 'no labels'")
def annotated_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans joined to label and landmark files by stem; a scan without fitting labels says why."""
    scans = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4)], "mesh_id string, n int")
    files = spark.createDataFrame([("a", json.dumps({"jaw": "lower", "labels": [0, 36, 36, 36]})), ("b", json.dumps({"jaw": "lower", "labels": [0, 1]}))], "mesh_id string, value string")
    marks = json.dumps({"version": "1", "key": "a", "objects": [{"key": "1", "class": "Cusp", "coord": [0, 0, 1]}, {"key": "2", "class": "Cusp", "coord": [1, 0, 1]}, {"key": "3", "class": "Cusp", "coord": [1]}, {"key": "4", "class": "Mesial", "coord": [0, 0, 0]}]})
    points = landmarks(spark.createDataFrame([("a", marks)], "mesh_id string, value string"), "Cusp").groupBy("mesh_id").agg(F.count("*").alias("cusps"))
    j = scans.join(files.select("mesh_id", F.from_json("value", LABELS)["labels"].alias("labels")), "mesh_id", "left").join(points, "mesh_id", "left")
    status = F.when(F.col("labels").isNull(), "no labels").when(F.size("labels") != F.col("n"), "length mismatch").otherwise("ok")
    return j.select(F.when(status == "ok", F.array_max("labels")).alias("fdi"), F.coalesce("cusps", F.lit(0).cast("bigint")).alias("cusps"), status.alias("status"))


def region_faces(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh_id, f, fdi of faces whose three corners carry one tooth's label."""
    out = faces
    for k in range(3):
        out = out.join(labels.select("mesh_id", F.col("v").alias(f"v{k}"), F.col("fdi").alias(f"l{k}")), ["mesh_id", f"v{k}"])
    return out.where("l0 = l1 AND l1 = l2 AND l0 <> 0").select("mesh_id", "f", F.col("l0").alias("fdi"))


@query(FRAME_SQL + "SELECT mesh_id, (v0 // 40)::BIGINT AS fdi, count(*) AS n FROM n WHERE v0 // 40 = v1 // 40 AND v1 // 40 = v2 // 40 AND v0 // 40 > 0 GROUP BY ALL")
def labelled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of each torus whose corners all lie in one block of 40 vertices but the first, as regions."""
    v, f = torus_corpus(spark, sf_dir)
    return region_faces(f, v.select("mesh_id", "v", F.floor(F.col("v") / 40).alias("fdi"))).groupBy("mesh_id", "fdi").agg(F.count("*").alias("n"))


@query(FRAME_SQL + """, s AS (SELECT mesh_id, f, sqrt((bx - ax) ** 2 + ("by" - ay) ** 2 + (bz - az) ** 2) AS l0, sqrt((cx - bx) ** 2 + (cy - "by") ** 2 + (cz - bz) ** 2) AS l1, sqrt((ax - cx) ** 2 + (ay - cy) ** 2 + (az - cz) ** 2) AS l2 FROM n),
l AS (SELECT mesh_id, unnest([l0, l1, l2]) AS l FROM s) SELECT mesh_id, round(stddev_pop(l) / avg(l), 6) AS edge_cv FROM l GROUP BY mesh_id""")
def edge_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient of variation of edge lengths, edges counted once per face corner."""
    v, f = torus_corpus(spark, sf_dir)
    c = geometry.corners(f, v).select("mesh_id", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")).alias("l"))
    return c.groupBy("mesh_id").agg(F.round(F.stddev_pop("l") / F.avg("l"), 6).alias("edge_cv"))


@query("SELECT 's' || s_suppkey AS mesh_id, (2 * (6 + s_suppkey % 11) * (4 + s_suppkey % 7))::BIGINT AS n_vertices, (4 * (6 + s_suppkey % 11) * (4 + s_suppkey % 7))::BIGINT AS n_faces, 2::BIGINT AS components FROM supplier")
def disjoint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each torus beside a copy of itself: ids shifted, two components."""
    v, f = torus_corpus(spark, sf_dir)
    shift = v.groupBy("mesh_id").agg((F.max("v") + 1).alias("nv")).join(f.groupBy("mesh_id").agg((F.max("f") + 1).alias("nf")), "mesh_id")
    v2 = v.union(v.join(shift, "mesh_id").select("mesh_id", F.col("v") + F.col("nv"), F.col("x") + 5.0, "y", "z"))
    f2 = f.union(f.join(shift, "mesh_id").select("mesh_id", F.col("f") + F.col("nf"), *(F.col(c) + F.col("nv") for c in ("v0", "v1", "v2"))))
    e = topology.edges(f2)
    parts = components(v2, e, ["mesh_id"]).groupBy("mesh_id").agg(F.count_distinct("label").alias("components"))
    return v2.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")).join(f2.groupBy("mesh_id").agg(F.count("*").alias("n_faces")), "mesh_id").join(parts, "mesh_id")


@query("SELECT * FROM (VALUES ('intrinsic', true, true), ('plain', true, true)) t(mesh_id, angles, areas)")
def intrinsic_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas from lengths tile the brick grid before and after flips; its angles sum to pi per face."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        t = surface.Intrinsic(m)
        if name == "intrinsic":
            t.to_delaunay()
        c = t.cotangents().reshape(-1, 3)
        angles = np.arctan2(1.0, c)
        return pd.DataFrame({"mesh_id": [name], "angles": [bool(np.abs(angles.sum(1) - np.pi).max() < 1e-9)], "areas": [bool(abs(t.areas().sum() - 1) < 1e-9)]})

    b = M.brick_grid(12)
    return per_mesh(*tables(spark, {"plain": b, "intrinsic": b}), kernel, "mesh_id string, angles boolean, areas boolean")


@query("SELECT 12 AS faces, true AS on_sphere, true AS uniform")
def direction_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spiral directions lie on the unit sphere within their cap, evenly in height."""

    def kernel(name: str, m: M.Mesh) -> pd.DataFrame:
        d = rays.cap_directions(np.array([0, 0, 1.0]), 0.6, 500)
        z = np.sort(d[:, 2])
        return pd.DataFrame({"faces": [len(m.f)], "on_sphere": [bool(np.abs(np.linalg.norm(d, axis=1) - 1).max() < 1e-12)], "uniform": [bool(np.abs(np.diff(z) - (1 - np.cos(0.6)) / 500).max() < 1e-9 and z[0] >= np.cos(0.6))]})

    return per_mesh(*tables(spark, {"any": M.grid(3, 2)}), kernel, "faces int, on_sphere boolean, uniform boolean")
