"""The jobs as registered queries: each runs its job twice into one new folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import new_folder

from . import label_model, scan_intake
from .common import default_config


def job1_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of quality; the second run overwrites the first one's files."""
    out, config = new_folder(spark, "label-model"), default_config("label_model")
    for _ in range(2):
        rows = label_model.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    return rows.withColumn("probability", F.round("probability", 6))


def job2_scan_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality row for the scan of each supplier; the second run finds nothing new."""
    out, config = new_folder(spark, "scan-intake"), default_config("scan_intake")
    for _ in range(2):
        rows = scan_intake.run(spark, f"{sf_dir}/supplier.parquet", f"{out}/rows", f"{out}/checkpoint", config)
    return rows.drop("batch", "error")


_STEPS = ", ".join(f"sum({a}) AS {n}" for n, a in {
    "g1": "(y - p) * a", "g2": "(y - p) * b", "g3": "y - p", "h11": "q * a * a", "h12": "q * a * b", "h13": "q * a", "h22": "q * b * b", "h23": "q * b", "h33": "q",
}.items())

SQL = {
    "job1_label_model": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(text, '') = '' AS blank,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / greatest(1, length(text))::DOUBLE END AS a,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 - len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' '))::DOUBLE END AS b FROM documents),
ids AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), many AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1),
r AS (SELECT d.*, CASE WHEN ids.n > 1 THEN 'repeated' WHEN coalesce(many.n, 0) <> 1 THEN 'no_prediction' WHEN blank THEN 'scan_error' WHEN quality IS NULL THEN 'prediction_error' ELSE 'matched' END AS reason, quality
  FROM d JOIN ids USING (doc_id) LEFT JOIN many USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id AND many.n = 1),
f AS (SELECT *, md5('88|' || doc_id) AS h, ('0x' || md5('88|' || doc_id)[1:8])::BIGINT % 5 AS fold FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS k FROM f WHERE reason = 'matched' AND fold IN (1, 2)),
t AS (SELECT * FROM s WHERE k <= 20000),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, count(*) AS n FROM t),
z AS (SELECT (a - ma) / sa AS a, (b - mb) / sb AS b, quality AS y FROM t, m),
w(k, u, v, c) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, u + (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det, v + (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det,
    c + (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det
  FROM (SELECT k, u, v, c, g1, g2, g3, h11, h12, h13, h22, h23, h33, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det
    FROM (SELECT k, u, v, c, g1 - 0.001 * n * u AS g1, g2 - 0.001 * n * v AS g2, g3, h11 + 0.001 * n AS h11, h12, h13, h22 + 0.001 * n AS h22, h23, h33
      FROM (SELECT k, u, v, c, {_STEPS} FROM (SELECT *, greatest(p * (1 - p), 1e-12) AS q FROM (SELECT k, u, v, c, a, b, y, 1 / (1 + exp(-(u * a + v * b + c))) AS p FROM w, z WHERE k < 25)) GROUP BY k, u, v, c), m))),
o AS (SELECT * FROM w WHERE k = 25)
SELECT f.doc_id, f.lang, f.reason, CASE WHEN f.reason <> 'matched' THEN NULL WHEN f.fold IN (1, 2) THEN 'train' WHEN f.fold IN (3, 4) THEN 'validation' ELSE 'kept' END AS fold, t.doc_id IS NOT NULL AS sampled,
  CASE WHEN f.reason = 'matched' THEN f.quality END AS label, round(p, 6) AS probability, (p >= 0.5)::INT AS predicted
FROM (SELECT f.*, 1 / (1 + exp(-(u * (a - ma) / sa + v * (b - mb) / sb + c))) AS p FROM f, m, o) f LEFT JOIN t ON t.doc_id = f.doc_id""",
    "job2_scan_intake": """
WITH p AS (SELECT 's' || s_suppkey AS mesh_id, (6 + s_suppkey % 11) * (4 + s_suppkey % 7) AS n, (s_suppkey % 3 = 0)::INT AS lost, (s_suppkey % 4 = 0)::INT AS repeated, (s_suppkey % 5 = 0)::INT AS flipped,
  (s_suppkey % 6 = 0)::INT AS flat, (s_nationkey % 2 = 0)::INT AS stray, (s_acctbal < 0)::INT AS wild FROM supplier)
SELECT mesh_id, n + stray AS vertices, 2 * n - lost + repeated + wild AS faces, 1 AS components, n AS largest_vertices, -lost AS largest_chi, lost AS largest_loops, 1 AS largest_genus, true AS largest_manifold,
  0 AS nonmanifold_edges, 3 * flipped AS misoriented_edges, 3 * lost AS boundary_edges, 0 AS nonmanifold_vertices, wild AS invalid_faces, repeated AS duplicate_faces, stray AS isolated_vertices, 2 * flat AS zero_area_faces,
  true AS halfedge_ok, CASE WHEN flipped + wild + repeated + stray + flat > 0 THEN 'defects' ELSE 'clean' END AS status FROM p""",
}


def queries() -> dict:
    return {"job1_label_model": job1_label_model, "job2_scan_intake": job2_scan_intake}


def oracle_sql() -> dict:
    return dict(SQL)
