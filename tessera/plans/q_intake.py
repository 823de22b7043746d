"""Seeded samples, reconciliation by name and grouping statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.operators.reconcile import reconcile
from tessera.operators.sampling import bottom_k, split_of

from .registry import query, table


@query("""WITH h AS (SELECT o_orderkey, o_orderpriority, md5('88|' || o_orderkey) AS h FROM orders), r AS (SELECT *, ('0x' || h[1:8])::BIGINT % 5 AS fold FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, fold ORDER BY h, o_orderkey) AS k FROM r WHERE fold IN (1, 2)) SELECT o_orderpriority, fold, o_orderkey FROM k WHERE k <= 150""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 orders of each priority and training fold, drawn by seed: a sampling operator."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").withColumn("fold", split_of(88, 5, "o_orderkey"))
    return bottom_k(o.where("fold IN (1, 2)"), ["o_orderkey"], ["o_orderpriority", "fold"], 150, seed=88).select("o_orderpriority", "fold", "o_orderkey")


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey % 7 + 1 AS n, CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS e FROM orders WHERE o_orderkey % 11 <> 0),
p AS (SELECT l_orderkey AS k, count(*) AS n, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 2 THEN 'returned' END AS e FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY 1),
h AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT coalesce(s.k, p.k) AS orderkey, s.n AS scan_n, s.e AS scan_error, p.n AS prediction_n, p.e AS prediction_error, CASE WHEN p.k IS NULL THEN 'scan' WHEN s.k IS NULL THEN 'prediction' ELSE 'both' END AS side,
  CASE WHEN coalesce(s.k, p.k) IN (SELECT k FROM h) THEN 'held_out' WHEN s.k IS NULL THEN 'no_scan' WHEN p.k IS NULL THEN 'no_prediction' WHEN s.e IS NOT NULL THEN 'scan_error' WHEN p.e IS NOT NULL THEN 'prediction_error' WHEN s.n <> p.n THEN 'length' ELSE 'matched' END AS reason
FROM s FULL JOIN p ON s.k = p.k""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans, their lines as predictions, urgent ones held out: a reason for every row."""
    o = table(spark, sf_dir, "orders")
    s = o.where(F.col("o_orderkey") % 11 != 0).select(F.col("o_orderkey").alias("orderkey"), (F.col("o_custkey") % 7 + 1).alias("n"), F.when(F.col("o_orderstatus") == "P", "pending").alias("error"))
    l = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 13 != 0).groupBy(F.col("l_orderkey").alias("orderkey"))
    p = l.agg(F.count("*").alias("n"), F.when(F.count_if(F.col("l_returnflag") == "R") > 2, "returned").alias("error"))
    held = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("orderkey"))
    return reconcile(s, p, "orderkey", held)


@query("""WITH e AS (SELECT event_id AS i, event_type AS g, user_id % 9 AS t, CASE WHEN hour(ts) < 20 THEN hour(ts) + 24 * (user_id % 4) ELSE -1 END AS c FROM events),
u AS (SELECT * FROM e WHERE t <> 0 AND c >= 0), p AS (SELECT a.g, sum((a.t = b.t AND a.c = b.c)::INT) AS together, sum((a.t <> b.t AND a.c = b.c)::INT) AS merged, sum((a.t = b.t AND a.c <> b.c)::INT) AS split FROM u a JOIN u b ON a.g = b.g AND a.i < b.i WHERE a.t = b.t OR a.c = b.c GROUP BY a.g),
n AS (SELECT g, t, count(DISTINCT c) AS groups, any_value(c) AS c FROM u GROUP BY ALL), m AS (SELECT g, c, count(DISTINCT t) AS truths FROM u GROUP BY ALL),
k AS (SELECT n.g, count(*) AS truths, sum((groups = 1 AND m.truths = 1)::INT) AS clean FROM n JOIN m ON n.g = m.g AND n.c = m.c GROUP BY n.g)
SELECT e.g, count(*) AS items, sum((t = 0)::INT) AS on_background, sum((t <> 0 AND c < 0)::INT) AS ungrouped, coalesce(any_value(together), 0) AS together, coalesce(any_value(merged), 0) AS merged, coalesce(any_value(split), 0) AS split, coalesce(any_value(truths), 0) AS truths, coalesce(any_value(clean), 0) AS clean
FROM e LEFT JOIN p ON p.g = e.g LEFT JOIN k ON k.g = e.g GROUP BY e.g""")
def grouping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tips, users as teeth, hours as groups: pairs kept together, merged and split."""
    hour, user = F.hour("ts"), F.col("user_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), (user % 9).alias("t"), F.when(hour < 20, hour + 24 * (user % 4)).otherwise(-1).alias("c"))
    return metrics.grouping_pairs(e, "t", "c", ["g"])
