"""Minimum cuts of graphs that the tables describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.flow import minimum_cut

from .registry import query, table


@query("""WITH l AS (SELECT l_partkey AS part, l_linenumber AS k, l_orderkey % 8 AS u, l_suppkey % 8 AS v, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
t AS (SELECT part, u AS v, CASE WHEN k = 1 THEN q ELSE 0 END AS source, CASE WHEN k = 2 THEN q ELSE 0 END AS sink FROM l WHERE k <= 2),
n AS (SELECT part, v FROM t UNION SELECT part, u FROM l WHERE k > 2 UNION SELECT part, v FROM l WHERE k > 2),
m AS (SELECT part, m, 0 AS w FROM (SELECT DISTINCT part FROM n), range(256) r(m)
  UNION ALL SELECT part, m, CASE WHEN (m >> v) & 1 = 1 THEN sink ELSE source END FROM t, range(256) r(m)
  UNION ALL SELECT part, m, q FROM l, range(256) r(m) WHERE k > 2 AND (m >> u) & 1 = 1 AND (m >> v) & 1 = 0),
c AS (SELECT part, m, sum(w) AS value FROM m GROUP BY part, m),
b AS (SELECT part, min(value) AS value FROM c GROUP BY part),
s AS (SELECT part, value, bit_and(m) AS m FROM c JOIN b USING (part, value) GROUP BY part, value)
SELECT part, v AS node, (m >> v) & 1 = 1 AS source_side, CAST(value AS BIGINT) AS value FROM n JOIN s USING (part)""")
def part_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cut of a graph per part: lines 1 are sources, lines 2 sinks, the others arcs. The oracle tries all 256 cuts of each."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select(F.col("l_partkey").alias("part"), "l_linenumber", (F.col("l_orderkey") % 8).alias("u"), (F.col("l_suppkey") % 8).alias("v"), F.col("l_quantity").cast("bigint").alias("cap"))
    k, none = F.col("l_linenumber"), F.lit(0).cast("bigint")
    ends = li.where(k <= 2).select("part", F.col("u").alias("v"), F.when(k == 1, F.col("cap")).otherwise(none).alias("source"), F.when(k == 2, F.col("cap")).otherwise(none).alias("sink"))
    sides, values = minimum_cut(ends, li.where(k > 2).select("part", "u", "v", "cap"), ["part"])
    return sides.join(values, "part").select("part", F.col("v").alias("node"), "source_side", "value")
