"""Order statistics by index, numbering by first appearance, capped histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_index(df: DataFrame, value: str, q: float, by: list[str], name: str = "q") -> DataFrame:
    """sorted[floor(q (n-1))] of each group; neither interpolated nor rounded up."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_r") == F.floor(F.lit(q) * (F.col("_n") - 1)) + 1).select(*by, F.col("_v").alias(name))


def upper_median(df: DataFrame, value: str, by: list[str], name: str = "median") -> DataFrame:
    """sorted[n/2] of each group."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col("_v").alias(name))


def first_appearance(df: DataFrame, key: list[str], position: str, by: list[str], name: str = "id") -> DataFrame:
    """One row per key, numbered from 0 in the order of its first position."""
    first = df.groupBy(*by, *key).agg(F.min(position).alias("_first"))
    return first.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1).cast("bigint")).drop("_first")


def capped_bucket(value: Column, cap: int) -> Column:
    return F.least(value, F.lit(cap))
