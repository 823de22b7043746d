"""Seeded samples and shuffles that don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *key: str) -> Column:
    """A row's place in the seed's random order: the digest of seed and key, as hexadecimal text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)))


def bottom_k(df: DataFrame, key: list[str], strata: list[str], k: int, seed: int = 1) -> DataFrame:
    """Exactly ``k`` rows of each stratum, or all of a smaller one: those drawn first.

    The first k of a stratum are among the first k of each of its parts, so Spark limits the parts
    before it exchanges them, and a large stratum costs its task k rows a part. Rows that share a key
    are drawn together and told apart by nothing; null is a stratum of its own.
    """
    w = Window.partitionBy(*strata).orderBy("_draw", *key)
    return df.withColumn("_draw", draw(seed, *key)).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_draw", "_place")


def shuffled(df: DataFrame, key: list[str], seed: int = 1) -> DataFrame:
    """All rows in the seed's random order: a range sort by the digest, whose ranges are even."""
    return df.withColumn("_draw", draw(seed, *key)).orderBy("_draw", *key).drop("_draw")


def split_of(seed: int, parts: int, *key: str) -> Column:
    """The part, 0 to ``parts - 1``, that a row falls into by its key alone."""
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("bigint") % parts
