"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions throughout.

Pass 1 sets two bits of a blocked Bloom filter for each row's digest and keeps the bits that were
set twice or more. Pass 2 tests every row against those bits: a row that misses one has no equal
and passes straight through. Only the others shuffle, keyed by the whole SHA-256.

The kept bits are broadcast. Their size has a bound, ``max_blocks`` x 4 KiB, whatever the input:
beyond the number of rows that fits, more rows test positive and shuffle, and the result is the same.

Defined cases: null text counts as empty, and empty texts are equal to each other. Of equal texts
the row with the most code points in the original stays, then the smallest id. Rows that repeat
both id and text are annotated alike by :func:`annotate`; :func:`exact_dedup` keeps one of them.
Null ids sort first. Empty tables give empty results. Extra columns pass through unchanged, also
those that begin with an underscore; names starting with ``_xd_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise

BITS = 32768
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _places(df: DataFrame, blocks: int) -> DataFrame:
    h = F.xxhash64("_xd_sha")
    one = F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(BITS - 1))
    step = F.pmod(F.shiftrightunsigned(h, 32), F.lit(BITS - 1)) + 1
    return df.withColumns({"_xd_block": F.pmod(F.xxhash64("_xd_sha", F.lit(7)), F.lit(blocks)), "_xd_b1": one, "_xd_b2": F.pmod(one + step, F.lit(BITS))})


def _repeated_bits(digests: DataFrame, blocks: int) -> DataFrame:
    """Pass 1: per block, the bitmap of positions that more than one row has set."""
    bits = _places(digests, blocks).select("_xd_block", F.explode(F.array("_xd_b1", "_xd_b2")).alias("bit"))
    twice = bits.groupBy("_xd_block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.col("_xd_block").alias("_xd_at")).agg(F.bitmap_construct_agg("bit").alias("_xd_map"))


def _set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.expr("substring(_xd_map, cast(bit div 8 as int) + 1, 1)".replace("bit", bit))), 16, 10).cast("int")
    return F.expr(f"cast({bit} % 8 as int)"), byte


def _is_set(bit: str) -> Column:
    shift, byte = _set(bit)
    return F.getbit(byte, shift) == 1


def _tested(df: DataFrame, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Pass 2: adds ``_xd_maybe``, false only for rows that surely have no equal."""
    j = _places(df, blocks).join(F.broadcast(bitmaps), F.col("_xd_block") == F.col("_xd_at"), "left")
    hit = F.coalesce(_is_set("_xd_b1") & _is_set("_xd_b2"), F.lit(False))
    return j.withColumn("_xd_maybe", hit).drop("_xd_block", "_xd_b1", "_xd_b2", "_xd_at", "_xd_map")


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("_xd_id"), F.unhex(F.sha2(normalised(t), 256)).alias("_xd_sha"), F.length(t).alias("_xd_len"))


def _blocks(rows: int, bits_per_row: int, max_blocks: int) -> int:
    return max(1, min(max_blocks, -(-rows * bits_per_row // BITS)))


def _winners(maybe: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("_xd_len")).alias("l"), F.col("_xd_id").alias("i")))
    return maybe.groupBy("_xd_sha").agg(best.alias("b"), F.count("*").alias("_xd_size")).select("_xd_sha", F.col("b.i").alias("_xd_keep"), "_xd_size")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32, max_blocks: int = 8192) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    digests = materialise(_digests(df, id_col, text_col), "digests")
    blocks = _blocks(digests.count(), bits_per_row, max_blocks)
    tested = _tested(digests, _repeated_bits(digests, blocks), blocks)
    alone = tested.where(~F.col("_xd_maybe")).select("_xd_id", "_xd_sha", F.col("_xd_id").alias("_xd_keep"), F.lit(1).cast("bigint").alias("_xd_size"))
    maybe = tested.where("_xd_maybe").drop("_xd_maybe")
    grouped = lookup(maybe.drop("_xd_len"), _winners(maybe), "_xd_sha").select(*alone.columns)
    out = alone.unionByName(grouped)
    return out.select(F.col("_xd_id").alias(id_col), F.col("_xd_keep").alias("keep_id"), F.col("_xd_size").alias("group_size"), F.col("_xd_id").eqNullSafe(F.col("_xd_keep")).alias("kept"), F.lower(F.hex("_xd_sha")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32, max_blocks: int = 8192) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names; rows without an equal don't shuffle."""
    names = df.columns
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    df = df.toDF(*(f"c{i}" for i in range(len(names))))
    digests = materialise(_digests(df, id_col, text_col), "digests")
    blocks = _blocks(digests.count(), bits_per_row, max_blocks)
    bitmaps = materialise(_repeated_bits(digests, blocks), "bitmaps")
    whole = df.withColumn("_xd_sha", F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)))
    tested = _tested(whole, bitmaps, blocks)
    alone = tested.where(~F.col("_xd_maybe")).select(*df.columns)
    winners = _winners(_tested(digests, bitmaps, blocks).where("_xd_maybe"))
    maybe = lookup(tested.where("_xd_maybe"), winners, "_xd_sha").where(F.col(f"`{id_col}`").eqNullSafe(F.col("_xd_keep")))
    return alone.union(maybe.dropDuplicates(["_xd_sha"]).select(*df.columns)).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents),
k AS (SELECT s, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT t.doc_id, k.keep_id, k.group_size, t.doc_id = k.keep_id AS kept, t.s AS text_sha256
FROM t JOIN k USING (s)
"""
