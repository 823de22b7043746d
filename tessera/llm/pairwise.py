"""Comparison of given pairs of cells (pieces of texts) in blocks.

A cell is named by (tid, cell) and holds 4-byte shingle hashes (sh) from place ``start`` on. Shipping
both cells with each pair would send a cell as often as it has partners. Instead pairs are dealt
into blocks of a bounded number of cells a side, and each cell travels to a block once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lookup

BLOCK_CELLS = 512


def blocks(pairs: DataFrame) -> DataFrame:
    """Pairs (a, ca, b, cb) with the block (g) that compares them.

    Pairs whose texts have a common smallest neighbour are dealt, by hashes of either cell, into
    blocks of about ``BLOCK_CELLS`` cells a side, so that a hot text is spread too.
    """
    own = pairs.select(F.col("b").alias("label_of"), "a").union(pairs.select("a", "a")).groupBy("label_of").agg(F.min("a").alias("label"))
    named = lookup(pairs.withColumn("label_of", F.col("a")), own, "label_of").drop("label_of")

    def cuts(*cell: str) -> Column:
        return F.ceil(F.approx_count_distinct(F.xxhash64(*cell), 0.1) / BLOCK_CELLS)

    sizes = named.groupBy("label").agg(cuts("a", "ca").alias("na"), cuts("b", "cb").alias("nb"))
    block = F.xxhash64("label", F.pmod(F.xxhash64("a", "ca"), "na"), F.pmod(F.xxhash64("b", "cb"), "nb"))
    return lookup(named, sizes, "label").select(block.alias("g"), "a", "ca", "b", "cb")


def compared(pairs: DataFrame, cells: DataFrame, rows_of: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``rows_of`` says of each cell and the others it is paired with; both are (tid, cell, start, hashes).

    ``pairs``: g, a, ca, b, cb. ``cells``: tid, cell, start, sh. Pairs whose cells are missing say nothing.
    """
    none = {k: F.lit(None).cast(v) for k, v in (("b", "bigint"), ("cb", "int"), ("start", "int"), ("sh", "binary"))}
    sides = pairs.select("g", F.col("a").alias("tid"), F.col("ca").alias("cell")).union(pairs.select("g", "b", "cb")).distinct()
    held = sides.join(cells, ["tid", "cell"]).select("g", F.col("tid").alias("a"), F.col("cell").alias("ca"), none["b"].alias("b"), none["cb"].alias("cb"), "start", "sh")
    rows = held.union(pairs.select("g", "a", "ca", "b", "cb", none["start"], none["sh"]))
    types = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        block, own, out = None, {}, []
        left, rest = None, []  # the first cell of the pairs being read, and their second ones

        def compare() -> None:
            others = [own[r] for r in rest if r in own]
            if left in own and others:
                out.extend(rows_of(own[left], others))

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
            out.clear()
            return done

        for batch in batches:
            for g, a, ca, b, cb, start, sh in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if left and (g != block or left != (a, ca) or sh is not None):
                    compare()
                    left, rest = None, []
                if g != block:
                    block, own = g, {}
                if sh is not None:
                    own[a, ca] = a, ca, start, np.frombuffer(sh, np.uint32)
                else:
                    left = a, ca
                    rest.append((b, cb))
            if out:
                yield batch_of()
        if left:
            compare()
        if out:
            yield batch_of()

    return rows.repartition("g").sortWithinPartitions("g", F.col("sh").isNull(), "a", "ca").mapInArrow(run, schema)
