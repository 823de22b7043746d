"""Hard-negative mining: for each anchor all integer scores, sorted in full, searched per positive.

Components become ``floor(scale * x)``; a score is the integer inner product with the anchor. Rows
and anchors are dealt by hash into cells of about ``ROWS`` rows and ``ANCHORS`` anchors, and a row
travels once to each block of anchors. A first pass over the cells finds each anchor's positives,
its best rows of its own label. In the second a cell's scores are lexsorted by score and id for each
anchor, each positive's upper limit is found by binary search, and the k entries of other labels
from there on that reach the lower limit are read. What cells return is a few entries per anchor,
of which a window keeps the best; a cell's bound is the blocks' size, and no row is left unscored.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part;
a null id takes part, sorts last among ties, is no anchor and keeps its label; rows that share an id
are rows of their own, also as anchors (an anchor's own row is never its positive); vectors score
only with vectors of their length, empty ones 0; a component whose floor is beyond a bigint, or a
score that is, counts as the nearest bigint; empty tables give no rows; extra columns are ignored.
Equal scores of equal ids are alike in every column that is returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows and anchors of a cell, about; and anchors whose scores are held at a time.
ROWS, ANCHORS, SLICE = 8192, 2048, 64
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vec (bigints) of the rows that take part, numbered by ``row``."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = df.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding").where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return materialise(rows.select("vec_id", "label", vec.alias("vec")).withColumn("row", F.monotonically_increasing_id()), "quantised")


def _cells(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Both sides dealt to their cells; ``held`` is null for rows and what an anchor carries (an array) for anchors."""
    n, m = max(1, -(-rows.count() // ROWS)), max(1, -(-anchors.count() // ANCHORS))
    block = lambda k: F.pmod(F.xxhash64("row", F.lit(k)), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    size = F.size("vec").alias("dim")
    left = anchors.select("row", "vec_id", "label", "vec", "held", size, block(m).alias("a")).withColumn("r", every(n))
    right = rows.select("row", "vec_id", "label", "vec", F.lit(None).cast(dict(anchors.dtypes)["held"]).alias("held"), size, block(n).alias("r")).withColumn("a", every(m))
    return left.unionByName(right)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows: in doubles while they can hold them, else in Python's integers."""
    top = lambda v: max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0
    if top(a) * top(x) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    s = a.astype(object) @ x.T.astype(object)
    return np.vectorize(lambda v: min(max(v, _LOW), _HIGH), otypes=[np.int64])(s)


def _per_cell(find: Callable, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Runs ``find(anchors, rows)`` on a cell: dicts of arrays, rows in order of id with null ids last."""

    def side(t: pa.Table) -> dict:
        ids, dim = t["vec_id"].combine_chunks(), t["dim"][0].as_py() if len(t) else 0
        null = np.asarray(ids.is_null())
        flat = pa.chunked_array(t["vec"]).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return {"row": t["row"].to_numpy(), "id": ids.fill_null(0).to_numpy(), "null": null, "label": t["label"].to_numpy(), "vec": flat.astype(np.int64).reshape(len(t), dim), "held": t["held"]}

    def run(cell: pa.Table) -> pa.Table:
        is_row = cell["held"].is_null()
        anchors, rows = cell.filter(pa.compute.invert(is_row)), cell.filter(is_row)
        found = []
        if len(anchors) and len(rows):
            a, x = side(anchors), side(rows)
            order = np.lexsort((x["id"], x["null"]))
            found = find(a, {k: v if k == "held" else v[order] for k, v in x.items()})
        columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _ordered(x: dict, scores: np.ndarray) -> np.ndarray:
    """For each anchor the places of rows by score, then id; null ids after others."""
    place = np.broadcast_to(np.arange(len(x["id"])), scores.shape)  # rows are in order of id
    return np.lexsort((place, ~scores), axis=1)


def _id(x: dict, at: int) -> int | None:
    return None if x["null"][at] else int(x["id"][at])


def _find_positives(count: int) -> Callable:
    def find(a: dict, x: dict) -> list[tuple]:
        out = []
        for label in np.unique(a["label"]):
            mine, own = np.flatnonzero(a["label"] == label), np.flatnonzero(x["label"] == label)
            near = {k: v if k == "held" else v[own] for k, v in x.items()}
            for lo in range(0, len(mine) * bool(len(own)), SLICE):
                part = mine[lo : lo + SLICE]
                scores = _scores(a["vec"][part], near["vec"])
                for i, s, order in zip(part, scores, _ordered(near, scores)[:, : count + 1], strict=True):
                    others = [j for j in order if near["row"][j] != a["row"][i]][:count]
                    out += [(int(a["row"][i]), _id(near, j), int(s[j])) for j in others]
        return out

    return find


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score of a negative: ``low`` to ``high`` hundredths of the positive's."""
    return -(-low * positive // 100), high * positive // 100


def _find_negatives(count: int, low: int, high: int) -> Callable:
    def find(a: dict, x: dict) -> list[tuple]:
        out = []
        for lo in range(0, len(a["row"]), SLICE):
            scores = _scores(a["vec"][lo : lo + SLICE], x["vec"])
            for i, (s, order) in enumerate(zip(scores, _ordered(x, scores), strict=True), lo):
                order = order[x["label"][order] != a["label"][i]]
                falling = ~s[order]  # ascending, without the overflow of a minus
                for k, p in enumerate(a["held"][i].as_py()):
                    least, most = limits(p, low, high)
                    if least > most:
                        continue
                    start = int(np.searchsorted(falling, ~max(most, _LOW)))
                    for j in order[start : start + count]:
                        if s[j] < least:
                            break
                        out.append((int(a["row"][i]), k, _id(x, j), int(s[j])))
        return out

    return find


def _first(rows: DataFrame, groups: list[str], count: int, score: str, id_: str) -> DataFrame:
    """The ``count`` best rows of each group, numbered by ``rank`` from 1."""
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(id_).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: what :func:`quantised` gives, relabelled or not. For each anchor and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of other labels that
    score ``low`` to ``high`` hundredths of the positive.
    """
    bare = rows.where(is_anchor)
    near = _cells(bare.withColumn("held", F.array().cast("array<bigint>")), rows)
    schema = pa.schema([("row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    found = near.groupBy("r", "a", "dim").applyInArrow(_per_cell(_find_positives(positives), schema), "row bigint, positive_id bigint, positive_score bigint")
    best = materialise(_first(found, ["row"], positives, "positive_score", "positive_id").select("row", (F.col("rank") - 1).alias("k"), "positive_id", "positive_score"), "positives")
    held = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda s: s["positive_score"]).alias("held"))
    far = _cells(materialise(bare.join(held, "row"), "anchors"), rows)
    schema = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    found = far.groupBy("r", "a", "dim").applyInArrow(_per_cell(_find_negatives(negatives, low, high), schema), "row bigint, k int, negative_id bigint, negative_score bigint")
    top = _first(found, ["row", "k"], negatives, "negative_score", "negative_id")
    named = best.join(bare.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return top.join(named, ["row", "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 carry a wrong label, as noise; anchors are those divisible by 50."""
    e = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", noisy), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS a, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.n <> b.n WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own),
g AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.a = s.a AND s.label <> s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 3
"""
