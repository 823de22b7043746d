"""Iterated relational operators: all meshes advance together in one loop.

Each round is written to the shared folder, so that its lineage ends and lost executors cost
one round at most. Without ``spark.checkpoint.dir`` (tests) a temporary folder serves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import new_folder

from .kernels.contract import least_nodes

#: Tables of more rows that a round has written aren't broadcast.
BROADCAST_ROWS = 100_000
#: A label that more nodes of a graph hold isn't looked up by shuffling them to it.
HOT = 100_000

#: Rows of a graph that one task joins or tells apart, about. Spark cuts its own tasks by shuffled bytes, of which rows of near ids have few.
TASK_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder of the shared one and read it back: its lineage ends there.

    Spark estimates a checkpointed table's size as that of the plan behind it, and a join's as the product
    of its sides', so a state that is joined with itself round after round gets estimates whose digits
    multiply each time, until they fill the driver. A stored table has its files' size. Its rows are counted
    on the way, since files of few bytes may hold many rows, which must not go through the driver in a broadcast.
    """
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows."""
    spark: SparkSession = df.sparkSession
    path, rows = new_folder(spark, "rounds"), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out, n = spark.read.schema(df.schema).parquet(path), rows.get["n"]
    return out.hint("merge") if n > BROADCAST_ROWS else out, n


def _dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df``, dealt by ``columns`` into as many tasks as its ``rows`` ask for, if these are more than one."""
    return df.repartition(rows // TASK_ROWS + 1, *columns) if rows > TASK_ROWS else df


def components(nodes: DataFrame, edges: DataFrame, by: list[str], node: str = "v", a: str = "u", b: str = "v", max_rounds: int = 100) -> DataFrame:
    """Least node of each node's component: by..., node, label. Edges are undirected, their ends are nodes.

    Edges are dealt by graph (those of a graph of more than :data:`TASK_ROWS` edges by their hash too), and each task
    contracts what it holds. A node that several tasks gave different labels links these, and only such links
    go through rounds: none, where every graph fits a task.
    """
    pairs, n = counted(edges.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).na.drop())
    labels = _contracted(pairs, n, by)
    if n > TASK_ROWS:
        labels = _linked(cut(labels), by, max_rounds)
    own = nodes.select(*by, F.col(node).alias("_v")).na.drop().distinct()
    return cut(own.join(labels.select(*by, "_v", "_l"), [*by, "_v"], "left").select(*by, F.col("_v").alias(node), F.coalesce("_l", "_v").alias("label")))


def _linked(stars: DataFrame, by: list[str], max_rounds: int) -> DataFrame:
    """One label (by, _v, _l) a node from those that tasks gave it."""
    labels = cut(stars.groupBy(*by, "_v").agg(F.min("_l").alias("_l"), F.max("_l").alias("_h")))
    links = stars.withColumnRenamed("_l", "_b").join(labels.where("_l <> _h").withColumnRenamed("_l", "_a"), [*by, "_v"]).where("_a <> _b")
    links, m = counted(links.select(*by, "_a", "_b").distinct())
    if m:
        ends = links.select(*by, F.col("_a").alias("_v")).union(links.select(*by, F.col("_b").alias("_v")))
        joined = _rounds(ends, links, m, by, max_rounds).select(*by, F.col("_v").alias("_l"), F.col("_l").alias("_r"))
        labels = labels.join(joined, [*by, "_l"], "left").select(*by, "_v", F.coalesce("_r", "_l").alias("_l"))
    return labels


def _contracted(pairs: DataFrame, n: int, by: list[str]) -> DataFrame:
    """by..., _v, _l: the least node of each node's component among the edges (by..., _a, _b) that came together in a task."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TASK_ROWS:
                yield least_nodes(held, by)
                held, rows = [], 0
        if rows:
            yield least_nodes(held, by)

    if n > TASK_ROWS:
        large = pairs.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_ROWS)
        salt = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("_a", "_b"), F.ceil(F.col("_n") / TASK_ROWS)))
        pairs = _dealt(pairs.join(F.broadcast(large), by, "left").withColumn("_s", salt).drop("_n"), 2 * n, *by, "_s").drop("_s")
    else:
        pairs = pairs.repartition(10 * n // TASK_ROWS + 1, *by)
    return pairs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"_v {kinds['_a']}", f"_l {kinds['_a']}"]))


def _rounds(nodes: DataFrame, pairs: DataFrame, n: int, by: list[str], max_rounds: int) -> DataFrame:
    """Labels (by, _v, _l) of the graphs of ``n`` edges (by, _a, _b).

    Rounds take the least label among neighbours and then jump to the label's label, so a path of
    n nodes takes O(log n) rounds. A label that more than :data:`HOT` nodes hold is broadcast with its own
    label, so that a large component isn't looked up in one task.
    """
    both = pairs.union(pairs.select(*by, F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    both = cut(_dealt(both, 2 * n, *by, "_a", "_b").distinct())
    labels, m = counted(nodes.distinct().withColumn("_l", F.col("_v")))
    for _ in range(max_rounds):
        near = _dealt(both, 2 * n, *by, "_b").join(labels.withColumnRenamed("_v", "_b"), [*by, "_b"]).groupBy(*by, "_a").agg(F.min("_l").alias("_m"))
        step = _dealt(labels, m, *by, "_v").join(near.withColumnRenamed("_a", "_v"), [*by, "_v"], "left").select(*by, "_v", F.least("_l", F.coalesce("_m", "_l")).alias("_l"))
        now = cut(_jumped(cut(step), by, m) if m > HOT else _jumped(step, by))
        moved = now.join(labels.withColumnRenamed("_l", "_o"), [*by, "_v"]).where("_l <> _o").limit(1).count()
        labels = now
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def _jumped(step: DataFrame, by: list[str], rows: int = 0) -> DataFrame:
    """Labels (by, _v, _l) after each has gone on to its label's label: a root hands its own to all that point at it."""
    jump = step.select(*by, F.col("_v").alias("_k"), F.col("_l").alias("_j"))
    if rows <= HOT:
        return step.withColumn("_k", F.col("_l")).join(jump, [*by, "_k"]).select(*by, "_v", F.least("_l", "_j").alias("_l"))
    often = step.groupBy(*by, F.col("_l").alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).drop("_n")
    often = often.join(jump, [*by, "_k"]).select(*by, F.col("_k").alias("_l"), F.col("_j").alias("_h"))
    # who holds a hot label looks up itself, and uses the broadcast answer
    own = step.join(F.broadcast(often), [*by, "_l"], "left").withColumn("_k", F.when(F.col("_h").isNull(), F.col("_l")).otherwise(F.col("_v")))
    return _dealt(own, rows, *by, "_k").join(jump, [*by, "_k"]).select(*by, "_v", F.least("_l", F.coalesce("_h", "_j")).alias("_l"))


def shortest_paths(edges: DataFrame, sources: DataFrame, by: list[str], max_distance: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Least distance and its owner for each node reached: by..., v, d, owner, parent.

    ``edges``: by, u, v, len (undirected, >= 0). ``sources``: by, v and optionally owner. A frontier
    of improved nodes is relaxed each round (Bellman-Ford); ties go to the smaller owner, then parent.
    A round writes the improved nodes only; every eighth drops the rows that were improved on.
    """
    if "owner" not in sources.columns:
        sources = sources.withColumn("owner", F.col("v"))
    both = cut(edges.select(*by, "u", "v", "len").union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v"), "len")))
    known_nodes = both.select(*by, F.col("u").alias("v")).distinct()
    start = sources.join(known_nodes, [*by, "v"], "left_semi").groupBy(*by, "v").agg(F.min("owner").alias("owner"))
    frontier = cut(start.select(*by, "v", F.lit(0.0).alias("d"), "owner", F.lit(None).cast("bigint").alias("parent")))
    # all rows that were ever the best of their node; a node's rows improve strictly
    found, kept = frontier, Window.partitionBy(*by, "v").orderBy("d")
    for k in range(1, max_rounds + 1):
        reach = both.join(frontier.withColumnRenamed("v", "u").drop("parent"), [*by, "u"]).select(*by, "v", (F.col("d") + F.col("len")).alias("d"), "owner", F.col("u").alias("parent"))
        if max_distance is not None:
            reach = reach.where(F.col("d") <= max_distance)
        least = reach.groupBy(*by, "v").agg(F.min(F.struct("d", "owner", "parent")).alias("s")).select(*by, "v", "s.*")
        known = found.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "v"])), F.col("d").alias("_kd"))
        same = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate([*by, "v"])]
        frontier = cut(least.join(known, reduce(Column.__and__, [*same, F.col("_kd") <= F.col("d")]), "left_anti"))
        if frontier.isEmpty():
            return found.withColumn("_k", F.row_number().over(kept)).where("_k = 1").drop("_k")
        found = found.unionByName(frontier)
        if k % 8 == 0:
            found = cut(found.withColumn("_k", F.row_number().over(kept)).where("_k = 1").drop("_k"))
    raise RuntimeError("shortest paths did not settle")


def suppressed_maxima(points: DataFrame, pairs: DataFrame, by: list[str], max_rounds: int = 1000) -> DataFrame:
    """Greedy non-maximum suppression as rounds: by..., v of the points kept.

    ``points``: by, v, score. ``pairs``: by, v, w of points closer than the radius, both ways. Ties of
    score go to the smaller v. A point is kept once no undecided neighbour is better.
    """
    s = points.select(*by, "v", "score")
    p = pairs.join(s, [*by, "v"]).join(s.select(*by, F.col("v").alias("w"), F.col("score").alias("ws")), [*by, "w"])
    better = cut(p.where((F.col("ws") > F.col("score")) | ((F.col("ws") == F.col("score")) & (F.col("w") < F.col("v")))).select(*by, "v", "w"))
    near = cut(pairs.select(*by, "v", "w"))
    open_, kept = cut(s.select(*by, "v")), cut(s.select(*by, "v").limit(0))
    for _ in range(max_rounds):
        blocked = better.join(open_.withColumnRenamed("v", "w"), [*by, "w"], "left_semi").select(*by, "v")
        new = cut(open_.join(blocked, [*by, "v"], "left_anti"))
        if new.isEmpty():
            return kept
        out = near.join(new.withColumnRenamed("v", "w"), [*by, "w"], "left_semi").select(*by, "v")
        kept = cut(kept.union(new))
        open_ = cut(open_.join(new, [*by, "v"], "left_anti").join(out, [*by, "v"], "left_anti"))
    raise RuntimeError("suppression did not settle")


def greedy_match(pairs: DataFrame, by: list[str], max_rounds: int = 1000) -> DataFrame:
    """Greedy one-to-one matching of pairs (by..., i, j, d) by ascending (d, i, j)."""
    open_, taken = cut(pairs.select(*by, "i", "j", "d")), cut(pairs.select(*by, "i", "j", "d").limit(0))
    for _ in range(max_rounds):
        rank = F.struct("d", "i", "j")
        least_i, least_j = (F.min(rank).over(Window.partitionBy(*by, k)) for k in ("i", "j"))
        new = cut(open_.withColumns({"_i": least_i, "_j": least_j}).where((F.col("_i") == rank) & (F.col("_j") == rank)).select(*by, "i", "j", "d"))
        if new.isEmpty():
            return taken
        taken = cut(taken.union(new))
        for k in ("i", "j"):
            open_ = open_.join(new.select(*by, k), [*by, k], "left_anti")
        open_ = cut(open_)
    raise RuntimeError("matching did not settle")


def cycle_positions(successors: DataFrame, by: list[str], max_rounds: int = 64) -> DataFrame:
    """Cycles of a successor relation (by..., v, next): by..., v, loop (least member), position.

    Pointer doubling: after k rounds each node knows the least of the next 2^k members, and how far
    ahead it lies. Nodes of broken chains are left out.
    """
    s = successors.select(*by, "v", "next")
    s = s.join(s.groupBy(*by, "v").count().where("count = 1").drop("count"), [*by, "v"], "left_semi")
    state = cut(s.select(*by, "v", F.col("next").alias("to"), F.least("v", "next").alias("low"), F.when(F.col("v") < F.col("next"), 0).otherwise(1).cast("bigint").alias("ahead"), F.lit(1).cast("bigint").alias("span")))
    for _ in range(max_rounds):
        n = state.select(*by, F.col("v").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("ahead").alias("ahead2"))
        j = state.join(n, [*by, "to"])
        now = cut(j.select(*by, "v", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), F.when(F.col("low2") < F.col("low"), F.col("span") + F.col("ahead2")).otherwise(F.col("ahead")).alias("ahead"), (F.col("span") * 2).alias("span")))
        changed = now.select(*by, "v", F.col("low").alias("l2")).join(state, [*by, "v"]).where("l2 <> low").limit(1).count()
        same = now.count() == state.count()
        state = now
        if not changed and same:
            break
    size = Window.partitionBy(*by, "low")
    # "ahead" counts the steps to the least member, so the position is the loop's length less that
    return state.withColumn("n", F.count("*").over(size)).select(*by, "v", F.col("low").alias("loop"), ((F.col("n") - F.col("ahead")) % F.col("n")).alias("position"), F.col("n").alias("length"))
