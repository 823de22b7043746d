"""Minimum cuts of all graphs at once: push-relabel in phases of exact distances and level-wise moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut

#: Levels between two writes of what a search has seen.
LEVELS = 16


def minimum_cut(terminals: DataFrame, edges: DataFrame, by: list[str], max_phases: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(sides, values) of a minimum cut between source and sink, one graph for each value of ``by``.

    ``terminals``: by, v, source, sink (capacities from the source to v and from v to the sink);
    ``edges``: by, u, v, cap (directed). Capacities are whole numbers, summed where they repeat, null
    counts as 0, and one below 0 is an error; real ones have to be scaled first. Loops have no effect,
    ends without terminals are nodes as well. ``sides``: by, v, source_side, of the cut with the fewest
    nodes on the source's side, which is unique; ``values``: by, value.

    What the sink asks for starts as demand at its neighbours and goes back over arcs with capacity left.
    A phase relabels all nodes with their exact distance from the source, in one search over all graphs,
    then settles demand from the farthest level to the nearest, so that a node passes on once a phase
    what it holds. What a node can't pass on stays until the next phase finds it farther away. A graph
    leaves the loop when no node with demand is within reach; those within reach are the source's side.

    Levels and phases are written. Rounds grow with the longest shortest path from a source, not
    with the number of graphs or nodes. Source and sink are columns and so no hubs; the arcs of any other
    node that holds demand are ordered in one task, which streams over them.
    """
    if not terminals.where("source < 0 OR sink < 0").isEmpty() or not edges.where("cap < 0").isEmpty():
        raise ValueError("a capacity is below 0")
    whole, zero = "bigint", F.lit(0).cast("bigint")
    ways = F.array(F.struct(F.col("u"), F.col("v"), F.coalesce(F.col("cap").cast(whole), zero).alias("r")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), zero.alias("r")))
    arcs = cut(edges.where("u <> v").select(*by, F.explode(ways).alias("a")).select(*by, "a.*").groupBy(*by, "u", "v").agg(F.sum("r").alias("r")))
    ends = edges.select(*by, F.explode(F.array("u", "v")).alias("v")).where("v IS NOT NULL").distinct().select(*by, "v", zero.alias("source"), zero.alias("sink"))
    given = terminals.where("v IS NOT NULL").select(*by, "v", *(F.coalesce(F.col(c).cast(whole), zero).alias(c) for c in ("source", "sink")))
    node = given.unionByName(ends).groupBy(*by, "v").agg(F.sum("source").alias("source"), F.sum("sink").alias("sink"))
    through = F.least("source", "sink")
    node = cut(node.select(*by, "v", (F.col("source") - through).alias("supply"), (F.col("sink") - through).alias("demand"), through.alias("met")))

    done = []
    for _ in range(max_phases):
        state = cut(node.join(_distances(node, arcs, by), [*by, "v"], "left"))
        open_ = cut(state.where("demand > 0 AND h IS NOT NULL").groupBy(*by).agg(F.max("h").alias("top")))
        done.append(state.join(open_, by, "left_anti").select(*by, "v", F.col("h").isNotNull().alias("source_side"), "met"))
        top = open_.agg(F.max("top")).first()[0]
        if top is None:
            out = cut(reduce(DataFrame.union, done))
            return out.drop("met"), out.groupBy(*by).agg(F.sum("met").alias("value"))
        state, arcs = state.join(open_, by, "left_semi"), arcs.join(open_, by, "left_semi")
        node, arcs = _settle(cut(state), arcs, by, top)
    raise RuntimeError("cuts did not settle")


def _distances(node: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """by, v, h: arcs with capacity left on the shortest way from the source, for the nodes within reach."""
    passable = cut(arcs.where("r > 0").select(*by, "u", "v"))
    seen = level = cut(node.where("supply > 0").select(*by, "v", F.lit(1).alias("h")))
    h = 1
    while not level.isEmpty():
        h += 1
        near = passable.join(level.select(*by, F.col("v").alias("u")), [*by, "u"], "left_semi").select(*by, "v").distinct()
        level = cut(near.join(seen, [*by, "v"], "left_anti").withColumn("h", F.lit(h)))
        seen = seen.union(level)
        if h % LEVELS == 0:
            seen = cut(seen)
    return seen


def _settle(state: DataFrame, arcs: DataFrame, by: list[str], top: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs after demand has gone down the levels from ``top`` and met the supply of level 1."""
    there = state.where("h IS NOT NULL").select(*by, "v", "h")
    down = arcs.where("r > 0").join(there, [*by, "v"]).join(there.select(*by, F.col("v").alias("u"), (F.col("h") + 1).alias("h")), [*by, "u", "h"])
    down = cut(down.select(*by, "u", "v", "r", "h"))
    zero = F.lit(0).cast("bigint")
    moves, come = [], None
    for k in range(top, 0, -1):
        here = state.where(F.col("h") == k).select(*by, "v", "demand", "supply")
        if come is not None:
            here = here.join(come, [*by, "v"], "left").withColumn("demand", F.col("demand") + F.coalesce("come", zero))
        here = here.where("demand > 0")
        if k == 1:
            met = here.select(*by, "v", F.least("supply", "demand").alias("_met"))
            break
        before = F.coalesce(F.sum("r").over(Window.partitionBy(*by, "v").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), zero)
        move = down.where(F.col("h") == k).join(here, [*by, "v"]).withColumn("p", F.least("r", F.col("demand") - before))
        moves.append(cut(move.where("p > 0").select(*by, "u", "v", "p")))
        come = moves[-1].groupBy(*by, F.col("u").alias("v")).agg(F.sum("p").alias("come"))
    met = cut(met)
    went = reduce(DataFrame.union, moves) if moves else arcs.select(*by, "u", "v", F.col("r").alias("p")).limit(0)
    swap = went.select(*by, F.explode(F.array(F.struct("u", "v", (-F.col("p")).alias("r")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("p").alias("r")))).alias("a"))
    arcs = cut(arcs.select(*by, "u", "v", "r").union(swap.select(*by, "a.*")).groupBy(*by, "u", "v").agg(F.sum("r").alias("r")))
    shift = went.select(*by, F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("p").alias("d")), F.struct("v", (-F.col("p")).alias("d")))).alias("a")).select(*by, "a.*")
    shift = shift.groupBy(*by, "v").agg(F.sum("d").alias("_d"))
    node = state.drop("h").join(shift, [*by, "v"], "left").join(met, [*by, "v"], "left").fillna(0, ["_d", "_met"])
    m = F.col("_met")
    return cut(node.select(*by, "v", (F.col("supply") - m).alias("supply"), (F.col("demand") + F.col("_d") - m).alias("demand"), (F.col("met") + m).alias("met"))), arcs
