"""Spatial joins, boundary and detection metrics, statistics of evaluation runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.picks import quantile_index

from .fixpoint import cut, greedy_match


def distance(a: str, b: str, dims: str = "xyz") -> Column:
    return F.sqrt(sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in dims), F.lit(0.0)))


def within(left: DataFrame, right: DataFrame, radius: float, by: list[str], dims: str = "xyz") -> DataFrame:
    """Pairs (by..., i, j, d) of points (by..., i / j, coordinates) at most ``radius`` apart.

    The right side is entered into its own and all neighbouring cells of a grid of the radius, so
    the join is on a cell and nothing is compared beyond neighbours.
    """
    steps = None
    for _ in dims:
        steps = [(s,) for s in (-1, 0, 1)] if steps is None else [(*p, s) for p in steps for s in (-1, 0, 1)]
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*(F.struct(*((cell(c) + s).alias("c" + c) for c, s in zip(dims, p, strict=True))) for p in steps)))
    r = right.select(*by, "j", *(F.col(c).alias("q" + c) for c in dims), near.alias("cell")).select(*by, "j", *("q" + c for c in dims), "cell.*")
    l = left.select(*by, "i", *(F.col(c).alias("p" + c) for c in dims), *(cell(c).alias("c" + c) for c in dims))
    return l.join(r, [*by, *("c" + c for c in dims)]).withColumn("d", distance("p", "q", dims)).where(F.col("d") <= radius).select(*by, "i", "j", "d")


def first_radius(points: DataFrame, radius: float, by: list[str], dims: str = "xyz") -> float:
    """``radius`` halved until what the fullest cell holds, spread evenly, is a point a cell."""
    cells = points.groupBy(*by, *(F.floor(F.col(c) / radius).alias("c" + c) for c in dims)).count()
    most = cells.agg(F.max("count")).first()[0] or 0
    return radius / 2 ** max(0, math.ceil(math.log2(max(most, 1)) / len(dims)))


def nearest(queries: DataFrame, targets: DataFrame, by: list[str], cell: float, dims: str = "xyz") -> DataFrame:
    """by..., i, j, d of each query's nearest target; ties to the smaller j; no row without targets.

    A first pass looks within one cell, which is ``cell`` or, where targets are dense, a part of it, so that
    it holds few. Queries without a target there look within cells twice as large, and so on while any
    is left; each pass is the same cell join. The queries are entered into the neighbouring cells, since they get fewer.
    """
    left, radius, found = queries, first_radius(targets, cell, by, dims), None
    some = targets.select(*by).distinct()
    left = left.join(some, by, "left_semi") if by else left
    across = targets.withColumnRenamed("j", "i")
    for _ in range(64):
        pairs = within(across, left.withColumnRenamed("i", "j"), radius, by, dims)
        hit = pairs.groupBy(*by, F.col("j").alias("q")).agg(F.min(F.struct("d", F.col("i").alias("j"))).alias("s"))
        hit = cut(hit.select(*by, F.col("q").alias("i"), "s.j", "s.d"))
        found = hit if found is None else found.union(hit)
        left = cut(left.join(hit.select(*by, "i"), [*by, "i"], "left_anti"))
        if left.isEmpty():
            return found
        radius *= 2
    raise RuntimeError("nearest search did not settle")


def matched_within(left: DataFrame, right: DataFrame, radius: float, by: list[str], dims: str = "xyz") -> DataFrame:
    """Greedy one-to-one matching (by..., i, j, d) of points at most ``radius`` apart by ascending (d, i, j).

    The radius grows by doubling. All pairs within one are matched before any farther pair, as the order of distances asks,
    and only points still alone are paired within the next, so that the pairs of a dense set are never all made.
    """
    r = first_radius(right, radius, by, dims)
    found = None
    while True:
        new = greedy_match(within(left, right, r, by, dims), by)
        found = new if found is None else found.union(new)
        if r >= radius:
            return found
        left = cut(left.join(new.select(*by, "i"), [*by, "i"], "left_anti"))
        right = cut(right.join(new.select(*by, "j"), [*by, "j"], "left_anti"))
        r = min(2 * r, radius)


def suppressed_within(points: DataFrame, radius: float, by: list[str], dims: str = "xyz", max_rounds: int = 1000) -> DataFrame:
    """Greedy non-maximum suppression as rounds: by..., v of the points kept, none closer than ``radius`` to a better one kept.

    ``points``: by, v, score, coordinates. Ties of score go to the smaller v; a null score is the least. No pairs of
    points are made: of each cell of the radius only the best open point counts. One that none of the 26 cells around
    it beats is kept, and open points meet only those kept in a round, of which a cell has few.
    """
    steps = [()]
    for _ in dims:
        steps = [(*p, s) for p in steps for s in (-1, 0, 1)]
    cells = ["_c" + c for c in dims]
    around = F.explode(F.array(*(F.struct(*((F.col(c) + s).alias(c) for c, s in zip(cells, p, strict=True))) for p in steps))).alias("_n")
    rank = F.struct(F.col("score").alias("s"), (-F.col("v")).alias("v")).alias("rank")
    open_ = cut(points.select(*by, "v", *dims, rank, *(F.floor(F.col(c) / radius).alias("_c" + c) for c in dims)))
    kept = None
    for _ in range(max_rounds):
        best = open_.groupBy(*by, *cells).agg(F.max(F.struct("rank", "v", *dims)).alias("b"))
        best = cut(best.select(*by, *cells, "b.*"))
        if best.isEmpty():
            return kept.select(*by, "v") if kept is not None else points.select(*by, "v").limit(0)
        near = best.select(*by, "rank", around).select(*by, "_n.*", "rank").groupBy(*by, *cells).agg(F.max("rank").alias("top"))
        new = cut(best.join(near, [*by, *cells]).where(F.col("rank") == F.col("top")).drop("top"))
        kept = new if kept is None else kept.unionByName(new)
        by_cell = new.select(*by, *(F.col(c).alias("q" + c) for c in dims), around).select(*by, *("q" + c for c in dims), "_n.*")
        p = open_.select(*by, "v", *cells, *(F.col(c).alias("p" + c) for c in dims))
        out = p.join(by_cell, [*by, *cells]).where(distance("p", "q", dims) < radius).select(*by, "v")
        done = out.union(new.select(*by, "v")).distinct()
        open_ = cut(open_.join(done, [*by, "v"], "left_anti"))
    raise RuntimeError("suppression did not settle")


def boundary_metrics(predicted: DataFrame, truth: DataFrame, by: list[str], cell: float = 0.5, dims: str = "xyz") -> DataFrame:
    """by..., assd, hd95, f1_025, f1_050 of two point sets (by..., i or j, coordinates)."""
    p = nearest(predicted, truth.withColumnRenamed("i", "j"), by, cell, dims).select(*by, F.lit("p").alias("side"), "d")
    t = nearest(truth, predicted.withColumnRenamed("i", "j"), by, cell, dims).select(*by, F.lit("t").alias("side"), "d")
    d = p.union(t)
    q95 = quantile_index(d, "d", 0.95, [*by, "side"], "q").groupBy(*by).agg(F.max("q").alias("hd95"))
    share = lambda s, x: F.avg(F.when(F.col("side") == s, (F.col("d") <= x).cast("double")))
    f1 = {n: F.coalesce(F.try_divide(2 * share("p", x) * share("t", x), share("p", x) + share("t", x)), F.lit(0.0)) for n, x in (("f1_025", 0.25), ("f1_050", 0.5))}
    return d.groupBy(*by).agg(F.avg("d").alias("assd"), *(e.alias(n) for n, e in f1.items())).join(q95, by)


def region_iou(labels: DataFrame, by: list[str]) -> DataFrame:
    """Area-weighted intersection over union of columns pred and truth (0/1); 1 if both are empty."""
    both = F.sum(F.when((F.col("pred") == 1) & (F.col("truth") == 1), F.col("area")).otherwise(0.0))
    any_ = F.sum(F.when((F.col("pred") == 1) | (F.col("truth") == 1), F.col("area")).otherwise(0.0))
    return labels.groupBy(*by).agg(F.coalesce(F.try_divide(both, any_), F.lit(1.0)).alias("iou"))


def match_counts(detections: DataFrame, truths: DataFrame, tolerance: float, by: list[str], dims: str = "xyz") -> DataFrame:
    """by..., tp, fp, fn by greedy one-to-one matching within a tolerance."""
    tp = matched_within(detections, truths, tolerance, by, dims).groupBy(*by).agg(F.count("*").alias("tp"))
    nd, nt = detections.groupBy(*by).agg(F.count("*").alias("nd")), truths.groupBy(*by).agg(F.count("*").alias("nt"))
    r = nd.join(nt, by, "full").join(tp, by, "left").fillna(0, ["nd", "nt", "tp"])
    return r.select(*by, "tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))


def micro_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    """Pool tp, fp, fn, then divide; 0 where nothing was found or expected."""
    s = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = (F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(x)).cast("double")), F.lit(0.0)) for x in ("fp", "fn"))
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve with tie-averaged ranks; 0.5 if a class is empty.

    Ranks come from counts per distinct score, so a window runs over distinct scores only.
    """
    per = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    w = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_rank", F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2.0)
    s = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_p").alias("p"), F.sum(F.col("_rank") * F.col("_p")).alias("r"))
    n = F.col("n") - F.col("p")
    return s.select(*by, F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * n), F.lit(0.5)).alias("auc"))


def paired_t(a: DataFrame, b: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """by..., n, mean_diff, se, t, wins, losses, big_losses of b against a on shared keys (lower is better)."""
    j = a.select(*by, *key, F.col(value).alias("_a")).join(b.select(*by, *key, F.col(value).alias("_b")), [*by, *key]).withColumn("d", F.col("_b") - F.col("_a"))
    s = j.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.avg(F.col("d") * F.col("d")).alias("_m2"), F.count_if(F.col("d") < -1e-9).alias("wins"), F.count_if(F.col("d") > 1e-9).alias("losses"), F.count_if(F.col("d") > 0.1).alias("big_losses"))
    se = F.sqrt(F.try_divide(F.greatest(F.col("_m2") - F.col("mean_diff") * F.col("mean_diff"), F.lit(0.0)), (F.col("n") - 1).cast("double")))
    return s.withColumn("se", se).withColumn("t", F.try_divide("mean_diff", "se")).drop("_m2")


def grouping_pairs(items: DataFrame, truth: str, group: str, by: list[str]) -> DataFrame:
    """How well groups recover what they should, from counts per (truth, group) alone: no pair is ever made.

    by..., items, on_background (truth 0 or null), ungrouped (group null or below 0); of the others
    the pairs of one truth kept together, of one group merged though their truths differ, of one
    truth split over groups; truths, and clean ones: all their items in one group that holds no other's.
    """
    background, alone = F.coalesce(F.col(truth) == 0, F.lit(True)), F.coalesce(F.col(group) < 0, F.lit(True))
    cells = items.withColumns({"_off": background, "_un": ~background & alone}).groupBy(*by, "_off", "_un", F.when(~background & ~alone, F.col(truth)).alias("_t"), F.when(~background & ~alone, F.col(group)).alias("_g")).agg(F.count("*").alias("_n"))
    sums = [F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(n) for n, c in (("items", F.lit(True)), ("on_background", F.col("_off")), ("ungrouped", F.col("_un")))]
    out = cells.groupBy(*by).agg(*sums)
    own = cells.where("NOT _off AND NOT _un")
    total = lambda k, n: own.groupBy(*by, k).agg(F.sum("_n").alias(n))
    c = own.join(total("_t", "_nt"), [*by, "_t"]).join(total("_g", "_ng"), [*by, "_g"])
    pairs = lambda n: (n * (n - 1) / 2).cast("bigint")
    together = F.sum(pairs(F.col("_n")))
    # summed over its cells, n (total - n) counts each pair of a truth's, or group's, different cells twice
    other = lambda n: (F.sum(F.col("_n") * (F.col(n) - F.col("_n"))) / 2).cast("bigint")
    single = F.count_if((F.col("_n") == F.col("_nt")) & (F.col("_n") == F.col("_ng")))
    found = c.groupBy(*by).agg(together.alias("together"), other("_ng").alias("merged"), other("_nt").alias("split"), F.count_distinct("_t").alias("truths"), single.alias("clean"))
    return out.join(found, by, "left").fillna(0, ["together", "merged", "split", "truths", "clean"])
