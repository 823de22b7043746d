"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to ``repeats`` times. The
budget of words is shared between the sources by weight; no target passes ``repeats`` times its
source's size, and what it can't take is shared again by weight (:func:`source_targets`). An entry
of a queue has a virtual finish time, the words of its source up to and with it over the source's
target, so time 1 is where a source has given its target. The entries of all queues are sorted by
finish time and read until the budget is used up (:func:`mix`). The one document that lies across
its source's target is queued as two entries, so that a long one can't carry a source past it.

Running sums never meet in one task: the shuffled order is cut into buckets by the hash that
shuffles, the finish times into equal spans of virtual time, over which entries are spread evenly;
only the buckets' sums (one of ``BUCKET`` rows) are added up in order. The sources themselves, a row
each, are ranked in one task. Rows that repeat are counted before they shuffle.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of
its own, the last; null ids are ids like any other; rows that repeat are documents of their own,
each with its own place in the order; an empty table, or one without words, gives targets of 0;
extra columns are ignored. The order depends on ids, copies and ``seed`` alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialise

#: Rows a bucket of the shuffled order or a span of virtual time holds, about.
BUCKET = 16384
WORD = r"[^\x20\x09-\x0D]+"
_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    """Number of words, without making a list of them."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\x0b\f\r", "")).cast("bigint")


def _sum_before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*_BEFORE)), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = (5, 2, 1), budget: int | None = None, repeats: int = 3) -> DataFrame:
    """source, source_size, docs, rank (by code point, null last), weight, target (in words).

    ``sizes``: source, size, copies. ``weights`` repeat over the sources by rank, or are looked up by
    source. ``budget``: all words, if not given; where the sources can't give it, all targets are at
    their limits. With water-filling in closed form: sources by limit over weight, and the level is
    that of the first source which the level of those left doesn't fill.
    """
    ranked = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    if isinstance(weights, Mapping):
        table = [(k is None, k, v) for k, v in weights.items()]
        named = sizes.sparkSession.createDataFrame([(k, float(v)) for _, k, v in table], "w_source string, weight double")
        ranked = ranked.join(named, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    else:
        ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = materialise(ranked, "sources")
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (total or 0) if budget is None else budget
    limit = F.col("source_size") * F.lit(repeats).cast("bigint")
    s = ranked.withColumns({"limit": limit, "ratio": limit / F.col("weight")})
    order = Window.orderBy("ratio", "rank")
    used = F.coalesce(F.sum("weight").over(order.rowsBetween(*_BEFORE)), F.lit(0))
    s = s.withColumns({"level": (F.lit(budget).cast("bigint") - _sum_before("limit", order)) / (F.lit(all_weights) - used), "place": F.row_number().over(order)})
    level = s.where("limit >= weight * level").agg(F.min_by("level", "place")).first()[0]
    target = F.col("limit").cast("double")
    if level is not None:
        target = F.least(target, F.col("weight") * F.lit(level))
    return ranked.withColumn("limit", limit).withColumn("target", target).drop("limit")


def _running(rows: DataFrame, groups: list[str], order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, in order of ``bucket`` and then ``order``, within ``groups``."""
    sums = rows.groupBy(*groups, "bucket").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_offset", _sum_before("_sum", Window.partitionBy(*groups).orderBy("bucket") if groups else Window.orderBy("bucket"))).drop("_sum")
    inside = rows.withColumn("_inside", _sum_before(value, Window.partitionBy(*groups, "bucket").orderBy(*order)))
    return inside.join(sums, [*groups, "bucket"]).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")


def placed(docs: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = (5, 2, 1), budget: int | None = None, repeats: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, copy, source, rank, size, source_size, target, before: the words of the source's queue before the document.

    ``docs``: doc_id, source, size.
    """
    sized = materialise(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sized")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    targets = source_targets(sized, weights, budget, repeats).withColumn("_source", key).drop("source", "weight")
    rows = lookup(sized.withColumn("_source", key), targets, "_source").drop("_source")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    high = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("_h", h).withColumn("bucket", F.shiftright(high * F.ceil(F.col("docs") / BUCKET), 32))
    return _running(rows, ["rank"], ["_h", "doc_id", "copy", "size"], "size", "before").select("doc_id", "copy", "source", "rank", "size", "source_size", "target", "before")


def queue(rows: DataFrame, repeats: int = 3) -> DataFrame:
    """The entries of placed documents: doc_id, copy, source, rank, size, source_size, target, epoch, start, words, finish.

    ``start`` counts the words of the source's queue before the entry. Entries that start beyond
    their source's target are left out: those before them use the budget up.
    """
    e = rows.where("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(repeats)))))
    e = e.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("before")).where("start < target")
    goal, end = F.floor("target"), F.col("start") + F.col("size")
    across = (F.col("start") < goal) & (goal < end)
    part = lambda a, b: F.struct(a.alias("start"), (b - a).alias("words"))
    e = e.withColumn("_part", F.explode(F.when(across, F.array(part(F.col("start"), goal), part(goal, end))).otherwise(F.array(part(F.col("start"), end)))))
    e = e.drop("start", "before").select("*", "_part.start", "_part.words").drop("_part")
    return e.withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))


def mix(rows: DataFrame, budget: int | None = None, repeats: int = 3) -> DataFrame:
    """The entries of :func:`queue` in the mix, with ``position``, the words of the mix before them, and ``taken``, their words in it.

    ``rows``: what :func:`placed` gives, with the same budget and repeats. The last entry is cut where the budget ends.
    """
    if budget is None:
        budget = rows.agg(F.sum("size")).first()[0] or 0
    entries = materialise(queue(rows, repeats), "queue")
    spans = -(-entries.count() // BUCKET) or 1
    # entries that end beyond their target, one a source at most, lie in the last span
    entries = entries.withColumn("bucket", F.least(F.floor(F.col("finish") * spans), F.lit(spans - 1)))
    e = _running(entries, [], ["finish", "rank", "start"], "words", "position").drop("bucket")
    return e.withColumn("taken", F.least(F.col("words"), F.lit(budget).cast("bigint") - F.col("position"))).where("taken > 0")


def document_totals(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    keys = ["doc_id", "copy", "rank", "source", "size", "source_size", "target"]
    both = rows.select(*keys, F.lit(0).cast("bigint").alias("taken")).union(entries.select(*keys, "taken"))
    return both.groupBy(*keys).agg(F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken", "source")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = materialise(placed(docs), "placed")
    return document_totals(rows, mix(rows))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, r) AS o FROM s2),
s4 AS (SELECT a.*, ((SELECT sum(source_size) FROM s3) - coalesce((SELECT sum(b.cap) FROM s3 b WHERE b.o < a.o), 0))::DOUBLE / (SELECT sum(b.w) FROM s3 b WHERE b.o >= a.o)::DOUBLE AS level FROM s3 a),
l AS (SELECT arg_min(level, o) AS level FROM s4 WHERE cap >= w * level),
t AS (SELECT source, r, source_size, least(cap::DOUBLE, w * l.level) AS target FROM s4, l),
c AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS k FROM d),
h AS (SELECT c.*, r, source_size, target, md5('1|' || coalesce(doc_id::VARCHAR, '') || '|' || k) AS h FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY r ORDER BY h, doc_id, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h),
e AS (SELECT *, e.epoch * source_size + before AS start, floor(target)::BIGINT AS goal FROM p, (SELECT unnest(range(3)) AS epoch) e WHERE size > 0 AND e.epoch * source_size + before < target),
q AS (SELECT r, doc_id, k, size, target, start, CASE WHEN start < goal AND goal < start + size THEN goal ELSE start + size END - start AS words FROM e
  UNION ALL SELECT r, doc_id, k, size, target, goal, start + size - goal FROM e WHERE start < goal AND goal < start + size),
m AS (SELECT r, doc_id, k, size, words, coalesce(sum(words) OVER (ORDER BY (start + words)::DOUBLE / target, r, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM q),
x AS (SELECT r, doc_id, k, size, sum(greatest(0, least(words, (SELECT sum(size) FROM d)::BIGINT - position)))::BIGINT AS taken FROM m GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(x.taken, 0) AS taken, p.source
FROM p LEFT JOIN x ON p.r = x.r AND p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.k = x.k AND p.size = x.size
"""
