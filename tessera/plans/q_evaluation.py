"""Statistics of evaluation runs over the driver tables as per-scan metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.picks import capped_bucket, quantile_index, upper_median
from tessera.operators import learn, metrics
from tessera.operators.fixpoint import cut

from .registry import query, table


@query("""WITH j AS (SELECT o_orderpriority AS g, o_orderkey, o_totalprice / 1000 AS a, s.b - o_totalprice / 1000 AS d FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) / 1000 AS b FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey)
SELECT g, count(*) AS n, round(avg(d), 4) AS mean_diff, round(sqrt((avg(d * d) - avg(d) * avg(d)) / (count(*) - 1)), 4) AS se, count(*) FILTER (d < -1e-9) AS wins, count(*) FILTER (d > 1e-9) AS losses, count(*) FILTER (d > 0.1) AS big_losses FROM j GROUP BY g""")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans, their listed and summed prices as two methods' scores."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("x"))
    b = o.select("g", "o_orderkey").join(l, "o_orderkey")
    r = metrics.paired_t(o, b, ["o_orderkey"], "x", ["g"])
    return r.select("g", "n", F.round("mean_diff", 4).alias("mean_diff"), F.round("se", 4).alias("se"), "wins", "losses", "big_losses")


@query("""WITH s AS (SELECT l_shipmode_group AS g, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT l_linestatus AS l_shipmode_group, l_orderkey,
  count(*) FILTER (l_quantity > 25 AND l_tax > 0.04) AS tp, count(*) FILTER (l_quantity > 25 AND l_tax <= 0.04) AS fp, count(*) FILTER (l_quantity <= 25 AND l_tax > 0.04) AS fn FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT g, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2.0 * tp / (2.0 * tp + fp + fn), 6) AS f1 FROM s""")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per order pooled before dividing."""
    p, t = F.col("l_quantity") > 25, F.col("l_tax") > F.lit(0.04)
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("g"), "l_orderkey").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return metrics.micro_f1(c, ["g"]).select("g", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("SELECT least(n, 5) AS bucket, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def histogram_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(capped_bucket(F.col("n"), 5).alias("bucket")).agg(F.count("*").alias("orders"))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT g, max(v) FILTER (r = floor(0.95::DOUBLE * (n - 1)) + 1) AS p95, max(v) FILTER (r = floor(n / 2) + 1) AS median FROM r GROUP BY g""")
def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index quantile and upper median of order prices by priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice")
    return quantile_index(o, "o_totalprice", 0.95, ["g"], "p95").join(upper_median(o, "o_totalprice", ["g"]), "g")


@query("""WITH c AS (SELECT t, 0.02 * t AS cut FROM range(1, 6) r(t)), s AS (SELECT p_brand, t, avg(CASE WHEN l_discount <= cut + 1e-9 THEN l_quantity ELSE 0 END) AS score FROM lineitem JOIN part ON p_partkey = l_partkey, c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, p_brand) AS rank FROM s) SELECT t::INT AS t, p_brand, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def sweep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small grid of settings against all lines; the three best brands of each setting."""
    cuts = spark.range(1, 6).select(F.col("id").cast("int").alias("t"), (F.col("id") * 0.02 + 1e-9).alias("cut"))
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_quantity").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    s = l.crossJoin(F.broadcast(cuts)).groupBy("p_brand", "t").agg(F.avg(F.when(F.col("l_discount") <= F.col("cut"), F.col("l_quantity")).otherwise(0.0)).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "p_brand")))
    return r.where("rank <= 3").select("t", "p_brand", F.round("score", 4).alias("score"), "rank")


@query("""WITH d AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM d)
SELECT lang, round(coalesce((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0.5), 6) AS auc FROM r GROUP BY lang""")
def roc_auc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length ranks the good above the poor, by language; ties count half."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.roc_auc(d, "n_chars", "quality", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


@query("""WITH RECURSIVE d AS (SELECT ln(n_chars + 1.0) AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, count(*) AS n FROM d),
z AS (SELECT (x - mu) / sd AS x, y FROM d, m),
it(k, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1,
  w + (SELECT ((sum((y - p) * x) - 0.01 * n * w) * sum(p * (1 - p)) - sum(y - p) * sum(p * (1 - p) * x)) / ((sum(p * (1 - p) * x * x) + 0.01 * n) * sum(p * (1 - p)) - sum(p * (1 - p) * x) * sum(p * (1 - p) * x)) FROM (SELECT x, y, 1 / (1 + exp(-(w * x + b))) AS p FROM z)),
  b + (SELECT (sum(y - p) * (sum(p * (1 - p) * x * x) + 0.01 * n) - (sum((y - p) * x) - 0.01 * n * w) * sum(p * (1 - p) * x)) / ((sum(p * (1 - p) * x * x) + 0.01 * n) * sum(p * (1 - p)) - sum(p * (1 - p) * x) * sum(p * (1 - p) * x)) FROM (SELECT x, y, 1 / (1 + exp(-(w * x + b))) AS p FROM z))
  FROM it, m WHERE k < 12)
SELECT round(w, 4) AS weight, round(b, 4) AS bias FROM it WHERE k = 12""")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality from log length: penalised Newton steps, one aggregation each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.log(F.col("n_chars") + 1.0).alias("x")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    m = learn.train(d, ["x"], "quality")
    m = learn.Logistic.from_json(m.to_json())
    return spark.createDataFrame([(round(m.weights[0], 4), round(m.bias, 4))], "weight double, bias double")


@query("SELECT o_custkey, count(*) AS missed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY missed DESC, o_custkey LIMIT 5")
def worst_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five customers with most failed orders: a top-k report."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("missed")).orderBy(F.desc("missed"), "o_custkey").limit(5)


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS r FROM customer) SELECT c_custkey FROM r WHERE r % 7 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh scan by sorted name, the reference order being global: a sampling operator.

    Ranks within ranges plus the ranges' offsets give the global index without a single-task sort.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # written once: a second range exchange might choose other bounds, and offsets wouldn't fit ranks
    dealt = cut(c.repartitionByRange("c_name").withColumn("part", F.spark_partition_id()))
    local = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("c_name")) - 1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    return local.join(offsets, "part").where((F.col("start") + F.col("r")) % 7 == 0).select("c_custkey")
