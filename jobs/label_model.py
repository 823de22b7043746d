"""Fit a label model on a seeded sample, validate it, and score every document.

    spark-submit jobs/label_model.py --documents PATH --labels PATH --out PATH [--config FILE]

Documents and labels are reconciled first: each gets the reason why it can or can't be used. Labelled
documents are dealt into folds by their ids; of the training folds' rows at most ``rows_per_class``
of each class, drawn by seed, fit a logistic model of the features that the config names as SQL
expressions over ``text``. All other figures are of all rows.

``out`` holds ``scored`` (Parquet, a folder per language), ``report`` (JSON: weight and AUCs of each
feature and of the model), ``reasons`` (JSON: rows by reason) and ``model`` (one JSON line). A rerun
over the same tables overwrites them with the same rows.

Defined cases: a null or empty text is scored on features of 0 and its label isn't used (reason
scan_error); a null label isn't used (prediction_error); documents that share their id are scored
each, their labels aren't used (repeated), nor are null ids; labels without document are only
counted; an empty language is written and read as null; one class alone, or none, is an error.
"""

from __future__ import annotations

import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.operators import learn, metrics
from tessera.operators.fixpoint import cut
from tessera.operators.reconcile import counts, reconcile
from tessera.operators.sampling import bottom_k, split_of

log = logging.getLogger("jobs.label_model")
SCORED = "doc_id bigint, reason string, fold string, sampled boolean, label int, probability double, predicted int, lang string"


def featured(documents: DataFrame, features: dict[str, str]) -> DataFrame:
    """doc_id, lang, n, error and the features, in one pass over the texts."""
    empty = F.col("text").isNull() | (F.length("text") == 0)
    values = (F.when(empty, 0.0).otherwise(F.expr(e).cast("double")).alias(name) for name, e in features.items())
    return documents.select("doc_id", "lang", F.length("text").alias("n"), F.when(empty, "no text").alias("error"), *values)


def _auc(rows: DataFrame, score: str) -> float:
    r = metrics.roc_auc(rows.withColumn("_all", F.lit(1)), score, "label", ["_all"]).first()
    return float(r["auc"]) if r else 0.5


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> DataFrame:
    names, seed = list(config["features"]), config["seed"]
    docs = cut(featured(spark.read.parquet(documents).select("doc_id", "lang", "text"), config["features"]))
    given = spark.read.parquet(labels).select("doc_id", F.col(config["label"]).cast("int").alias("label"))
    log.info("read %d documents from %s, %d labels from %s", docs.count(), documents, given.count(), labels)

    pairs = cut(reconcile(docs.select("doc_id", "n", "error"), given.select("doc_id", F.lit(None).cast("int").alias("n"), F.when(F.col("label").isNull(), "no label").alias("error")), "doc_id"))
    usable = pairs.where("reason = 'matched'").select("doc_id").join(given, "doc_id")
    fold = split_of(seed, config["folds"], "doc_id")
    named = F.when(fold.isin(config["train"]), "train").when(fold.isin(config["validation"]), "validation").otherwise("kept")
    usable = cut(usable.withColumn("fold", named))
    sample = cut(bottom_k(usable.where("fold = 'train'"), ["doc_id"], ["label"], config["rows_per_class"], seed).join(docs.select("doc_id", *names), "doc_id"))
    if sample.select("label").distinct().count() < 2:
        raise ValueError("both classes are needed among the training rows")
    model = learn.train(sample, names, "label", l2=config["l2"])

    # a reason for every document: those that share an id all have the same one
    why = pairs.where("side <> 'prediction'").groupBy("doc_id").agg(F.min("reason").alias("reason"))
    why = why.join(usable, "doc_id", "left").join(sample.select("doc_id", F.lit(True).alias("sampled")), "doc_id", "left")
    scored = docs.join(why, "doc_id", "left").select(
        "doc_id", F.coalesce("reason", F.lit("repeated")).alias("reason"), "fold", F.coalesce("sampled", F.lit(False)).alias("sampled"), "label",
        model.probability().alias("probability"), (model.probability() >= config["threshold"]).cast("int").alias("predicted"), "lang",
    )
    scored.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/scored")
    back = spark.read.schema(SCORED).parquet(f"{out}/scored")

    held = usable.where("fold = 'validation'").drop("fold").join(docs.select("doc_id", *names), "doc_id")
    rows = [(n, w, _auc(sample, n), _auc(held, n)) for n, w in zip(names, model.weights, strict=True)]
    known = back.where("fold = 'validation' OR sampled")
    rows.append(("model", model.bias, _auc(known.where("sampled"), "probability"), _auc(known.where("fold = 'validation'"), "probability")))
    spark.createDataFrame(rows, "name string, weight double, auc_train double, auc_validation double").coalesce(1).write.mode("overwrite").json(f"{out}/report")
    counts(pairs).coalesce(1).write.mode("overwrite").json(f"{out}/reasons")
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/model")
    log.info("wrote %d scored documents to %s; sample of %d rows, validation AUC %.4f", back.count(), out, sample.count(), rows[-1][3])
    return back


def main() -> None:
    a = common.arguments("label_model", __doc__.split("\n")[0], documents="Parquet of doc_id, lang, text", labels="Parquet of doc_id and the label", out="output folder")
    spark = common.start("label_model")
    try:
        run(spark, a.documents, a.labels, a.out, a.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
