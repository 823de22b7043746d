"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Defined cases: columns other than those of ``documents`` are left out; null and empty texts aren't
toxic, leave at most one of themselves after exact dedup, hold no benchmark item and pack as one
piece with the closing id alone; rows that repeat, id included, are exact copies; null ids stay as
other rows do, but in the near-duplicate stage always; an empty table gives an empty result. Texts
are read whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship_package
from tessera.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from tessera.llm.common import scope, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 stay."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    return toxicity.without_toxic(docs, toxicity.fit(docs, toxicity.training_labels(spark, sf_dir)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    return exact_dedup.exact_dedup(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more (five-word shingles) the smallest id stays."""
    ship_package(spark)
    return simhash.near_dedup(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    finder = decontaminate.fit(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), decontaminate.benchmark_items(spark, sf_dir))
    return decontaminate.without_leaks(docs, finder)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, **packing.production())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier, XXH64 fingerprints and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = shared_path(spark, f"stage-{name}")
        with scope():
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
