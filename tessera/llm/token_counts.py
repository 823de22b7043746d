"""Token counts as delta-maintained rollups.

A ledger is a folder of committed batches. A batch holds only its additive part of each total: the
signed sums, by source, language and tokenizer version, of its inserts (+new), deletes (-old) and
revised counts (-old under the old key, +new under the new one). Totals are the sums of the parts
of all committed batches, so batches may arrive in any order. A batch is committed when Spark's
job commit has left its ``_SUCCESS`` mark. Applying a committed batch id again does nothing; parts
of a batch that was cut short are overwritten. :meth:`Ledger.compact` folds batches into a snapshot
that lists them, so that a late repeat of a folded batch is known too.

Defined cases: null source, language or tokenizer is a group of its own; null counts count as 0
tokens; null texts have no tokens; repeated rows count as often as they occur; a key whose documents
and tokens have all been taken back stays out of the totals; extra columns are ignored. Changes
must carry the old values, as change feeds do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, shared_path
from .packing import load_ids, production
from .textnum import bytes_of, words

KEYS = ["source", "lang", "tokenizer"]
PART = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _children(self) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _committed(self, kind: str) -> list[str]:
        return [c for c in self._children() if c.startswith(kind + "-") and self._exists(f"{self.folder}/{c}/_SUCCESS")]

    def _snapshot(self) -> tuple[str | None, set[str]]:
        done = [s for s in self._committed("members") if self._exists(f"{self.folder}/{s.replace('members', 'snapshot')}/_SUCCESS")]
        if not done:
            return None, set()
        rows = self.spark.read.schema("batch string").parquet(f"{self.folder}/{done[-1]}").collect()
        return done[-1].replace("members", "snapshot"), {r["batch"] for r in rows}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes once; False if that batch was committed before.

        ``changes``: op (insert, delete, revise), the keys, n_tokens, and for deletes and revisions
        old_source, old_lang, old_tokenizer, old_n_tokens.
        """
        name = f"batch-{batch}"
        if self._exists(f"{self.folder}/{name}/_SUCCESS") or name in self._snapshot()[1]:
            return False
        new = F.struct(*KEYS, F.lit(1).alias("docs"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("tokens"))
        old = F.struct(*(F.col(f"old_{k}").alias(k) for k in KEYS), F.lit(-1).alias("docs"), (-F.coalesce(F.col("old_n_tokens").cast("bigint"), F.lit(0))).alias("tokens"))
        signed = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(new, old))
        parts = changes.select(F.explode(signed).alias("p")).select("p.*").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        parts.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def _parts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], PART)
        return self.spark.read.schema(PART).parquet(*(f"{self.folder}/{n}" for n in names))

    def _open(self) -> tuple[list[str], set[str]]:
        snapshot, members = self._snapshot()
        fresh = [b for b in self._committed("batch") if b not in members]
        return ([snapshot] if snapshot else []) + fresh, members | set(fresh)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        parts = self._parts(self._open()[0]).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return parts.where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one snapshot; its member list commits last."""
        names, members = self._open()
        at = f"{len(self._committed('members')):08d}"
        self._parts(names).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.folder}/snapshot-{at}")
        self.spark.createDataFrame([(m,) for m in sorted(members)], "batch string").write.mode("overwrite").parquet(f"{self.folder}/members-{at}")


def counts(df: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, source, lang, n_words, n_ids, and n_ids_squeezed: the ids once white space is squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = load_ids(vocabulary, ranks, pattern)
        for b in batches:
            data, off = bytes_of(b.column(3))
            n_words = np.diff(words(data, off)[2])
            plain, squeezed = [], []
            for i, t in enumerate(b.column(3)):
                text = t.as_py() or ""
                raw = data[off[i] : off[i + 1]]
                plain.append(len(ids_of(text, raw)))
                tidy = " ".join(text.split())
                squeezed.append(plain[-1] if tidy == text else len(ids_of(tidy, np.frombuffer(tidy.encode(), np.uint8))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n_words, pa.int64()), pa.array(plain, pa.int64()), pa.array(squeezed, pa.int64())], names=["id", "source", "lang", "n_words", "n_ids", "n_ids_squeezed"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), "source", "lang", F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"id {kind}, source string, lang string, n_words bigint, n_ids bigint, n_ids_squeezed bigint")


def changes(rows: DataFrame, op: str, new: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """Changes of one kind: for each (tokenizer, column of the new count, column of the old count)."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tokenizer"), (F.col(n) if n else F.lit(None).cast("bigint")).alias("n_tokens"), (F.col(o) if o else F.lit(None).cast("bigint")).alias("old_n_tokens")) for t, n, o in new)))
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), each.alias("c")).select("*", "c.*", F.col("c.tokenizer").alias("old_tokenizer")).drop("c")


def query(spark, sf_dir: str) -> DataFrame:
    """Load all documents; delete those labelled as poor; revise the rest as white space is squeezed.

    The last batch is sent twice, as after a lost acknowledgement.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    poor = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select(F.col("doc_id").alias("id")).distinct().withColumn("poor", F.lit(True))
    known = materialise(counts(docs, **production()).join(poor, "id", "left"), "counts")
    ledger = Ledger(spark, shared_path(spark, "ledger"))
    ledger.apply("load", changes(known, "insert", [("words@1", "n_words", None), ("byte_bpe_50k@1", "n_ids", None)]))
    ledger.apply("retract", changes(known.where("poor"), "delete", [("words@1", None, "n_words"), ("byte_bpe_50k@1", None, "n_ids")]))
    revised = changes(known.where("poor IS NULL"), "revise", [("byte_bpe_50k@1", "n_ids_squeezed", "n_ids")])
    ledger.apply("squeeze", revised)
    ledger.apply("squeeze", revised)
    release(known)
    return ledger.totals()
