import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import label_model
from jobs.common import default_config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, reason string, fold string"


def tables(spark, folder, n=300, more_docs=(), more_labels=()):
    docs = [(i, ("SHOUT shout SHOUT " if i % 3 == 0 else "calm words that differ ") + f"{i} end{i % 7}", ["en", "de", None][i % 3 if i > 9 else 0], "x", "y") for i in range(n)]
    labels = [(i, int(i % 3 != 0) if i % 11 else i % 2, "z") for i in range(0, n, 2)]
    spark.createDataFrame(docs + list(more_docs), DOCS).write.parquet(f"{folder}/d")
    spark.createDataFrame(labels + list(more_labels), "doc_id long, quality int, text string").write.parquet(f"{folder}/l")
    return f"{folder}/d", f"{folder}/l"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rerun_gives_the_same_files(spark, tmp_path):
    d, l = tables(spark, tmp_path)
    config = default_config("label_model") | {"rows_per_class": 15}
    first = rows(label_model.run(spark, d, l, f"{tmp_path}/out", config))
    assert rows(label_model.run(spark, d, l, f"{tmp_path}/out", config)) == first and len(first) == 300
    assert sum(r[3] for r in first) == 30  # a full sample of each class
    assert {r[2] for r in first} == {None, "train", "validation", "kept"}
    report = {r["name"]: r for r in spark.read.json(f"{tmp_path}/out/report").collect()}
    assert report["model"]["auc_validation"] > 0.85 and set(report) == {"capitals", "repeats", "model"}
    model = json.loads(spark.read.text(f"{tmp_path}/out/model").first()[0])
    assert model["features"] == ["capitals", "repeats"]
    langs = {r["lang"] for r in spark.read.parquet(f"{tmp_path}/out/scored").select("lang").distinct().collect()}
    assert langs == {"en", "de", None}


def test_every_document_has_a_reason(spark, tmp_path):
    extra = [(1000, None, "en", "x", "y"), (1001, "", "en", "x", "y"), (1002, "twice", "en", "x", "y"), (1002, "twice", "en", "x", "y"), (None, "no id", "fr", "x", "y"), (1003, "word " * 200_000, "", "x", "y"), (1004, "null label", "en", "x", "y")]
    d, l = tables(spark, tmp_path, more_docs=extra, more_labels=[(1000, 1, "z"), (1001, 0, "z"), (1002, 1, "z"), (1004, None, "z"), (5000, 1, "z"), (None, 1, "z")])
    got = label_model.run(spark, d, l, f"{tmp_path}/out", default_config("label_model"))
    by = {(r["doc_id"], r["reason"]): r for r in got.where("doc_id >= 1000 OR doc_id IS NULL").collect()}
    assert set(by) == {(1000, "scan_error"), (1001, "scan_error"), (1002, "repeated"), (None, "repeated"), (1003, "no_prediction"), (1004, "prediction_error")}
    assert got.count() == 307 and got.where("probability IS NULL").count() == 0
    reasons = {r["reason"]: r["n"] for r in spark.read.json(f"{tmp_path}/out/reasons").collect()}
    # 1002's label and 5000's have no single document; the null ones are rows of their own
    assert reasons["no_scan"] == 2 and reasons["repeated"] == 4 and reasons["matched"] == 150


def test_one_class_is_an_error(spark, tmp_path):
    d, l = tables(spark, tmp_path)
    spark.read.parquet(l).where(F.col("quality") == 1).write.parquet(f"{tmp_path}/one")
    with pytest.raises(ValueError, match="both classes"):
        label_model.run(spark, d, f"{tmp_path}/one", f"{tmp_path}/out", default_config("label_model"))


def test_command_line(spark, tmp_path):
    d, l = tables(spark, tmp_path)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    p = subprocess.run([sys.executable, f"{ROOT}/jobs/label_model.py", "--documents", d, "--labels", l, "--out", f"{tmp_path}/out"], env=env, capture_output=True, text=True, timeout=300, cwd="/")
    assert p.returncode == 0, p.stderr[-2000:]
    assert "read 300 documents" in p.stderr and "wrote 300 scored documents" in p.stderr
    assert spark.read.parquet(f"{tmp_path}/out/scored").count() == 300
