import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import scan_intake
from jobs.common import default_config
from jobs.queries import SQL
from tessera.sources import meshes as M
from tessera.sources.mesh_io import write_obj

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def rows(df, *drop):
    return sorted(map(tuple, df.drop(*drop).collect()), key=repr)


def run(spark, folder, scans, config=None):
    return scan_intake.run(spark, f"{folder}/{scans}", f"{folder}/out", f"{folder}/checkpoint", config or default_config("scan_intake"))


def test_two_runs_over_a_growing_table_give_what_one_does(spark, tmp_path):
    s = spark.read.parquet(f"{SF}/supplier.parquet").coalesce(1)
    s.where("s_suppkey < 4").write.parquet(f"{tmp_path}/in")
    first = run(spark, tmp_path, "in")
    assert {r["batch"] for r in first.collect()} == {0} and first.count() == 4
    s.where("s_suppkey >= 4").write.mode("append").parquet(f"{tmp_path}/in")
    second = run(spark, tmp_path, "in")
    assert sorted(r["batch"] for r in second.collect()) == [0] * 4 + [1] * (second.count() - 4)
    assert rows(run(spark, tmp_path, "in")) == rows(second)  # nothing new
    os.makedirs(f"{tmp_path}/other")
    whole = scan_intake.run(spark, f"{SF}/supplier.parquet", f"{tmp_path}/other/out", f"{tmp_path}/other/checkpoint", default_config("scan_intake"))
    assert rows(second, "batch") == rows(whole, "batch")


def test_a_batch_that_failed_is_taken_again_once(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/supplier.parquet").limit(3).write.parquet(f"{tmp_path}/in")

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(scan_intake.log, "info", stop)  # the rows are written, the batch isn't committed
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, "in")
    assert run(spark, tmp_path, "in").count() == 3


def test_files_as_they_arrive(spark, tmp_path):
    config = {"source": "files"}
    os.makedirs(f"{tmp_path}/in")
    put = lambda name, text: open(f"{tmp_path}/in/{name}", "w").write(text)
    put("torus.obj", write_obj(M.torus(12, 6)))
    put("broken.obj", "v 0 0 0\nf 1 2 3\n")
    first = {r["mesh_id"]: r for r in run(spark, tmp_path, "in", config).collect()}
    assert first["torus"]["status"] == "clean" and first["torus"]["largest_genus"] == 1 and first["torus"]["faces"] == 144
    assert first["broken"]["status"] == "error" and "out of range" in first["broken"]["error"]
    put("mobius.obj", write_obj(M.mobius(8)))
    put("empty.obj", "")
    got = {r["mesh_id"]: r for r in run(spark, tmp_path, "in", config).collect()}
    assert got["mobius"]["status"] == "defects" and got["mobius"]["misoriented_edges"] > 0 and got["mobius"]["batch"] == 1
    assert got["torus"] == first["torus"] and "empty" not in got  # Spark reads no empty file


def test_nulls_repeats_and_an_empty_folder(spark, tmp_path):
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    s.limit(0).write.parquet(f"{tmp_path}/none")
    assert run(spark, tmp_path, "none").count() == 0
    os.makedirs(f"{tmp_path}/b")
    two = s.limit(2).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").withColumn("mesh_id", F.lit("x"))
    two.union(two).union(spark.createDataFrame([(None, "n", None, None, "x")], two.schema)).write.parquet(f"{tmp_path}/b/in")
    got = run(spark, f"{tmp_path}/b", "in")
    assert got.count() == 3 and got.where("status = 'error' AND mesh_id IS NULL AND vertices IS NULL").count() == 1
    again = got.withColumn("batch", F.lit(7).cast("bigint")).unionByName(got)
    assert {r["batch"] for r in scan_intake.latest(again).collect()} == {7}


def test_command_line(spark, tmp_path):
    spark.read.parquet(f"{SF}/supplier.parquet").limit(2).write.parquet(f"{tmp_path}/in")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    p = subprocess.run([sys.executable, f"{ROOT}/jobs/scan_intake.py", "--scans", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/c"], env=env, capture_output=True, text=True, timeout=300, cwd="/")
    assert p.returncode == 0, p.stderr[-2000:]
    assert "read 2 scans" in p.stderr and scan_intake.written_rows(spark, f"{tmp_path}/out").count() == 2


def test_oracle_names_every_column():
    assert all(c in SQL["job2_scan_intake"] for c in scan_intake.NAMES if c not in ("error", "batch"))
