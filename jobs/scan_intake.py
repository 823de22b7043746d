"""Write a quality row for every scan that has arrived since the last run.

    spark-submit jobs/scan_intake.py --scans PATH --out PATH --checkpoint PATH [--config FILE]

``scans`` is a growing folder (or one file): OBJ and STL files (``"source": "files"``), or Parquet in
which a row describes a scan (``"source": "tori"``; ``columns`` are SQL expressions for the generator's
parameters and for the defects to give it). The file stream's checkpoint knows which files were
taken, so a run reads only new ones and ends when there are none left.

``out`` is Parquet, a folder per batch and status (clean, defects, error). A batch that is repeated
after a failure overwrites its own folders and no others. A scan that comes again in a later batch
has a row for each; :func:`latest` gives the last. Files that change under their name aren't taken
again, and two scans of one name in one batch are reported together, as their mesh is.

Defined cases: a file that can't be parsed is a row of status error; one without bytes gives no row, since Spark reads
no empty file; rows with
a null name or a null in a parameter are reported as errors under that name (null parameters of
defects count as false); an empty folder writes nothing and gives no rows.
"""

from __future__ import annotations

import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.operators.fixpoint import cut
from tessera.operators.quality import defects, scan_rows
from tessera.sources import corpora, mesh_io
from tessera.streaming.inbox import parsed_stream

log = logging.getLogger("jobs.scan_intake")
ROWS = (
    "mesh_id string, vertices bigint, faces bigint, components bigint, largest_vertices bigint, largest_chi bigint, largest_loops bigint, largest_genus int, largest_manifold boolean, "
    "nonmanifold_edges bigint, misoriented_edges bigint, boundary_edges bigint, nonmanifold_vertices bigint, invalid_faces bigint, duplicate_faces bigint, isolated_vertices bigint, "
    "zero_area_faces bigint, halfedge_ok boolean, error string, batch bigint, status string"
)
NAMES = [c.split()[0] for c in ROWS.split(", ")]
SIZES, FLAGS = ["nu", "nv", "big", "small"], ["lost", "repeated", "flipped", "flat", "stray", "wild"]


def _one_path(path: str) -> str:
    """A pattern that only this path matches: file streams take a single file by pattern alone."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def arriving(spark: SparkSession, scans: str, config: dict) -> DataFrame:
    if config["source"] == "files":
        return parsed_stream(spark, scans)
    rows = spark.readStream.schema(spark.read.parquet(scans).schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(_one_path(scans))
    return rows.selectExpr(*(f"{e} AS {name}" for name, e in config["columns"].items()))


def meshes(batch: DataFrame, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, errors) of a batch; errors: mesh_id, error."""
    if config["source"] == "files":
        bad = F.col("error").isNotNull() | (F.size("vertices") == 0)
        v, f = mesh_io.exploded(batch.where(~bad))
        return v, f, batch.where(bad).select("mesh_id", F.coalesce("error", F.lit("no vertices")).alias("error"))
    whole = F.lit(True)
    for c in ["mesh_id", *SIZES]:
        whole = whole & F.col(c).isNotNull()
    good = batch.where(whole).select("mesh_id", *SIZES, *(F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS)).dropDuplicates(["mesh_id"])
    v, f = corpora.damaged(good, *corpora.tori(good))
    return v, f, batch.where(~whole).select("mesh_id", F.lit("a parameter is missing").alias("error"))


def run(spark: SparkSession, scans: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    def take(batch: DataFrame, epoch: int) -> None:
        batch = cut(batch)
        v, f, errors = meshes(batch, config)
        rows = defects(scan_rows(cut(v), cut(f))).withColumn("error", F.lit(None).cast("string"))
        rows = rows.unionByName(errors.withColumn("status", F.lit("error")), allowMissingColumns=True).withColumn("batch", F.lit(epoch).cast("bigint")).select(*NAMES)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(out)
        written = spark.read.schema(ROWS).parquet(out).where(F.col("batch") == epoch).groupBy("status").count().collect()
        log.info("batch %d: read %d scans from %s, wrote %s to %s", epoch, batch.count(), scans, {r["status"]: r["count"] for r in written}, out)

    stream = arriving(spark, scans, config).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return written_rows(spark, out)


def written_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the output; none where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(out)


def latest(rows: DataFrame) -> DataFrame:
    """The row of each scan's last batch."""
    return rows.groupBy("mesh_id").agg(F.max_by(F.struct(*(c for c in NAMES if c != "mesh_id")), "batch").alias("r")).select("mesh_id", "r.*")


def main() -> None:
    a = common.arguments("scan_intake", __doc__.split("\n")[0], scans="folder in which scans arrive", out="output folder", checkpoint="folder of the stream's checkpoint")
    spark = common.start("scan_intake")
    try:
        run(spark, a.scans, a.out, a.checkpoint, a.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
