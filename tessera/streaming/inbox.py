"""Report on mesh files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import topology
from tessera.sources import mesh_io


def parsed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of parsed files (see :data:`tessera.sources.mesh_io.MESH`), one row per file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                stem, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
                rows.append(mesh_io._row(stem, suffix.lower(), bytes(content)))
            yield pd.DataFrame(rows, columns=["mesh_id", "format", "error", "vertices", "faces"])

    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{obj,stl}").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select("path", "content").mapInPandas(run, mesh_io.MESH)


def report(meshes: DataFrame) -> DataFrame:
    """mesh_id, error, n_vertices, n_faces, boundary_edges, nonmanifold_edges of parsed files."""
    v, f = mesh_io.exploded(meshes)
    e = topology.edges(f).groupBy("mesh_id").agg(F.count_if(F.col("kind") == "boundary").alias("boundary_edges"), F.count_if(F.col("kind") == "nonmanifold").alias("nonmanifold_edges"))
    return meshes.select("mesh_id", "error", F.size("vertices").alias("n_vertices"), F.size("faces").alias("n_faces")).join(e, "mesh_id", "left")


def watch(spark: SparkSession, folder: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Write a report row per file to ``sink``; a batch that is repeated overwrites its own folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        report(df).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")
        df.unpersist()

    return parsed_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
