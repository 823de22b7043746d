"""Materialised intermediate tables, skew-tolerant lookups and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_live: dict[str, SparkSession] = {}  # folders made and not yet deleted
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared root. It's deleted by :func:`release`, a scope's or the process's end."""
    path = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _live:
        atexit.register(_delete, _live)
    _live[path] = spark
    return path


def _delete(paths: dict[str, SparkSession] | list[str]) -> None:
    for path in list(paths):
        spark = _live.pop(path, None)
        if spark is None:
            continue
        try:
            context = spark.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  a session that has ended leaves its folders to whoever owns the root
            continue


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    _delete([p for t in tables if (p := t.__dict__.get("_tessera_path"))])


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete what was materialised inside when the block ends or fails, but for the tables put in the list."""
    before, kept = set(_live), []
    try:
        yield kept
    except BaseException:
        kept.clear()
        raise
    finally:
        stay = before | {t.__dict__.get("_tessera_path") for t in kept}
        _delete([p for p in _live if p not in stay])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at replicated files.

    The job is named in the web page, and its shuffle files go when it has been written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    cleanup = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    spark.sparkContext.setJobDescription(name)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, cleanup)
        spark.sparkContext.setJobDescription(None)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_tessera_path"] = path
    return out


def same_but_unplaced(key: Column, kind: str) -> Column:
    """``key`` as an expression the planner can't match with an earlier placement.

    A lookup table made by groupBy(key) is already placed by key. Joining on this expression gives
    both sides plain exchanges, so that adaptive execution may split the partition of a hot key.
    """
    if kind == "bigint":
        return key.bitwiseXOR(F.lit(0).cast("bigint"))
    if kind == "binary":
        return F.concat(key, F.lit(bytearray()))
    return F.concat(key, F.lit(""))


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a table unique in ``key`` to rows in which one key may hold any share of the rows."""
    kind = dict(table.dtypes)[key]
    right = table.withColumn("_lookup_key", same_but_unplaced(F.col(key), kind)).drop(key)
    return rows.join(right, rows[key] == right["_lookup_key"], how).drop("_lookup_key")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (u, v) of bigint nodes: (node, component).

    ``component`` is the smallest node reachable. Alternating large-star and small-star rounds
    (Kiveris et al., 2014): each round replaces edges by at most as many edges towards smaller
    nodes, until every node points at its smallest. No group is ever collected.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = lookup(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, e = e, materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(last)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


_BITS = 32768


def maybe_in(rows: DataFrame, column: str, keys: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Adds ``_mb_maybe``: false only where the bigint in ``column`` surely isn't among ``keys`` (same name).

    The keys' low bits (they should be hashes) make a bitmap that is broadcast in blocks of 4 KiB.
    Its size is bounded, so with too many keys more rows are true. Rows don't shuffle.
    """
    keys = materialise(keys.select(column).distinct(), "keys")
    n, bits = keys.count(), _BITS
    while bits < 32 * n and bits < 8 * max_bytes:
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    maps = keys.select(place.alias("p")).groupBy(F.shiftrightunsigned("p", 15).alias("_mb_at")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(_BITS - 1))).alias("_mb_map"))
    j = rows.withColumn("_mb_p", place).join(F.broadcast(maps), F.shiftrightunsigned("_mb_p", 15) == F.col("_mb_at"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(_mb_map, cast((_mb_p & {_BITS - 1}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return j.withColumn("_mb_maybe", F.coalesce(F.getbit(byte, F.expr("cast(_mb_p % 8 as int)")) == 1, F.lit(False))).drop("_mb_p", "_mb_at", "_mb_map")
