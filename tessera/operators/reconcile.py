"""Scans against predictions by name: every row of either side once, with the reason it is used or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What can be said of a row, the first that holds. A matched row is used.
REASONS = ("repeated", "held_out", "no_scan", "no_prediction", "scan_error", "prediction_error", "length", "matched")


def _sides(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is theirs alone, and the others (null keys among them), which name no single scan."""
    r = rows.select(F.col(key).alias("key"), F.col("n").alias(f"{name}_n"), F.col("error").alias(f"{name}_error"))
    shared = r.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1 OR key IS NULL").select(F.col("key").alias("_shared"))
    same = F.col("key").eqNullSafe(F.col("_shared"))
    return r.join(shared, same, "left_anti"), r.join(shared, same, "left_semi")


def reconcile(scans: DataFrame, predictions: DataFrame, key: str, held_out: DataFrame | None = None) -> DataFrame:
    """key, scan_n, scan_error, prediction_n, prediction_error, side (both, scan or prediction), reason.

    Both tables: key, n (vertices, labels; null: not to be compared) and error (null: none).
    ``held_out``: keys to be kept from use. Rows that share their key within a table aren't joined,
    since each would meet all of the other side's: each is a row with the reason ``repeated``, and so
    is a row without key.
    """
    s, s_more = _sides(scans, key, "scan")
    p, p_more = _sides(predictions, key, "prediction")
    s, p = s.withColumn("_s", F.lit(True)), p.withColumn("_p", F.lit(True))
    both = s.join(p, "key", "full")
    side = F.when(F.col("_s") & F.col("_p"), "both").when(F.col("_s"), "scan").otherwise("prediction")
    both = both.withColumn("side", side)
    if held_out is not None:
        both = both.join(held_out.select(F.col(key).alias("key")).distinct().withColumn("_held", F.lit(True)), "key", "left")
    else:
        both = both.withColumn("_held", F.lit(None).cast("boolean"))
    # a row whose counterpart is repeated has none to be compared with
    reason = (
        F.when(F.col("_held"), "held_out").when(F.col("side") == "prediction", "no_scan").when(F.col("side") == "scan", "no_prediction")
        .when(F.col("scan_error").isNotNull(), "scan_error").when(F.col("prediction_error").isNotNull(), "prediction_error")
        .when(F.col("scan_n") != F.col("prediction_n"), "length").otherwise("matched")
    )
    columns = ["key", "scan_n", "scan_error", "prediction_n", "prediction_error", "side", "reason"]
    out = both.withColumn("reason", reason).select(*columns)
    for more, name in ((s_more, "scan"), (p_more, "prediction")):
        out = out.unionByName(more.withColumns({"side": F.lit(name), "reason": F.lit("repeated")}), allowMissingColumns=True)
    return out.select(F.col("key").alias(key), *columns[1:])


def counts(reconciled: DataFrame) -> DataFrame:
    """reason, n, in rows; reasons that no row has are left out."""
    return reconciled.groupBy("reason").agg(F.count("*").alias("n"))

