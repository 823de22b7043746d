"""Samples, reconciliation and quality rows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import quality, reconcile, sampling
from tessera.operators.model import tables
from tessera.operators.topology import valid_faces
from tessera.sources import meshes as M


def drawn(spark, rows, parts, k):
    df = spark.createDataFrame(rows, "id long, s string, extra string").repartition(parts)
    return sorted(map(tuple, sampling.bottom_k(df, ["id"], ["s"], k, seed=5).collect()), key=repr)


def test_samples_don_t_depend_on_partitions(spark):
    rows = [(i, "hot" if i % 3 else ["a", None, "b"][i % 9 // 3], "x") for i in range(500)]
    got = drawn(spark, rows, 1, 20)
    assert got == drawn(spark, rows, 13, 20)
    assert Counter(r[1] for r in got) == {"hot": 20, "a": 20, None: 20, "b": 20}
    h = lambda r: hashlib.md5(f"5|{r[0]}".encode()).hexdigest()
    for s in ("hot", "a", None, "b"):
        assert {r[0] for r in got if r[1] == s} == {r[0] for r in sorted((r for r in rows if r[1] == s), key=h)[:20]}


def test_small_strata_null_keys_repeats_and_no_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (2, "b", "x")]
    assert len(drawn(spark, rows, 2, 3)) == 4 and len(drawn(spark, rows, 2, 1)) == 2
    assert drawn(spark, [], 2, 3) == []


def test_shuffle_is_a_permutation_and_folds_are_even(spark):
    df = spark.range(2000)
    got = [r[0] for r in sampling.shuffled(df, ["id"], 3).collect()]
    assert got == [r[0] for r in sampling.shuffled(df.repartition(5), ["id"], 3).collect()]
    assert sorted(got) == list(range(2000)) and got != list(range(2000))
    folds = Counter(r[0] for r in df.select(sampling.split_of(1, 5, "id")).collect())
    assert set(folds) == set(range(5)) and min(folds.values()) > 330


SIDE = "stem string, n long, error string"


def test_every_row_is_accounted_for_once(spark):
    scans = [("a", 3, None), ("b", 3, None), ("c", 3, "bad"), ("d", 3, None), ("e", 3, None), ("f", 3, None), ("f", 4, None), ("g", 1, None), (None, 1, None), ("h", None, None)]
    predictions = [("a", 3, None), ("b", 4, None), ("c", 3, None), ("d", 3, "bad"), ("x", 3, None), ("f", 3, None), ("g", 1, None), ("g", 1, None), (None, 1, None), ("h", 3, None), ("held", 3, None)]
    held = spark.createDataFrame([("e",), ("held",), ("held",), ("nobody",)], "stem string")
    got = reconcile.reconcile(spark.createDataFrame(scans, SIDE), spark.createDataFrame(predictions, SIDE), "stem", held)
    rows = Counter((r["stem"], r["side"], r["reason"]) for r in got.collect())
    assert rows == {
        ("a", "both", "matched"): 1, ("b", "both", "length"): 1, ("c", "both", "scan_error"): 1, ("d", "both", "prediction_error"): 1, ("e", "scan", "held_out"): 1,
        ("f", "scan", "repeated"): 2, ("f", "prediction", "no_scan"): 1, ("g", "prediction", "repeated"): 2, ("g", "scan", "no_prediction"): 1, (None, "scan", "repeated"): 1,
        (None, "prediction", "repeated"): 1, ("x", "prediction", "no_scan"): 1, ("h", "both", "matched"): 1, ("held", "prediction", "held_out"): 1,
    }
    assert sum(n * (2 if side == "both" else 1) for (_, side, _), n in rows.items()) == len(scans) + len(predictions)
    assert {r["reason"] for r in reconcile.counts(got).collect()} <= set(reconcile.REASONS)


def test_reconciling_with_nothing(spark):
    none, one = spark.createDataFrame([], SIDE), spark.createDataFrame([("a", 1, None)], SIDE)
    assert reconcile.reconcile(none, none, "stem").count() == 0
    assert [r["reason"] for r in reconcile.reconcile(one, none, "stem").collect()] == ["no_prediction"]
    assert [r["reason"] for r in reconcile.reconcile(none, one, "stem").collect()] == ["no_scan"]


def test_a_hot_key_isn_t_multiplied(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("stem"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("error"))
    got = {r["reason"]: r["n"] for r in reconcile.counts(reconcile.reconcile(hot, hot, "stem")).collect()}
    assert got == {"matched": 2000, "repeated": 2000}


def test_quality_rows_of_known_meshes(spark):
    shapes = {"torus": M.torus(12, 6), "defects": M.defect_showcase(), "mobius": M.mobius(8), "corner": M.grid_with_holes(4, 4, [(1, 1), (2, 2)]), "two": M.append(M.icosphere(0), M.torus(12, 6))}
    v, f = tables(spark, shapes)
    bare = spark.createDataFrame([("bare", 0, 0.0, 0.0, 0.0)], v.schema)
    got = {r["mesh_id"]: r for r in quality.defects(quality.scan_rows(v.union(bare), f)).collect()}
    t = got["torus"]
    assert (t["vertices"], t["faces"], t["largest_genus"], t["status"], t["halfedge_ok"], t["zero_area_faces"]) == (72, 144, 1, "clean", True, 0)
    d = got["defects"]
    assert (d["invalid_faces"], d["duplicate_faces"], d["isolated_vertices"], d["nonmanifold_vertices"], d["nonmanifold_edges"], d["misoriented_edges"], d["boundary_edges"]) == (1, 1, 1, 1, 1, 4, 45)
    assert got["mobius"]["largest_genus"] is None and got["mobius"]["status"] == "defects"
    assert got["corner"]["nonmanifold_vertices"] == 1 and got["corner"]["halfedge_ok"]
    assert (got["two"]["components"], got["two"]["largest_vertices"], got["two"]["largest_chi"]) == (2, 72, 0)
    b = got["bare"]
    assert (b["vertices"], b["faces"], b["components"], b["largest_vertices"], b["isolated_vertices"], b["status"]) == (1, 0, 0, None, 1, "defects")


def test_faces_that_name_no_vertex_are_invalid_where_ids_have_gaps(spark):
    r = random.Random(1)
    v = spark.createDataFrame([("m", i, r.random(), 0.0, 0.0) for i in (0, 1, 2, 5)], "mesh_id string, v long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 1, 3), ("m", 2, 0, 2, 5), ("m", 3, 0, 2, 6), ("m", 4, 1, 1, 2), ("o", 0, 0, 1, 2)], "mesh_id string, f long, v0 long, v1 long, v2 long")
    assert sorted(map(tuple, valid_faces(f, v).select("mesh_id", "f").collect())) == [("m", 0), ("m", 2)]


def test_grouping_pairs_equal_enumeration(spark):
    from tessera.operators.metrics import grouping_pairs

    r = random.Random(4)
    items = [(g, r.choice([0, 1, 2, 3, None]) if g != "clean" else i % 3 + 1, r.choice([-1, 0, 1, 2, None]) if g != "clean" else i % 3) for g in ("a", "b", "clean") for i in range(60)] + [("none", 0, 1), ("none", 1, -1)]
    got = {row["g"]: row.asDict() for row in grouping_pairs(spark.createDataFrame(items, "g string, t int, c int"), "t", "c", ["g"]).collect()}
    for g, row in got.items():
        mine = [(t, c) for x, t, c in items if x == g]
        used = [(t, c) for t, c in mine if t and c is not None and c >= 0]
        pairs = [(a, b) for i, a in enumerate(used) for b in used[i + 1 :]]
        groups, truths = {t: {c for x, c in used if x == t} for t, _ in used}, {c: {t for t, x in used if x == c} for _, c in used}
        assert row == {
            "g": g, "items": len(mine), "on_background": sum(not t for t, _ in mine), "ungrouped": sum(bool(t) and (c is None or c < 0) for t, c in mine),
            "together": sum(a == b for a, b in pairs), "merged": sum(a[0] != b[0] and a[1] == b[1] for a, b in pairs), "split": sum(a[0] == b[0] and a[1] != b[1] for a, b in pairs),
            "truths": len(groups), "clean": sum(len(cs) == 1 and len(truths[min(cs)]) == 1 for cs in groups.values()),
        }
    assert got["clean"]["clean"] == 3
