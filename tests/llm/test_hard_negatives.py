import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, r int, a int, held int, k int"


def vectors(n=400, dim=6, seed=2):
    r = random.Random(seed)
    around = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [x + r.gauss(0, 0.6) for x in around[i % 4]], i % 4 if r.random() < 0.8 else r.randrange(10)) for i in range(n)]


def brute(rows, positives=5, negatives=3):
    from struct import pack, unpack

    single = lambda x: unpack("f", pack("f", x))[0]
    used = []
    for n, (i, v, y) in enumerate(rows):
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((n, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * single(x)) for x in v]))
    out, last = [], 1 << 62
    for n, i, y, v in used:
        if i is None or i % 50:
            continue
        s = sorted((-sum(map(int.__mul__, v, w)), last if j is None else j, z) for m, j, z, w in used if m != n and len(w) == len(v))
        for p, j, z in [x for x in s if x[2] == y][:positives]:
            fit = [(-t, k) for t, k, x in s if x != y and 50 * -p <= 100 * -t <= 95 * -p][:negatives]
            out += [(i, None if j == last else j, k, None if b == last else b, -p, t) for k, (t, b) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)
    e = hn.quantised(df)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hn.mine(e.withColumn("label", label), F.col("vec_id") % 50 == 0).collect()), key=repr)


@pytest.mark.parametrize("cell", [8192, 37])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(hn, "ROWS", cell)
    monkeypatch.setattr(hn, "ANCHORS", max(2, cell // 10))
    rows = vectors()
    assert len(brute(rows)) > 50
    assert mined(spark, rows) == brute(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 16)
    inf, nan = math.inf, math.nan
    v = vectors(120, 3, 4)
    rows = v + v[:20] + [(100, v[3][1], 1), (100, v[3][1], 1)]  # repeats and shared ids
    rows += [(50, None, 1), (150, [1.0, None, 2.0], 1), (200, [1.0, nan, 2.0], 1), (250, [inf, 1.0, 1.0], 2), (300, v[0][1], None), (None, v[5][1], 1), (None, v[6][1], 2)]
    rows += [(350, [], 1), (351, [], 1), (352, [], 2), (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [0.5, 1.5], 3), (403, [0.5, 1.5], 3), (450, [-0.001] * 3, 5), (451, [0.0] * 3, 5)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(1 << 22)) for _ in range(4)], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_bigints_count_as_the_nearest(spark):
    top = (1 << 63) - 1
    # both components are beyond a bigint, and count as its largest; so does 2**63 - 1 times 128: over 95 %
    assert mined(spark, [(50, [1e30], 1), (51, [1e30], 1), (52, [0.5], 2)]) == []
    # 2**40 squared is beyond a bigint, 2**40 times 2**22.9 isn't
    exact = (1 << 40) * 7_500_000
    assert mined(spark, [(50, [2.0**32], 1), (51, [2.0**32], 1), (52, [7_500_000 / 256], 2)]) == [(50, 51, 1, 52, top, exact)]


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
