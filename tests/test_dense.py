"""Dense points: nearest, matching and suppression don't make all pairs, and give what all pairs give."""

import math
import random

import pytest

from tessera.operators import metrics


def _points(seed, n, spread):
    rng = random.Random(seed)
    return [(k % 2, k, *(rng.gauss(0, spread) for _ in "xyz"), rng.randrange(20) / 4) for k in range(n)]


def _table(spark, points, name):
    return spark.createDataFrame(points, f"g int, {name} long, x double, y double, z double, score double")


def _d(p, q):
    return math.sqrt(sum((a - b) * (a - b) for a, b in zip(p[2:5], q[2:5], strict=True)))


@pytest.fixture
def pairs_made(monkeypatch):
    """Rows of every cell join that within gives."""
    made, within = [], metrics.within

    def counted(*a, **k):
        out = within(*a, **k)
        made.append(out.count())
        return out

    monkeypatch.setattr(metrics, "within", counted)
    return made


def test_nearest_and_matching(spark, pairs_made):
    a, b = _points(1, 300, 0.1), _points(2, 300, 0.1) + [(0, 999, 5.0, 5.0, 5.0, 0.0)]
    ta, tb = _table(spark, a, "i").cache(), _table(spark, b, "j").cache()
    got = {(r.g, r.i): (r.j, r.d) for r in metrics.nearest(ta, tb, ["g"], 0.5).collect()}
    want = {p[:2]: min((_d(p, q), q[1]) for q in b if q[0] == p[0])[::-1] for p in a}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    got = {tuple(r) for r in metrics.matched_within(ta, tb, 0.5, ["g"]).select("g", "i", "j").collect()}
    near, used, want = sorted((_d(p, q), p[1], q[1], p[0]) for p in a for q in b if p[0] == q[0] and _d(p, q) <= 0.5), set(), set()
    for _, i, j, g in near:
        if (0, i) not in used and (1, j) not in used:
            used |= {(0, i), (1, j)}
            want.add((g, i, j))
    assert got == want
    assert max(pairs_made) < len(near) / 4  # all of them would be len(near)


def test_suppression(spark, pairs_made):
    p = _points(3, 300, 0.4)
    got = {tuple(r) for r in metrics.suppressed_within(_table(spark, p, "v"), 0.5, ["g"]).collect()}
    kept = []
    for q in sorted(p, key=lambda q: (-q[5], q[1])):
        if all(q[0] != k[0] or _d(q, k) >= 0.5 for k in kept):
            kept.append(q)
    assert got == {k[:2] for k in kept} and not pairs_made
    assert metrics.suppressed_within(_table(spark, p, "v").limit(0), 0.5, ["g"]).isEmpty()
