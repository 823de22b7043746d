import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

from .data import awkward, frame, prose


def water(sizes, weights, budget, repeats):
    """Targets by resharing until none is above its limit."""
    open_, target, left = set(sizes), {}, budget
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = repeats * sizes[s]
        left = budget - sum(target.values())
        open_ -= over
    return target


def brute(rows, weights, repeats=3, seed=1):
    """doc_id, size, source_size, target, taken by one sorted list of all entries."""
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, _ in rows]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in docs if x == s) for s in names}
    target = water(size, {s: weights[k % len(weights)] for k, s in enumerate(names)}, sum(size.values()), repeats)
    seen, order = Counter(), []
    for d in docs:
        i, k = d[0], seen[d]
        seen[d] += 1
        order.append((names.index(d[1]), hashlib.md5(f"{seed}|{'' if i is None else i}|{k}".encode()).hexdigest(), d, k))
    entries, before = [], Counter()
    for epoch in range(repeats):
        for r, _, d, k in sorted(order, key=lambda x: x[:2]):
            start, goal = before[r], int(target[d[1]])
            before[r] += d[2]
            if d[2] and start < target[d[1]]:
                cut = [start, goal, before[r]] if start < goal < before[r] else [start, before[r]]
                entries += [((b / target[d[1]], r, a), b - a, (d, k)) for a, b in zip(cut, cut[1:])]
    taken, used, budget = Counter(), 0, sum(size.values())
    for _, n, doc in sorted(entries):
        taken[doc] += min(n, budget - used)
        used += min(n, budget - used)
    return sorted(((d[0], d[2], size[d[1]], float(target[d[1]]), taken[d, k]) for _, _, d, k in order), key=repr)


def rows_of(spark, rows, **options):
    docs = frame(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    placed = mixing.placed(docs, **options)
    return placed, mixing.mix(placed)


def totals(spark, rows, **options):
    got = mixing.document_totals(*rows_of(spark, rows, **options)).select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("bucket", [16384, 2])
def test_awkward_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = awkward() + [(None, prose(5), "en", "b", 1), (20, prose(6), "en", None, 1), (21, prose(7, 9), "en", "é", 1), (22, prose(8, 5), "en", "z", 1)]
    got = totals(spark, rows)
    assert [(a[:3], a[4]) for a in got] == [(b[:3], b[4]) for b in brute(rows, (5, 2, 1))]
    assert [a[3] for a in got] == pytest.approx([b[3] for b in brute(rows, (5, 2, 1))])


def test_targets_are_met_and_the_budget_is_used(spark):
    rows = [(i, prose(i, 20 + i % 90), "en", f"s{i % 7 * (i % 3)}", 1) for i in range(400)] + [(1000, prose(3, 5000), "en", "s0", 1)]
    got = rows_of(spark, rows)
    by = mixing.document_totals(*got).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert sum(r["n"] for r in by) == sum(len(t.split()) for _, t, *_ in rows)
    assert all(abs(r["n"] - r["t"]) <= len(by) and r["over"] <= 0 for r in by)
    # the mix is one gapless sequence, in order of finish times
    mix = got[1].orderBy("position").collect()
    assert all(a["position"] + a["taken"] == b["position"] and a["finish"] <= b["finish"] for a, b in zip(mix, mix[1:]))


def test_every_part_of_the_mix_has_the_targets_shares(spark):
    rows = [(i, prose(i, 20), "en", "ab"[i % 2], 1) for i in range(600)]
    placed, mix = rows_of(spark, rows, weights={"a": 2, "b": 1})
    half = mix.where("position < 6000").groupBy("source").agg(F.sum("taken")).collect()
    assert dict(map(tuple, half))["a"] == pytest.approx(4000, abs=40)


def test_smaller_budget_and_reruns(spark):
    rows = [(i, prose(i, 10 + i % 50), "en", f"s{i % 4}", 1) for i in range(100)] * 2
    docs = frame(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))

    def run(df):
        placed = mixing.placed(df, budget=1500)
        return sorted(map(tuple, mixing.document_totals(placed, mixing.mix(placed, budget=1500)).collect()))

    got = run(docs)
    assert got == run(docs.repartition(7)) and sum(r[4] for r in got) == 1500


def test_word_count(spark):
    texts = [None, "", " \t\r\n\x0b\x0c", "a", " a b  c\n😀 ", "x " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")))
    assert [r[0] for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_empty(spark):
    assert totals(spark, []) == []
    assert totals(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
