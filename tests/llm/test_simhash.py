import random
import re

import pytest

import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components

from .data import awkward, frame, prose


def slow_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    g = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(spark):
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.simhash_groups(frame(spark)).collect()}
    assert got == {(i, slow_fingerprint(t)) for i, t, *_ in awkward()}


def test_components_against_brute_force_also_in_large_blocks(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)]
    while len(fps) < 400:  # chains of close neighbours and crowds around one centre
        fps.append(r.choice(fps[-40:]) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = list(dict.fromkeys(fps))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = union_find(len(fps), links)
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    for cap in (2, 1000):
        got = {x["node"]: x["component"] for x in components(simhash.links(nodes, 2, cap)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def near_classes(rows, size=5, similarity=0.8):
    """id -> smallest id reachable by links of Jaccard similarity, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([b" ".join(w)] if 0 < len(w) < size else (b" ".join(w[i : i + size]) for i in range(len(w) - size + 1))))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= similarity * len(a | b)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    roots = union_find(len(rows), [(place[i], place[j]) for i, j in links])
    return {rows[i][0]: rows[order[roots[place[i]]]][0] for i in range(len(rows))}


def edited(text, r, share):
    w = text.split()
    for at in r.sample(range(len(w)), max(1, round(share * len(w)))):
        w[at] = "".join(r.choice("klmnop") for _ in range(5))
    return " ".join(w)


def test_similar_groups_against_all_pairs(spark):
    r = random.Random(8)
    rows = []
    for k in range(60):
        base = prose(4000 + k, r.choice([3, 6, 12, 30, 60, 120, 250, 600, 1500]))
        for share in (0.0, 0.005, 0.01, 0.02, 0.03):
            rows.append((len(rows), edited(base, r, share) if share else base, "en", "a", 1))
    rows.append((len(rows), rows[40][1].upper(), "en", "a", 1))
    want = near_classes([(i, t) for i, t, *_ in rows])
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == want
    assert len(set(want.values())) < len(rows) - 60


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(9)
    base = prose(77, 300)
    rows = [(i, edited(base, r, 0.005), "en", "a", 1) for i in range(40)] + [(100 + i, prose(200 + i, 90), "en", "a", 1) for i in range(5)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows), bucket_cap=4).collect()}
    assert got == near_classes([(i, t) for i, t, *_ in rows])


def copies_and_decoys(r, copies, decoys):
    """Heavily edited texts with small ids around copies of one text with one word in 300 changed."""
    base = prose(78, 300)
    rows = [(i, edited(base, r, 0.06)) for i in range(decoys)] + [(1000 + i, edited(base, r, 0.0033)) for i in range(copies)]
    return [(i, t, "en", "a", 1) for i, t in rows]


@pytest.mark.parametrize(("copies", "decoys", "cap"), [(30, 12, 4), (120, 60, 64)])
def test_crowds_with_decoys_against_all_pairs(spark, monkeypatch, copies, decoys, cap):
    monkeypatch.setattr(simhash, "CROWD", 16)
    rows = copies_and_decoys(random.Random(12), copies, decoys)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows), bucket_cap=cap).collect()}
    assert got == near_classes([(i, t) for i, t, *_ in rows])
    assert len({got[1000 + i] for i in range(copies)}) == 1


def test_pairs_of_a_part_grow_as_its_members_do(spark):
    nodes = spark.createDataFrame([(i, 7, 40, [2, 4, 6]) for i in range(50)], "sid long, fp long, m long, keys array<long>")
    pairs, parts = simhash._part_links(nodes, 24, 64)
    assert sorted(tuple(r) for r in pairs.collect()) == [(0, i) for i in range(1, 50)]
    assert parts.count() == 150


def test_rows_that_share_an_id_go_by_their_text(spark):
    r = random.Random(13)
    base = prose(79, 200)
    rows = [(1, base), (5, edited(base, r, 0.005)), (5, prose(80, 200)), (None, edited(base, r, 0.005)), (1, edited(base, r, 0.005)), (6, prose(81, 50)), (6, prose(81, 50))]
    kept = [(x["doc_id"], x["text"]) for x in simhash.near_dedup(frame(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()]
    assert sum(i == 1 for i, _ in kept) == 1 and sorted(k for k in kept if k[0] not in (1, None)) == sorted([rows[2], rows[5], rows[6]]) and (None, rows[3][1]) in kept


def test_ids_of_any_type(spark):
    r = random.Random(14)
    base = prose(82, 200)
    df = spark.createDataFrame([("b", edited(base, r, 0.005)), ("a x", base), ("c", prose(83, 90)), (None, "")], "doc_id string, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(df).collect()} == {"b": "a x", "a x": "a x", "c": "c", None: None}
    assert {x["doc_id"] for x in simhash.near_dedup(df).collect()} == {"a x", "c", None}


def test_majority_in_pieces():
    import numpy as np

    h = np.random.default_rng(4).integers(0, 1 << 63, 1000, dtype=np.uint64)
    start = np.array([0, 0, 10, 400, 999, 1000])
    assert (simhash._majority(h, start, 64) == simhash._majority(h, start)).all()
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:j]) > j - i) for i, j in zip(start, [*start[1:], 1000], strict=True)]
    assert simhash._majority(h, start).tolist() == want


def test_near_dedup_keeps_one_of_each_group(spark):
    df = frame(spark)
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    ids = sorted(r["doc_id"] for r in got.collect())
    assert 1 in ids and 2 not in ids and 4 in ids and 5 not in ids and 8 in ids


def test_empty(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["component"] for r in components(e).collect()} == {0}
