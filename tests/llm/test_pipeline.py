import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import decontaminate

from .data import awkward, frame, prose
from .test_simhash import near_classes


def plain_exact(rows):
    """Ids that stay: of equal texts without white space the longest original, then the smallest id."""
    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    return {i for _, i in best.values()}


def test_stages_against_their_operators(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "exact_dedup":
            want = plain_exact(rows)
        elif name == "simhash_near_dedup":
            want = set(near_classes(rows).values())
        else:
            want = None
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= left and (want is None or now == want)
        left = now
    leaks = {r["doc_id"] for r in decontaminate.query(spark, sf).collect()}
    assert not leaks & left
    packed = P.STAGES[4][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == left


def test_empty_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_planted_copies_and_awkward_rows(spark, tmp_path):
    r = random.Random(3)
    rows = awkward()
    for k in range(12):  # copies with one word in fifty changed, and shuffled words, which are no copies
        w = prose(900 + k, 150 + 30 * k).split()
        edited = list(w)
        for at in range(20, len(w), 60):
            edited[at] = "zz"
        r.shuffle(mixed := list(w))
        rows += [(100 + 3 * k, " ".join(w), "en", "a", 1), (101 + 3 * k, " ".join(edited), "en", "a", 1), (102 + 3 * k, " ".join(mixed), "en", "a", 1)]
    docs = frame(spark, rows)
    got = P.STAGES[1][1](spark, docs, "")
    assert got.columns == P.COLUMNS
    got.write.parquet(str(tmp_path / "exact"))
    docs = spark.read.parquet(str(tmp_path / "exact"))
    assert {x["doc_id"] for x in docs.collect()} == plain_exact([(i, t) for i, t, *_ in rows])
    kept = {x["doc_id"] for x in P.STAGES[2][1](spark, docs, "").collect()}
    for k in range(12):
        assert kept & {100 + 3 * k, 101 + 3 * k, 102 + 3 * k} == {100 + 3 * k, 102 + 3 * k}
    packed = P.STAGES[4][1](spark, docs.where(F.col("doc_id").isin(sorted(kept))), "")
    assert {x["doc_id"] for x in packed.collect()} == kept
