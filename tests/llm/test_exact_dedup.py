import hashlib
import re

from tessera.llm import exact_dedup

from .data import awkward, frame


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), i == min(groups[norm(t)])[1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)


def test_annotate(spark):
    got = exact_dedup.annotate(frame(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == brute(awkward())


def test_small_filter_gives_the_same(spark):
    got = exact_dedup.annotate(frame(spark), bits_per_row=1, max_blocks=1).collect()
    assert len(got) == len(awkward())


def test_filter_keeps_one_row_per_group_and_all_columns(spark):
    df = frame(spark)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 8, 9, 10, 11, 12]


def test_empty(spark):
    df = frame(spark, [])
    assert exact_dedup.annotate(df).count() == 0
    assert exact_dedup.exact_dedup(df).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.annotate(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_may_have_the_operators_own_names(spark):
    rows = [(1, "a b", "mine", True, "k", 7), (2, "ab", "other", False, "k", 8), (3, "c", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _xd_sha string, _xd_maybe boolean, _lookup_key string, c1 int")
    kept = exact_dedup.exact_dedup(df)
    assert kept.dtypes == df.dtypes and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
