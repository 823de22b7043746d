from collections import Counter

from tessera.llm import packing, token_counts
from tessera.llm.common import shared_path

from .data import awkward, frame

CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long, extra int"


def change(op, key=(None, None, None), n=None, old=(None, None, None), m=None):
    return (op, *key, n, *old, m, 0)


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()}


def test_signed_batches_commit_once_in_any_order(spark):
    a, b = ("s", "en", "t@1"), (None, "de", "t@1")
    load = spark.createDataFrame([change("insert", a, 10), change("insert", a, 5), change("insert", b, None), change("insert", b, 7)], CHANGE)
    take = spark.createDataFrame([change("delete", old=a, m=10), change("revise", b, 9, old=b, m=7), change("revise", a, 5, old=b, m=0)], CHANGE)
    ledger = token_counts.Ledger(spark, shared_path(spark, "ledger"))
    assert totals(ledger) == {}
    assert ledger.apply("2", take) and ledger.apply("1", load)
    want = {a: (2, 10), b: (1, 9)}
    assert totals(ledger) == want
    assert not ledger.apply("1", load) and totals(ledger) == want
    ledger.compact()
    assert totals(ledger) == want
    assert not ledger.apply("2", take) and totals(ledger) == want
    assert ledger.apply("3", spark.createDataFrame([change("delete", old=b, m=9)], CHANGE))
    ledger.compact()
    assert totals(ledger) == {a: (2, 10)}
    assert ledger.apply("4", load.limit(0)) and totals(ledger) == {a: (2, 10)}


def test_a_batch_cut_short_is_written_again(spark):
    folder = shared_path(spark, "ledger")
    load = spark.createDataFrame([change("insert", ("s", "en", "t@1"), 10)], CHANGE)
    ledger = token_counts.Ledger(spark, folder)
    load.write.parquet(f"{folder}/batch-1")
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{folder}/batch-1/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert totals(ledger) == {}
    assert ledger.apply("1", load) and totals(ledger) == {("s", "en", "t@1"): (1, 10)}


def test_counts(spark):
    got = token_counts.counts(frame(spark), **packing.production()).collect()
    ids = packing.load_ids(**packing.production())
    want = Counter((i, len((t or "").split()), len(ids.own(t or "")), len(ids.own(" ".join((t or "").split())))) for i, t, *_ in awkward() if i != 9)
    assert Counter((r["id"], r["n_words"], r["n_ids"], r["n_ids_squeezed"]) for r in got if r["id"] != 9) == want
    assert token_counts.counts(frame(spark, []), **packing.production()).count() == 0
