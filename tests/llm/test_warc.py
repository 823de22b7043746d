import gzip
import hashlib
import random

from tessera.llm import warc
from tessera.llm.common import materialise, shared_path

BIG = "<p>" + "héllo " * 40


def rows():
    return [
        (1, "http://www.B.example/x?q=1", BIG), (2, "https://b.example/x?q=1", BIG), (3, None, BIG), (4, "http://a.example/", None), (5, "http://a.example/", ""),
        (6, "http://c.example/\r\nInjected: 1", "small"), (7, "http://c.example/a", "small"), (8, "http://d.example/", "a\r\n\r\nb" * 50), (9, "http://d.example/", "x" * 300_000), (10, "nothing", BIG + "!"),
    ]


def index(spark, data, parts=3, **limits):
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(parts)
    path = shared_path(spark, "archives")
    warc.write_archives(df.withColumnRenamed("page_id", "page_id"), path)
    return path, warc.merged_index(materialise(warc.sorted_runs(spark, path), "runs"), **limits).toPandas()


def test_round_trip(spark):
    _, got = index(spark, rows())
    first = {}
    for i, _, h in rows():
        if len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    for r in got.itertuples():
        html = dict((i, h) for i, _, h in rows())[r.page_id] or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        keeper = first.get(html, r.page_id)
        assert r.record_type == ("response" if keeper == r.page_id else "revisit")
        assert (None if r.refers_to is None or r.refers_to != r.refers_to else int(r.refers_to)) == (None if keeper == r.page_id else keeper)
    assert len(got) == len(rows())


def test_history_is_globally_ordered_and_offsets_hold(spark):
    r = random.Random(1)
    data = [(i, f"http://h{r.randint(0, 3)}.example/{r.randint(0, 5)}", f"{i}" * 60) for i in range(400)]
    path, got = index(spark, data, parts=5, per_range=40)
    got = got.sort_values(["history_range", "history_position"])
    keys = list(zip(got.urlkey, got.captured, got.page_id))
    assert keys == sorted(keys) and len(keys) == 400 and got.history_range.nunique() > 4
    files = {f.path.rsplit("/", 1)[-1]: gzip.decompress(bytes(f.content)) for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()}
    for e in got.itertuples():
        record = files[e.archive][e.offset : e.offset + e.length]
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:page:{e.page_id}>".encode() in record


def test_repeated_rows_and_nulls(spark):
    _, got = index(spark, [(1, "http://a/", BIG), (1, "http://a/", BIG), (None, None, None), (2, "http://a/", BIG)], 1)
    assert sorted(got.record_type) == ["response", "response", "response", "revisit"]


def test_empty(spark):
    _, got = index(spark, [])
    assert len(got) == 0


def test_loser_tree():
    r = random.Random(4)
    runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 30))) for _ in range(9)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)
    assert list(warc.LoserTree([], lambda x: x)) == []
