"""WARC archives with revisit records, and an index merged from sorted runs by loser trees.

Writing: one record per page, composed as text and written by Spark's text sink with the WARC
record end as line separator and gzip, so commits, retries and any Hadoop store work as for other
tables. Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest
id is the response; the others become revisit records without payload.

Reading: each archive is parsed by its Content-Length headers into a run of index entries, sorted
by (URL key, time, id). Splitters from a bounded sample of keys cut all runs alike into ranges; the
slices of a range are merged by one task with a loser tree, so the ranges in order hold the capture
histories of all URLs. Ties of key and time go by id, so a hot URL is spread over ranges too.

Defined cases: null html is an empty payload; null urls give records without a target and sort
first; line breaks in urls are percent-encoded; repeated rows (same id and payload) refer to their
own id if it is the smallest: the one that is read first is the response's twin and both are
``response``; very long payloads are written whole; empty tables give an empty index; extra columns
are not archived. Ids must be integers.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, shared_path

END = "\r\n\r\n"
EPOCH = 1_577_836_800  # 2020-01-01, the time of the page with id 0
ENTRY = "urlkey string, captured string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset bigint, length bigint"
BROADCAST_ROWS = 1 << 19


def records(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One column ``value``: the whole record of each page, without its end."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    p = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`"), "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("sha"),
        F.octet_length(html).cast("bigint").alias("n"),
    )
    groups = p.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha", "first")
    groups = materialise(groups, "payloads")
    if groups.count() <= BROADCAST_ROWS:
        p = p.join(F.broadcast(groups), "sha", "left")
    else:
        p = lookup(p, groups, "sha", "left")
    revisit = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("id", F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("sha")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return p.select(F.concat(head, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, scheme and www dropped, lower case host."""
    m = re.match(r"[^:/?#]*://(?:www\d*\.)?([^/?#]*)(.*)", url or "", re.S)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2] if m else url or ""


def parse(data: bytes, archive: str) -> list[tuple]:
    """The entries of an archive, in the order of the file; offsets are those in the unpacked file."""
    out, at = [], 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:])
        body = head_end + 4
        size = int(head["Content-Length"])
        http_end = data.index(b"\r\n\r\n", body) + 4
        payload = data[http_end : body + size]
        own = re.fullmatch(r"<urn:page:(-?\d+|none)>", head["WARC-Record-ID"])[1]
        if head["WARC-Type"] == "revisit":
            n = int(re.search(rb"Content-Length: (\d+)", data[body:http_end])[1])
            digest, refers = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(r"page:(-?\d+)", head["WARC-Refers-To"])[1])
        else:
            n, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
            if "sha256:" + digest != head["WARC-Payload-Digest"]:
                raise ValueError(f"{archive}: damaged record at {at}")
        out.append((url_key(head.get("WARC-Target-URI")), re.sub(r"\D", "", head["WARC-Date"]), None if own == "none" else int(own), head["WARC-Type"], n, digest, refers, archive, at, body + size + 4 - at))
        at = body + size + 4
    return out


def order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8]


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives; the entries of an archive are sorted and stay together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for f in frames:
            for at, content in zip(f["path"], f["content"], strict=True):
                rows = sorted(parse(gzip.decompress(content), at.rsplit("/", 1)[-1]), key=order)
                out = pd.DataFrame(rows, columns=names)
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(run, ENTRY)


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, so a replacement replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.head[w := self.tree[0]] is not None:
            run = self.runs[w]
            yield run[self.at[w]]
            self.at[w] += 1
            self.head[w] = self.key(run[self.at[w]]) if self.at[w] < len(run) else None
            self._replay(w)


def merged_index(runs: DataFrame, per_range: int = 50_000, sample_rows: int = 100_000) -> DataFrame:
    """All entries with ``history_range`` and ``history_position``, which order them globally."""
    spark = runs.sparkSession
    n = runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_range))
    every = max(1, n // sample_rows)
    keys = ["urlkey", "captured", "page_id"]
    sample = runs.where(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).select(*keys).toPandas()
    found = sorted((u, c, p == p and p is not None, int(p) if p == p and p is not None else 0) for u, c, p in sample.itertuples(index=False, name=None))
    cut = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cut each run at the splitters; a slice travels as one row, still sorted."""
        for f in frames:
            out = []
            rows = f.astype(object).where(f.notna(), None)
            for archive, g in rows.groupby("archive", sort=False):
                run = list(g[names].itertuples(index=False, name=None))
                at = 0
                while at < len(run):
                    part = bisect_right(cut, order(run[at])[:4])
                    end = bisect_right(run, part, at, key=lambda r: bisect_right(cut, order(r)[:4]))
                    out.append((part, archive, json.dumps(run[at:end])))
                    at = end
            yield pd.DataFrame(out, columns=["history_range", "archive", "entries"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        slices: dict[str, list[list]] = {}
        for archive, entries in zip(f["archive"], f["entries"], strict=True):
            slices.setdefault(archive, []).append(json.loads(entries))
        # a run that was read in several batches gives several slices; they follow each other
        runs_ = [[r for part in sorted(slices[a], key=lambda part: order(part[0])) for r in part] for a in sorted(slices)]
        out = pd.DataFrame(list(LoserTree(runs_, order)), columns=names)
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out.assign(history_range=int(f["history_range"].iloc[0]), history_position=range(len(out)))

    dealt = runs.mapInPandas(deal, "history_range int, archive string, entries string")
    return dealt.groupBy("history_range").applyInPandas(merge, ENTRY + ", history_range int, history_position bigint")


def query(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    index = merged_index(materialise(sorted_runs(spark, path), "runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY s) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
