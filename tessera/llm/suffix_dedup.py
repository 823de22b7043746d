"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if some ``length``-byte string (400) that covers it starts anywhere else too.

Sparse suffixes. Of the 200-byte grams inside each 400-byte window the one with the least hash
(leftmost of equals) is the window's anchor; equal windows have equal anchors at equal offsets, so
only suffixes at anchors need sorting, about one in a hundred bytes. Anchors whose gram occurs once
can't be in a repeated window. Those are set aside by a bitmap of repeated gram hashes, made by a
count over all anchors and broadcast; its size has a bound (``max_filter_bytes``), and what passes
it by chance is only sorted in vain. An anchor's context is the 200 bytes before and 400 from it.
Equal contexts are counted by digest before anything is sorted: they are repeated as a whole. What
is sorted are the distinct contexts of grams that have several.

Merge sort. Contexts are sorted twice, as suffixes (what follows the anchor, then what precedes it
backwards) and as reversed prefixes. Each task sorts runs, cuts them at splitters from a bounded
sample and sends front-coded slices; a range's slices are merged by a loser tree that knows the
common prefix of each head with the last winner and compares only what lies beyond it. Neighbours
in the first order share the longest right part R with any other context, in the second the longest
left part L. If L + R < length no window of the anchor is repeated. If one neighbour has L and R at
once, the covered bytes are [anchor - L, anchor + R). Else the windows of that gram between these
bounds are compared as whole strings, by a count per string.

Defined cases: null texts are empty; texts under ``length`` bytes lose nothing; ends of texts are
padded with a byte that UTF-8 never has and matches never count it; repeated rows count as two
places and lose everything of ``length`` bytes or more; rows that repeat id and text give a row
each; extra columns are ignored by :func:`removed_spans`. Whole texts are read, of any length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialise, maybe_in, release, scope
from .textnum import Prefix, byte_values, bytes_of, runs_inside, sliding_min, slices

LENGTH, GRAM = 400, 200
REACH = LENGTH - GRAM  # bytes before an anchor that a window can hold
PAD = 0xFF
BITS = 32768
WINDOW_ROWS = 4096  # windows in a batch, about 2 MB


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, byte positions and gram hashes of the anchors of all windows inside rows."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none.astype(np.uint64)
    n = len(raw) - gram + 1
    g = Prefix(byte_values(raw)).span(np.arange(n), np.arange(gram, n + gram))
    bits = np.uint64(max(24, int(n).bit_length()))
    least = sliding_min((g >> bits << bits) | np.arange(n, dtype=np.uint64), length - gram + 1)
    inside = runs_inside(off, length)[: len(least)]
    at = (least[inside] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    if not len(at):
        return none, none, none.astype(np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    at = at[first]
    return np.searchsorted(off, at, "right") - 1, at, g[at]


def _ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, a hash of the text that tells rows of one id apart, and the text."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("th"), t.alias("t"))


def _bitmap(hashes: DataFrame, max_filter_bytes: int) -> np.ndarray:
    """A bitmap over the low bits of the column ``g`` (anchors have small hashes), of bounded size."""
    n, bits = hashes.count(), BITS
    while bits < 32 * n and bits < 8 * max_filter_bytes:
        bits *= 2
    place = F.col("g").bitwiseAND(F.lit(bits - 1))
    maps = hashes.select(place.alias("p")).groupBy(F.shiftrightunsigned("p", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(BITS - 1))).alias("m")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    for block, m in zip(maps["block"], maps["m"], strict=True):
        out[block * (BITS // 8) : (block + 1) * (BITS // 8)] = np.frombuffer(m, np.uint8)
    return out


def _passing(bitmap: np.ndarray, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, at, g = anchors(raw, off)
    place = (g & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    hit = np.flatnonzero((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
    return row[hit], at[hit], g[hit]


def _fixed(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _digests(raw: np.ndarray, off: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before and from each anchor that its context has, and a 16-byte digest of both parts."""
    lo, hi = np.maximum(at - REACH, off[row]), np.minimum(at + LENGTH, off[row + 1])
    p = Prefix(byte_values(raw))
    return at - lo, hi - at, np.stack([p.span(lo, at), p.span(at, hi)], axis=1).view(np.uint8).reshape(-1, 16)


def _grams(docs: DataFrame) -> DataFrame:
    """Gram hashes that occur at more than one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                _, _, g = anchors(*bytes_of(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["g"])

    return docs.where(F.octet_length("t") >= LENGTH).select("t").mapInArrow(run, "g bigint").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")


def _hits(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Anchors whose gram may be repeated: id, th, pos, g, before, behind, cid (digest of the context)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                raw, off = bytes_of(b.column(2))
                row, at, g = _passing(bitmap, raw, off)
                if len(row):
                    before, behind, cid = _digests(raw, off, row, at)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at - off[row]), pa.array(g.view(np.int64)), pa.array(before.astype(np.int32)), pa.array(behind.astype(np.int32)), _fixed(cid)], names=["id", "th", "pos", "g", "before", "behind", "cid"])

    return docs.where(F.octet_length("t") >= LENGTH).mapInArrow(run, f"id {kind}, th bigint, pos bigint, g bigint, before int, behind int, cid binary")


def _contexts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The distinct contexts of anchors whose gram may continue in several ways: cid, g, ctx (600 bytes, padded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent: set[bytes] = set()
            for b in slices(batch, "t"):
                raw, off = bytes_of(b.column(0))
                row, at, g = _passing(bitmap, raw, off)
                if not len(row):
                    continue
                cid = _digests(raw, off, row, at)[2]
                new = np.array([not (c in sent or sent.add(c)) for c in map(bytes, cid)])
                for h in np.array_split(np.flatnonzero(new), max(1, new.sum() // 4096)):
                    where = at[h][:, None] + np.arange(-REACH, LENGTH)
                    inside = (where >= off[row[h]][:, None]) & (where < off[row[h] + 1][:, None])
                    ctx = np.where(inside, raw[np.clip(where, 0, len(raw) - 1)], np.uint8(PAD))
                    yield pa.RecordBatch.from_arrays([_fixed(cid[h]), pa.array(g[h].view(np.int64)), _fixed(ctx)], names=["cid", "g", "ctx"])

    return docs.where(F.octet_length("t") >= LENGTH).select("t").mapInArrow(run, "cid binary, g bigint, ctx binary").dropDuplicates(["cid"])


def key_of(ctx: bytes, forward: bool) -> bytes:
    """The suffix at the anchor and then the bytes before it, backwards; or the reversed prefix first."""
    if forward:
        return ctx[REACH:] + ctx[:REACH][::-1]
    return ctx[: REACH + GRAM][::-1] + ctx[REACH + GRAM :]


def sides(ctx: bytes, other: bytes, lcp: int, forward: bool) -> tuple[int, int]:
    """(bytes before, bytes from the anchor) that two contexts share, given their keys' common prefix."""
    if forward:
        r = min(lcp, LENGTH)
        l = lcp - LENGTH if lcp >= LENGTH else common(ctx[:REACH][::-1], other[:REACH][::-1], 0)
    else:
        l = min(lcp, REACH + GRAM) - GRAM
        if l < 0:
            return 0, 0
        r = GRAM + (lcp - REACH - GRAM if lcp >= REACH + GRAM else common(ctx[REACH + GRAM :], other[REACH + GRAM :], 0))
    start = ctx[:REACH].rfind(b"\xff") + 1
    end = ctx.find(b"\xff", REACH)
    return min(l, REACH - start), min(r, (end if end >= 0 else len(ctx)) - REACH)


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    n = min(len(a), len(b))
    while start < n:
        x, y = a[start : start + 64], b[start : start + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return start + (m - (d.bit_length() + 7) // 8 if d else m)
        start += 64
    return n


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Common prefixes with the key before, lengths and bytes of what remains."""
    lcps, tails, last = [], [], b""
    for k in keys:
        n = common(last, k, 0)
        lcps.append(n)
        tails.append(k[n:])
        last = k
    return np.array(lcps, np.uint16).tobytes(), np.array([len(t) for t in tails], np.uint16).tobytes(), b"".join(tails)


def front_decode(lcps: bytes, sizes: bytes, tails: bytes) -> list[tuple[int, bytes]]:
    out, last, at = [], b"", 0
    for n, size in zip(np.frombuffer(lcps, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist(), strict=True):
        last = last[:n] + tails[at : at + size]
        at += size
        out.append((n, last))
    return out


class PrefixLoserTree:
    """k-way merge of sorted runs [(common prefix with the one before, key)].

    A loser keeps the length of its common prefix with the winner it lost to, which is the last one
    put out whenever its path is replayed. Of two heads with different lengths the longer is smaller,
    without a look at the keys; at equal lengths they are compared from there on.
    """

    def __init__(self, runs: list[list[tuple[int, bytes]]]):
        self.runs, self.k = runs, len(runs)
        self.at, self.lcp = [0] * self.k, [0] * self.k
        self.key: list[bytes | None] = [r[0][1] if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _replay(self, i: int) -> None:
        tree, key, lcp, node = self.tree, self.key, self.lcp, (i + self.k) // 2
        while node:
            j = tree[node]
            if j < 0:
                tree[node] = i
                return
            a, b = key[i], key[j]
            if b is None:
                pass
            elif a is None or lcp[j] > lcp[i]:
                tree[node], i = i, j
            elif lcp[j] == lcp[i]:
                n = common(a, b, lcp[i])
                if a[n : n + 1] > b[n : n + 1]:
                    tree[node], i = i, j
                lcp[tree[node]] = n
            node //= 2
        tree[0] = i

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(common prefix with the one before, run, index in it) in the order of the keys."""
        while self.k and self.key[w := self.tree[0]] is not None:
            yield self.lcp[w], w, self.at[w]
            self.at[w] += 1
            if self.at[w] < len(self.runs[w]):
                self.lcp[w], self.key[w] = self.runs[w][self.at[w]]
            else:
                self.lcp[w], self.key[w] = 0, None
            self._replay(w)


NEIGHBOUR = "cid binary, l int, r int"


def _context_of(key: bytes, forward: bool) -> bytes:
    if forward:
        return key[LENGTH:][::-1] + key[:LENGTH]
    return key[: REACH + GRAM][::-1] + key[REACH + GRAM :]


def _neighbours(distinct: DataFrame, forward: bool, per_range: int, sample_rows: int) -> DataFrame:
    """For each context and each of its two neighbours in the order: what they share (cid, l, r)."""
    spark = distinct.sparkSession
    n = distinct.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_range))
    sample = distinct.where(F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(max(1, n // sample_rows))) == 0).select("ctx").toPandas()["ctx"]
    keys = sorted(key_of(bytes(c), forward) for c in sample)
    cut = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sorted((key_of(c, forward), i) for c, i in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
            out, a = [], 0
            bounds = [bisect_left(own, (c,)) for c in cut] + [len(own)]
            for part, z in enumerate(bounds):
                if z > a:
                    out.append((part, *front_code([k for k, _ in own[a:z]]), b"".join(i for _, i in own[a:z])))
                    a = z
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "lcps", "sizes", "tails", "cids"]) if out else pa.RecordBatch.from_arrays([pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 4], names=["part", "lcps", "sizes", "tails", "cids"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        slices_ = [front_decode(*x) for x in zip(f["lcps"], f["sizes"], f["tails"], strict=True)]
        cids = [[c[k : k + 16] for k in range(0, len(c), 16)] for c in f["cids"]]
        out, last, last_id, first = [], None, None, None
        for lcp, w, i in PrefixLoserTree(slices_):
            key, cid = slices_[w][i][1], cids[w][i]
            ctx = _context_of(key, forward)
            if last is not None:
                l, r = sides(ctx, last, lcp, forward)
                out += [(cid, l, r, None), (last_id, l, r, None)]
            else:
                first = (cid, 0, 0, key)
            last, last_id, last_key = ctx, cid, key
        part = int(f["part"].iloc[0])
        rows = [(*x, part, 0) for x in out] + [(*first, part, 1), (last_id, 0, 0, last_key, part, 2)]
        return pd.DataFrame(rows, columns=["cid", "l", "r", "edge", "part", "side"])

    merged = distinct.select("cid", "ctx").mapInArrow(runs, "part int, lcps binary, sizes binary, tails binary, cids binary").groupBy("part").applyInPandas(merge, NEIGHBOUR + ", edge binary, part int, side int")
    merged = materialise(merged, "merged")
    # the last of a range and the first of the next one that isn't empty are neighbours too
    w = Window.orderBy("part", "side")
    edges = merged.where("side > 0").select("part", "side", "cid", "edge")
    met = edges.withColumns({"before": F.lag("edge").over(w), "before_id": F.lag("cid").over(w)}).where("side = 1 AND before IS NOT NULL")

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, ka, b, kb in zip(f["cid"], f["edge"], f["before_id"], f["before"], strict=True):
                l, r = sides(_context_of(bytes(ka), forward), _context_of(bytes(kb), forward), common(bytes(ka), bytes(kb), 0), forward)
                out += [(a, l, r), (b, l, r)]
            yield pd.DataFrame(out, columns=["cid", "l", "r"])

    return merged.where("side = 0").select("cid", "l", "r").union(met.select("cid", "edge", "before_id", "before").mapInPandas(across, NEIGHBOUR))


def _window_rows(bounds: DataFrame) -> DataFrame:
    """The windows of contexts between their bounds: cid, o, and the window with its gram and offset.

    Equal windows have equal anchors at equal offsets. Keyed by all three, a window that two anchors
    of one text both hold isn't taken for two places. A context has up to 201 windows; batches go
    out at ``WINDOW_ROWS``, so that a worker never holds the windows of all contexts it was sent.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        c, o, n, w = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(o, pa.int32()), pa.array(n, pa.int64()), pa.array(w, pa.binary())], names=["cid", "o", "n", "win"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                for c, x, l, r, g, n in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    rows += [(c, o, n, x[REACH - o : REACH - o + LENGTH] + b"%d:%d" % (g, o)) for o in range(max(0, LENGTH - r), l + 1)]
                    if len(rows) >= WINDOW_ROWS:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return bounds.select("cid", "ctx", "l", "r", "g", "n").mapInArrow(run, "cid binary, o int, n bigint, win binary")


def spans(docs: DataFrame, max_filter_bytes: int = 64 << 20, per_range: int = 20_000, sample_rows: int = 20_000) -> DataFrame:
    """Covered pieces of texts (id, th, start, end), not yet joined; ``docs``: id, th, t."""
    grams = materialise(_grams(docs), "grams")
    hits = materialise(_hits(docs, _bitmap(grams, max_filter_bytes)), "hits")
    release(grams)
    classes = materialise(hits.groupBy("cid", "g", "before", "behind").agg(F.count("*").alias("n")), "classes")
    several = materialise(classes.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"), "several")
    distinct = materialise(_contexts(docs, _bitmap(several, max_filter_bytes)), "contexts")
    near = _neighbours(distinct, True, per_range, sample_rows).union(_neighbours(distinct, False, per_range, sample_rows))
    enough = F.col("l") + F.col("r") >= LENGTH
    best = near.groupBy("cid").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.coalesce(F.max(F.when(enough, F.col("l"))), F.lit(-1)).alias("ql"), F.coalesce(F.max(F.when(enough, F.col("r"))), F.lit(-1)).alias("qr"))
    known = classes.join(best.withColumnRenamed("cid", "c2"), F.col("cid") == F.col("c2"), "left")
    # a context that occurs twice shares all it has; one that wasn't sorted is its gram's only one
    shared = [F.when(F.col("n") > 1, F.col(whole)).otherwise(F.coalesce(c, F.lit(-1))).alias(c) for c, whole in (("l", "before"), ("r", "behind"), ("ql", "before"), ("qr", "behind"))]
    known = materialise(known.select("cid", "g", "n", *shared), "known")
    possible = F.col("l") + F.col("r") >= LENGTH
    open_grams = known.where(possible & ((F.col("ql") < F.col("l")) | (F.col("qr") < F.col("r")))).select("g").distinct().withColumn("open", F.lit(True))
    judged = materialise(lookup(known, open_grams, "g", "left"), "judged")
    whole = judged.where(F.col("open").isNull() & possible).select("cid", F.col("ql").alias("l"), F.col("qr").alias("r"))
    unsure = judged.where(F.col("open") & possible).select(F.col("cid").alias("c2"), "l", "r", "n")
    wins = materialise(_window_rows(distinct.select("cid", "g", "ctx").join(unsure, F.col("cid") == F.col("c2"))), "windows")
    twice = wins.groupBy("win").agg(F.sum("n").alias("places")).where("places > 1").select("win")
    hit = lookup(wins, twice, "win").groupBy("cid").agg(F.max("o").alias("l"), (F.lit(LENGTH) - F.min("o")).alias("r"))
    covered = whole.union(hit)
    return lookup(hits.select("id", "th", "pos", "cid"), covered, "cid").select("id", "th", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"))


def joined(pieces: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and maximal [start, end) rows of overlapping or adjacent ones."""
    p = pieces[np.argsort(pieces[:, 0], kind="stable")]
    reach = np.maximum.accumulate(p[:, 1])
    new = np.ones(len(p), bool)
    new[1:] = p[1:, 0] > reach[:-1]
    return np.stack([p[new, 0], np.maximum.reduceat(p[:, 1], np.flatnonzero(new))], axis=1)


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """id, th, t and ``pieces``, the covered pieces in bytes, of every row; only covered texts shuffle."""
    docs = _ids(df, id_col, text_col)
    with scope() as kept:
        found = materialise(spans(docs, **limits).distinct(), "pieces")
        kept.append(found)
    pieces = found.groupBy(F.col("id").alias("i2"), F.col("th").alias("h2")).agg(F.collect_list(F.struct("start", "end")).alias("pieces"))
    tested = maybe_in(docs, "th", found.select("th"))
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>")
    alone = tested.where(~F.col("_mb_maybe")).select("id", "th", "t", none.alias("pieces"))
    rest = tested.where("_mb_maybe").join(pieces, (F.col("id").eqNullSafe(F.col("i2"))) & (F.col("th") == F.col("h2")), "left")
    return alone.union(rest.select("id", "th", "t", "pieces"))


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, **limits) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256, spans, and kept (bytes, if asked for)."""
    kind = df.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    if keep_bytes:
        fields, schema = [*fields, ("kept", pa.binary())], schema + ", kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t", 8 << 20):
                data, off = bytes_of(b.column(1))
                rows = []
                for k, p in enumerate(b.column(2)):
                    raw = data[off[k] : off[k + 1]].tobytes()
                    cut = joined(np.array([(x["start"], x["end"]) for x in p.as_py()], np.int64)) if p.is_valid and len(p) else np.zeros((0, 2), np.int64)
                    edges = [0, *cut.ravel().tolist(), len(raw)]
                    kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in cut.tolist()], *([kept] if keep_bytes else [])))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True))], names=["id", *(n for n, _ in fields)])

    out = removed_spans(df, id_col, text_col, **limits).select("id", "t", "pieces")
    return out.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    c = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_bytes=False)
    return c.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
