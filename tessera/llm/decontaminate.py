"""Benchmark decontamination by latent semantic retrieval and exact checks.

Texts and benchmark items are cut into passages of ``window`` words, half overlapping. Words are
lower-cased, trimmed and hashed to ``2**bits`` terms. Document frequencies cover all documents. The
latent space is a randomised SVD of the TF-IDF passages of all documents, stacked with the items'
(which together weigh as much); its products run on the executors, per block of terms, over the
words kept as terms, and the driver orthogonalises a matrix of fixed size. Every passage of every
document is then projected and compared with every item passage by cosine, in blocks of the item set.

Passages above ``cosine`` are candidates. The region around one (extended by the item's length) is
checked word by word: the longest common subsequence with the item must cover ``overlap`` of it, or
``loose`` of it if the item's answer, its last sentence, is covered too. Recall of the candidates is
measured against brute force in ``tests/llm/test_decontaminate.py``.

Defined cases: null and empty texts contain nothing; items without words match nothing; repeated
rows give repeated pairs; items of one text are found each; an empty benchmark gives no rows; extra
columns are kept by :func:`without_leaks` and ignored by :func:`leaks`. Long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .textnum import LOWER, bytes_of, slices, trimmed, word_hashes, words

BLOCK = 512
#: Words in a task of the fit, about; each adds up a matrix of all terms.
WORDS_PER_TASK = 1 << 24


def word_keys(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, rows = words(raw, off)
    s, e = trimmed(raw, s, e)
    return (word_hashes(LOWER[raw], s, e) if len(raw) else np.zeros(0, np.uint64)), rows


def half_windows(rows: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of runs of ``half`` words that don't cross rows, their row, and whether one ends its row."""
    count = np.diff(rows)
    per = -(-count // half)
    row = np.repeat(np.arange(len(count)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return rows[row] + k * half, row, k + 1 == per[row]


def lcs(masks: dict[int, int], size: int, words_: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel in the item's words."""
    full = v = (1 << size) - 1
    for w in words_:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(keys: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, k in enumerate(keys):
        out[k] = out.get(k, 0) | 1 << i
    return out


class Item:
    def __init__(self, item_id: int, text: str):
        keys = lambda t: word_keys(*bytes_of(pa.array([t])))[0].tolist()
        self.id, self.keys = item_id, keys(text)
        parts = [k for k in map(keys, re.split(r"[.!?]+(?:\s+|$)", text)) if k]
        answer = parts[-1] if parts and 3 <= len(parts[-1]) < len(self.keys) else self.keys[-5:]
        self.size, self.masks = len(self.keys), _masks(self.keys)
        self.words = set(self.keys)
        self.answer_size, self.answer = len(answer), _masks(answer)


def _sums(terms: np.ndarray, starts: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Sums of rows of ``table`` over the runs of terms (up to ``width`` each), in pieces that fit a core's cache."""
    out = np.empty((len(starts), table.shape[1]), np.float32)
    end = np.append(starts[1:], len(terms))
    step = 64
    for a in range(0, len(starts), step):
        at = starts[a : a + step, None] + np.arange(width)
        inside = at < end[a : a + step, None]
        _rows(table, terms[np.minimum(at, len(terms) - 1)], inside, out[a : a + step])
    return out


def _rows(table: np.ndarray, at: np.ndarray, inside: np.ndarray, out: np.ndarray) -> None:
    """``out[i]``: the sum of the rows ``at[i]`` of ``table`` that are ``inside``; faster than ``reduceat``."""
    np.matmul(inside[:, None, :].astype(np.float32), np.take(table, at.astype(np.intp), axis=0), out=out[:, None])


def _scatter(out: np.ndarray, terms: np.ndarray, row: np.ndarray, y: np.ndarray, width: int = 32) -> None:
    """Add row ``row[i]`` of ``y`` to row ``terms[i]`` of ``out`` for all i: a term's rows in runs of ``width``, then the runs' sums."""
    by = np.argsort(terms, kind="stable")
    t, r = terms[by], row[by]
    while len(t):
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        count = np.diff(np.append(first, len(t)))
        few = count <= 2
        for k in range(2):
            f = first[few & (count > k)]
            out[t[f]] += y[r[f + k]]
        first, count = first[~few], count[~few]
        runs = -(-count // width)
        start = np.repeat(first - width * (np.cumsum(runs) - runs), runs) + width * np.arange(runs.sum())
        end = np.repeat(first + count, runs)
        sums = np.empty((len(start), y.shape[1]), np.float32)
        for a in range(0, len(start), 64):
            at = start[a : a + 64, None] + np.arange(width)
            _rows(y, r[np.minimum(at, len(r) - 1)], at < end[a : a + 64, None], sums[a : a + 64])
        t, r, y = np.repeat(t[first], runs), np.arange(len(start)), sums


class Finder:
    """Candidate search and checks over slices of documents; holds only benchmark-sized data."""

    def __init__(self, items: list[Item], terms_of, projection: np.ndarray, window: int, cosine: float, overlap: float, loose: float, item_block: int = 4096):
        self.items, self.projection, self.half = items, projection, window // 2
        self.cosine, self.overlap, self.loose, self.item_block = cosine, overlap, loose, item_block
        self.terms_of = terms_of
        vectors, owner = [], []
        for i, it in enumerate(items):
            for a in range(0, max(1, it.size - self.half), self.half):
                vectors.append(projection[terms_of(np.array(it.keys[a : a + window], np.uint64))].sum(0))
                owner.append(i)
        q = np.array(vectors, np.float32).reshape(len(owner), projection.shape[1])
        self.queries, self.owner = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9), np.array(owner)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"projection": self.projection.astype(np.float16)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"projection": state["projection"].astype(np.float32)}

    def candidates(self, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first word) of passages close to an item."""
        if not len(keys) or not len(self.owner):
            return
        start, row, last = half_windows(rows, self.half)
        x = _sums(self.terms_of(keys), start, self.projection, self.half)
        x[:-1] += x[1:] * ~last[:-1, None]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        for b in range(0, len(self.owner), self.item_block):
            p, q = np.nonzero(x @ self.queries[b : b + self.item_block].T >= self.cosine)
            yield from zip(row[p].tolist(), self.owner[b + q].tolist(), start[p].tolist(), strict=True)

    def find(self, raw: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[float, bool, int]]:
        """(row, item) of confirmed leaks: share of the item covered, answer covered, word where it was seen."""
        keys, rows = word_keys(raw, off)
        found: dict[tuple[int, int], tuple[float, bool, int]] = {}
        for row, i, start in self.candidates(keys, rows):
            it = self.items[i]
            a, b = max(rows[row], start - it.size), min(rows[row + 1], start + 2 * self.half + it.size)
            near = keys[a:b].tolist()
            if it.size - len(it.words) + len(it.words.intersection(near)) < self.loose * it.size:
                continue  # each distinct word that is missing costs the subsequence a place at least
            share = lcs(it.masks, it.size, near) / it.size
            if share < self.loose or share <= found.get((row, i), (0.0,))[0]:
                continue
            answered = lcs(it.answer, it.answer_size, near) >= 0.8 * it.answer_size
            if share >= self.overlap or answered:
                found[row, i] = (share, answered, int(start - rows[row]))
        return found


class Terms:
    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(20)) & self.mask).astype(np.int64)


def _terms(docs: DataFrame, bits: int, window: int) -> DataFrame:
    """Every document's words as terms (16 or 32 bits each), and for each task the terms it saw and in how many documents.

    The numbers of documents and of passages stand there as terms -1 and -2.
    """
    terms_of, kind = Terms(bits), "<u2" if bits <= 16 else "<u4"
    columns = ["terms", "seen", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, passages = np.zeros(1 << bits, np.int64), 0, 0
        for batch in batches:
            for b in slices(batch, "t"):
                keys, rows = word_keys(*bytes_of(b.column(1)))
                terms = terms_of(keys)
                row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
                df += np.bincount((np.unique((row << np.uint64(bits)) | terms.astype(np.uint64)) & terms_of.mask).astype(np.int64), minlength=1 << bits)
                n += len(rows) - 1
                passages += len(half_windows(rows, window // 2)[0])
                data = terms.astype(kind)
                whole = pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer((rows * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([whole, *(pa.nulls(len(whole), pa.list_(pa.int64())) for _ in columns[1:])], names=columns)
        seen = np.flatnonzero(df)
        counts = [np.append(seen, [-1, -2]), np.append(df[seen], [n, passages])]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), *(pa.array([c], pa.list_(pa.int64())) for c in counts)], names=columns)

    return materialise(docs.mapInArrow(run, "terms binary, seen array<bigint>, df array<bigint>"), "terms")


def _statistics(table: DataFrame, bits: int) -> tuple[int, int, np.ndarray]:
    """Over all documents: their number, that of their passages, and each term's document frequency."""
    pairs = table.where("seen IS NOT NULL").select(F.explode(F.arrays_zip("seen", "df")).alias("p"))
    total = pairs.groupBy(F.col("p.seen").alias("term")).agg(F.sum("p.df").alias("n")).toPandas()
    count = dict(zip(total["term"], total["n"], strict=True))
    df = np.zeros(1 << bits)
    df[[t for t in count if t >= 0]] = [n for t, n in count.items() if t >= 0]
    return int(count.get(-1, 0)), int(count.get(-2, 0)), df


def _products(texts: DataFrame, idf: np.ndarray, basis: np.ndarray, half: int) -> np.ndarray:
    """A'(A basis) for the TF-IDF rows A of all passages, summed per block of terms on the executors.

    ``texts``: terms (binary) and weight w. A word counts through its half window in the one or two passages that hold it.
    """
    size, k = basis.shape
    kind = "<u2" if size <= 1 << 16 else "<u4"
    small = basis.astype(np.float16)  # as sent to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, k), np.float32)
        weighted = idf[:, None].astype(np.float32) * small.astype(np.float32)
        squares = (idf**2).astype(np.float32)
        for batch in batches:
            for b in slices(batch, "terms"):
                raw, off = bytes_of(b.column(0))
                terms = raw.view(kind)
                start, row, last = half_windows(off // terms.itemsize, half)
                if not len(start):
                    continue
                both = ~last[:-1]
                y, norm = _sums(terms, start, weighted, half), np.add.reduceat(squares[terms], start)
                y[:-1] += y[1:] * both[:, None]
                norm[:-1] += norm[1:] * both
                y *= (np.asarray(b.column(1), np.float32)[row] ** 2 / np.maximum(norm, 1e-9))[:, None]
                y[1:] += y[:-1] * both[:, None]
                _scatter(out, terms, np.repeat(np.arange(len(start)), np.diff(np.append(start, len(terms)))), y)
        out *= idf[:, None].astype(np.float32)
        blocks = range(0, size, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([*blocks], pa.int32()), pa.array([out[a : a + BLOCK].tobytes() for a in blocks], pa.binary())], names=["block", "part"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in f["part"])
        return pd.DataFrame({"block": f["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    got = texts.mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").toPandas()
    out = np.zeros((size, k), np.float32)
    for a, p in zip(got["block"], got["part"], strict=True):
        part = np.frombuffer(p, np.float32).reshape(-1, k)
        out[a : a + len(part)] = part
    return out


def fit(docs: DataFrame, benchmark: list[tuple[int, str | None]], bits: int = 14, rank: int = 192, window: int = 48, fit_passages: int | None = None, rounds: int = 1, cosine: float = 0.55, overlap: float = 0.8, loose: float = 0.6) -> Finder:
    """``docs``: columns id and t. ``benchmark``: a stated query set of (item id, text).

    Every passage of both counts in the fit; ``fit_passages`` bounds it to the passages of some documents, by hash, for callers who want that.
    """
    spark, terms_of = docs.sparkSession, Terms(bits)
    items = [it for it in (Item(i, t or "") for i, t in benchmark) if it.size]
    table = _terms(docs, bits, window)
    n, passages, df = _statistics(table, bits)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    own = [terms_of(np.array(it.keys, np.uint64)).astype("<u2" if bits <= 16 else "<u4") for it in items]
    weight = max(1.0, (passages / max(1, sum(-(-len(t) // (window // 2)) for t in own))) ** 0.5)
    tasks = max(spark.sparkContext.defaultParallelism, passages * (window // 2) // WORDS_PER_TASK)
    texts = table.where("terms IS NOT NULL").select("terms", F.lit(1.0).cast("float").alias("w")).coalesce(tasks)
    if fit_passages is not None:
        texts = texts.where(F.pmod(F.xxhash64("terms"), F.lit(max(1, passages // max(1, fit_passages)))) == 0)
    if own:
        texts = texts.union(spark.createDataFrame([(bytearray(t.tobytes()), weight) for t in own], "terms binary, w float").coalesce(1))
    basis = np.random.default_rng(17).standard_normal((1 << bits, rank + 8)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(_products(texts, idf, basis, window // 2))
        basis = basis.astype(np.float32)
    m = _products(texts, idf, basis, window // 2)
    release(table)
    values, turn = np.linalg.eigh((basis.T @ m).astype(np.float64))
    top = np.argsort(values)[::-1][:rank]
    projection = (idf[:, None] * (basis @ turn[:, top])).astype(np.float32)
    return Finder(items, terms_of, projection, window, cosine, overlap, loose)


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))


def leaks(df: DataFrame, finder: Finder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: id, item_id, overlap, answered, word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                found = finder.find(*bytes_of(b.column(1)))
                at = pa.array([r for r, _ in found], pa.int64())
                share, answered, word = zip(*found.values(), strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([finder.items[i].id for _, i in found], pa.int64()), pa.array(share, pa.float64()), pa.array(answered, pa.bool_()), pa.array(word, pa.int64())], names=["id", "item_id", "overlap", "answered", "word"])

    kind = df.schema[id_col].dataType.simpleString()
    out = _prepared(df, id_col, text_col).mapInArrow(run, f"id {kind}, item_id bigint, overlap double, answered boolean, word bigint")
    return out.withColumnRenamed("id", id_col)


def without_leaks(df: DataFrame, finder: Finder, text_col: str = "text") -> DataFrame:
    """The rows in which no item is found, with all their columns; nothing shuffles."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, _ in finder.find(*bytes_of(b.column(at)))]] = False
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def benchmark_items(spark, sf_dir: str) -> list[tuple[int, str | None]]:
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").orderBy("item_id").collect()]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    finder = fit(_prepared(docs, "doc_id", "text"), benchmark_items(spark, sf_dir))
    return leaks(docs, finder).withColumn("overlap", F.round("overlap", 6))
