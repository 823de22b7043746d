"""Bounded-space best-fit packing of token sequences.

Documents are tokenised once (:func:`pieces`); the small piece rows are then rebalanced by size,
not by key, and each task packs its rows online: a fixed number of open bins, kept in stacks by
free space, with a bitset of the free spaces in use. A piece goes to the open bin with the least
space that holds it. When a new bin is needed and all are open, the fullest closes. Bins never
cross tasks, so each task leaves at most its open bins unfilled. Pieces wait in a buffer of
``buffer`` and leave it by length, longest first, which wastes a quarter of the space that the order
of arrival does.

Defined cases: null text is the empty document (its only id is the end id); repeated rows are
packed as often as they occur; very long texts are cut into pieces of the full capacity, of which
the first takes the remainder; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import bytes_of, slices

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class BestFit:
    """Online best fit over at most ``max_open`` bins of ``capacity``."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.in_use = 0  # bit f: some open bin has f free
        self.opened = self.now_open = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.in_use ^= 1 << free
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece of 1..capacity tokens and its offset there."""
        fitting = self.in_use >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.now_open == self.max_open:
                self._take((self.in_use & -self.in_use).bit_length() - 1)
                self.now_open -= 1
            free, bin_id = self.capacity, self.opened
            self.opened += 1
            self.now_open += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(bin_id)
            self.in_use |= 1 << rest
        else:
            self.now_open -= 1
        return bin_id, self.capacity - free


class Ids:
    """Token ids of the vocabulary file, special strings included, as its own library gives them.

    The rank file holds the same vocabulary for a faster library. It is used for texts without the
    special string whose bytes lie below U+0280, where both libraries class characters alike and
    ``tests/llm/test_packing.py`` compares them; other texts go to the vocabulary's own library.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        self.vocabulary, self.fast, self._own = vocabulary, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def own(self, text: str) -> np.ndarray:
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.vocabulary)
        return np.array(self._own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str, raw: np.ndarray) -> np.ndarray:
        if not len(raw):
            return np.zeros(0, np.uint32)
        if self.fast is None or len(raw) > 1 << 20 or raw.max() > 0xC9 or "<|" in text:
            return self.own(text)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=4)
def load_ids(vocabulary: str, ranks: str | None, pattern: str | None) -> Ids:
    return Ids(vocabulary, ranks, pattern)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = load_ids(vocabulary, ranks, pattern)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for b in slices(batch, "t", 16 << 20):
                data, off = bytes_of(b.column(1))
                at, rows = [], []
                for i, text in enumerate(b.column(1)):
                    ids = np.concatenate([ids_of(text.as_py() or "", data[off[i] : off[i + 1]]), end]).astype("<u4")
                    for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                        at.append(i)
                        rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                k, s, n, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, PIECES.format(id=kind.simpleString()))


def pack(piece_rows: DataFrame, capacity: int = 1024, max_open: int = 2048, buffer: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to piece rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = BestFit(capacity, max_open)
        base = TaskContext.get().partitionId() << 40
        for f in frames:
            length = f["length"].to_numpy()
            placed = np.zeros((len(f), 2), np.int64)
            for a in range(0, len(f), buffer):
                for i in (a + np.argsort(-length[a : a + buffer], kind="stable")).tolist():
                    placed[i] = fit.place(int(length[i]))
            yield f.assign(sequence_id=base + placed[:, 0], offset=placed[:, 1])

    kind = piece_rows.schema["doc_id"].dataType.simpleString()
    dealt = piece_rows.hint("rebalance").sortWithinPartitions("doc_id", "piece", "ids_crc32")
    return dealt.mapInPandas(run, PACKED.format(id=kind))


def pack_documents(df: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, max_open: int = 2048, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(df, vocabulary, end_id, capacity, ranks, pattern, id_col, text_col), capacity, max_open)


def production() -> dict:
    import public_tokenizers as p

    return {"vocabulary": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), **production())
