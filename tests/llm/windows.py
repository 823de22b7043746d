"""Brute force for op10: hashes every 400-byte window of a table and compares a written result of the query.

    python -m tests.llm.windows SF_DIR RESULT.parquet

Windows are told apart by 64-bit polynomial hashes over random byte values. About 20 bytes of memory
a byte of text are needed.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow.dataset as ds

BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64


def powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        p[k : k + m] = p[:m] * np.uint64(pow(base, k, WORD))
        k += m
    return p


def window_hashes(x: np.ndarray, width: int, chunk: int = 1 << 24) -> np.ndarray:
    """A hash for each start; the last ``width - 1`` are zero."""
    values = np.random.default_rng(7).integers(0, WORD, 256, dtype=np.uint64, endpoint=False)
    up, down = powers(BASE, chunk + width), powers(pow(BASE, -1, WORD), chunk)
    h = np.zeros(len(x), np.uint64)
    for a in range(0, len(x) - width + 1, chunk):
        n = min(chunk, len(x) - width + 1 - a)
        total = np.zeros(n + width, np.uint64)
        np.cumsum(values[x[a : a + n + width - 1]] * up[: n + width - 1], out=total[1:])
        v = (total[width:] - total[:n]) * down[:n]
        v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h[a : a + n] = v ^ (v >> np.uint64(29))
    return h


def covered(texts: list[bytes], width: int = 400) -> list[np.ndarray]:
    """For each text, which bytes a window that starts anywhere else too covers."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *(len(t) for t in texts)])
    h = window_hashes(x, width)
    step = np.zeros(len(x) + 1, np.int32)
    whole = np.diff(off) >= width
    np.add.at(step, off[:-1][whole], 1)
    np.add.at(step, off[1:][whole] - width + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    mark = np.zeros(len(x) + 1, np.int32)
    for k in range(8):
        at = np.flatnonzero(valid & ((h >> np.uint64(61)) == np.uint64(k)))
        v = h[at]
        s = np.sort(v)
        again = np.unique(s[1:][s[1:] == s[:-1]])
        if len(again):
            at = at[again[np.minimum(np.searchsorted(again, v), len(again) - 1)] == v]
            mark[at] += 1
            mark[at + width] -= 1
    cov = np.cumsum(mark[:-1]) > 0
    return [cov[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def expected(ids: list[int], texts: list[bytes], width: int = 400) -> dict[int, tuple]:
    """Of each id: n_bytes, n_removed, n_spans, kept_sha256."""
    out = {}
    for i, t, c in zip(ids, texts, covered(texts, width), strict=True):
        spans = int((np.diff(c.astype(np.int8), prepend=0) == 1).sum())
        out[i] = len(t), int(c.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~c].tobytes()).hexdigest()
    return out


def main(sf_dir: str, result: str) -> None:
    table = ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"])
    want = expected(table["doc_id"].to_pylist(), [(t or "").encode() for t in table["text"].to_pylist()])
    rows = ds.dataset(result).to_table().to_pylist()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    print(len(want), "documents,", sum(w[1] > 0 for w in want.values()), "with removals,", len(rows), "rows,", sum(got.get(i) != w for i, w in want.items()), "mismatches")


if __name__ == "__main__":
    main(*sys.argv[1:])
