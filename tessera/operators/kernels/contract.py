"""Components of the edges that a task holds, of many graphs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least member of the component of each of ``n`` nodes, for edges (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


def least_nodes(batches: list[pa.RecordBatch], by: list[str]) -> pa.RecordBatch:
    """Rows (by..., _a, _b) of edges to one row (by..., _v, _l) a node: the least one of its component."""
    t = pa.Table.from_batches(batches).combine_chunks()
    group = np.zeros(len(t), np.int64)
    for c in by:
        code = t[c].combine_chunks().dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        group = np.unique(group * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    ends = np.concatenate([t[c].to_numpy() for c in ("_a", "_b")])
    values, rank = np.unique(ends, return_inverse=True)  # ranks order a graph's nodes as their values do
    key, first, at = np.unique(np.tile(group, 2) * len(values) + rank, return_index=True, return_inverse=True)
    label = roots(at[: len(t)], at[len(t) :], len(key))
    rows = t.select(by).take(pa.array(first % len(t))).combine_chunks()
    kind = t.schema.field("_a").type
    found = [pa.array(values[key % len(values)], kind), pa.array(values[key[label] % len(values)], kind)]
    return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in by), *found], names=[*by, "_v", "_l"])
