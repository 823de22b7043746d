"""Sequential greedy rules on points."""

from __future__ import annotations

from collections import defaultdict
from itertools import product

import numpy as np


def weld_within(x: np.ndarray, eps: float) -> np.ndarray:
    """For each point in order, the earliest representative within ``eps``, or itself.

    Not transitive: a point within reach of two representatives joins the earlier.
    """
    cells: dict[tuple, list[int]] = defaultdict(list)
    rep = np.arange(len(x))
    size = eps if eps > 0 else 1.0
    for i, (p, c) in enumerate(zip(x, np.floor(x / size).astype(np.int64).tolist(), strict=True)):
        near = [j for d in product((-1, 0, 1), repeat=3) for j in cells.get((c[0] + d[0], c[1] + d[1], c[2] + d[2]), ()) if np.linalg.norm(x[j] - p) <= eps]
        if near:
            rep[i] = min(near)
        else:
            cells[tuple(c)].append(i)
    return rep
