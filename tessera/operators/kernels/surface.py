"""Half-edges, intrinsic triangulations, discrete operators and heat geodesics of one mesh."""

from __future__ import annotations

import heapq

import numpy as np

from tessera.sources.meshes import Mesh

from .linear import BandCholesky, Coo


def nxt(h: np.ndarray | int):
    return h - h % 3 + (h % 3 + 1) % 3


def prv(h: np.ndarray | int):
    return h - h % 3 + (h % 3 + 2) % 3


class Intrinsic:
    """Connectivity (origin, twin per half-edge 3f+k; -1 on boundaries) and a length per half-edge."""

    def __init__(self, m: Mesh):
        self.n = len(m.x)
        self.origin = m.f.ravel().copy()
        dest = self.origin[nxt(np.arange(len(self.origin)))]
        key = self.origin * self.n + dest
        if len(np.unique(key)) < len(key):
            raise ValueError("an edge is used twice in the same direction")
        by = np.argsort(key)
        reverse = dest * self.n + self.origin
        at = np.searchsorted(key[by], reverse)
        hit = at < len(key)
        hit[hit] = key[by][at[hit]] == reverse[hit]
        self.twin = np.full(len(key), -1)
        self.twin[hit] = by[at[hit]]
        self.len = np.linalg.norm(m.x[dest] - m.x[self.origin], axis=1)
        self.flips = self.skipped = 0

    def dest(self, h):
        return self.origin[nxt(h)]

    def areas(self) -> np.ndarray:
        """Areas from lengths by the stable form of Heron's rule."""
        s = np.sort(self.len.reshape(-1, 3), axis=1)
        z, y, x = s.T
        return 0.25 * np.sqrt(np.maximum((x + (y + z)) * (z - (x - y)) * (z + (x - y)) * (x + (y - z)), 0))

    def cotangents(self) -> np.ndarray:
        """Per half-edge, the cotangent of the angle opposite to it; 0 in flat faces."""
        l2 = self.len.reshape(-1, 3) ** 2
        area = self.areas()
        num = np.stack([l2[:, 1] + l2[:, 2] - l2[:, 0], l2[:, 2] + l2[:, 0] - l2[:, 1], l2[:, 0] + l2[:, 1] - l2[:, 2]], axis=1)
        return np.where(area[:, None] > 0, num / np.where(area[:, None] > 0, 4 * area[:, None], 1), 0).ravel()

    def _cot(self, h: int) -> float:
        a, b, c = self.len[h], self.len[nxt(h)], self.len[prv(h)]
        z, y, x = sorted((a, b, c))
        t = (x + (y + z)) * (z - (x - y)) * (z + (x - y)) * (x + (y - z))
        return (b * b + c * c - a * a) / np.sqrt(t) if t > 0 else 0.0

    def is_delaunay(self, tolerance: float = 1e-12) -> bool:
        c, inner = self.cotangents(), self.twin >= 0
        return bool((c[inner] + c[self.twin[inner]] >= -tolerance).all())

    def _can_flip(self, h: int) -> bool:
        p, q = self.origin[prv(h)], self.origin[prv(self.twin[h])]
        if p == q:
            return False
        # the new edge must not exist yet: look around p
        g = start = prv(h)
        while True:
            if self.dest(g) == q:
                return False
            g = self.twin[prv(g)]
            if g < 0 or g == start:
                break
        if g < 0:  # a boundary was met: look the other way
            g = start
            while self.twin[g] >= 0:
                g = nxt(self.twin[g])
                if self.dest(g) == q or g == start:
                    return self.dest(g) != q
            return True
        return True

    def flip(self, h: int) -> None:
        """Turn edge h within its two triangles, which are laid out in the plane for the new length."""
        t = self.twin[h]
        a, b, c, d = nxt(h), prv(h), nxt(t), prv(t)
        l, la, lb, lc, ld = self.len[[h, a, b, c, d]]
        px = (l * l + lb * lb - la * la) / (2 * l)
        py = np.sqrt(max(lb * lb - px * px, 0))
        qx = (l * l + lc * lc - ld * ld) / (2 * l)
        qy = -np.sqrt(max(lc * lc - qx * qx, 0))
        new = np.hypot(px - qx, py - qy)
        u, v, p, q = self.origin[h], self.origin[t], self.origin[b], self.origin[d]
        rim = {b: (p, lb, self.twin[b]), c: (u, lc, self.twin[c]), d: (q, ld, self.twin[d]), a: (v, la, self.twin[a])}
        # face of h becomes (p, u, q), face of t becomes (q, v, p)
        f, g = h - h % 3, t - t % 3
        place = {b: f, c: f + 1, d: g, a: g + 1}
        for old, at in place.items():
            self.origin[at], self.len[at] = rim[old][0], rim[old][1]
        for at, o in ((f + 2, q), (g + 2, p)):
            self.origin[at], self.len[at] = o, new
        self.twin[f + 2], self.twin[g + 2] = g + 2, f + 2
        for old, at in place.items():
            w = rim[old][2]
            w = place.get(w, w)
            self.twin[at] = w
            if w >= 0:
                self.twin[w] = at
        self.flips += 1
        self._rim = list(place.values())

    def to_delaunay(self, tolerance: float = 1e-12) -> Intrinsic:
        """Flip from a last-in-first-out list until all edges are Delaunay or can't be flipped."""
        stack, queued = list(range(len(self.origin))), np.ones(len(self.origin), bool)
        skipped: set[int] = set()
        while stack:
            h = stack.pop()
            queued[h] = False
            if self.twin[h] < 0 or self._cot(h) + self._cot(self.twin[h]) >= -tolerance:
                continue
            if not self._can_flip(h):
                skipped.add(min(h, self.twin[h]))
                continue
            self.flip(h)
            for g in self._rim:
                if not queued[g]:
                    queued[g] = True
                    stack.append(g)
        self.skipped = len(skipped)
        return self


class Operators:
    """star0, star1 per edge, and L = -d0' star1 d0 of an intrinsic triangulation."""

    def __init__(self, t: Intrinsic):
        o, d = t.origin, t.dest(np.arange(len(t.origin)))
        self.n = t.n
        self.star0 = np.bincount(o, np.repeat(t.areas() / 3, 3), t.n)
        u, v = np.minimum(o, d), np.maximum(o, d)
        key, first, inverse = np.unique(u * t.n + v, return_index=True, return_inverse=True)
        self.u, self.v = key // t.n, key % t.n
        self.star1 = np.bincount(inverse, t.cotangents() / 2, len(key))
        self.mean_edge = float(t.len[first].mean()) if len(first) else 0.0
        w = self.star1
        self.l = Coo.of(t.n, np.concatenate([self.u, self.v, self.u, self.v]), np.concatenate([self.v, self.u, self.u, self.v]), np.concatenate([w, w, -w, -w]))


def adjacency(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbour lists as (start, node, weight) of undirected edges."""
    i, j, a = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
    by = np.lexsort((j, i))
    return np.searchsorted(i[by], np.arange(n + 1)), j[by], a[by]


def edges_of(m: Mesh) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.sort(m.f[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1)
    e = np.unique(e, axis=0) if len(e) else e
    return e[:, 0], e[:, 1], np.linalg.norm(m.x[e[:, 0]] - m.x[e[:, 1]], axis=1)


def dijkstra(n: int, graph, sources: list[int], owner: list[int] | None = None, most: float = np.inf, allowed: np.ndarray | None = None):
    """(distance, owner, parent) over a graph from :func:`adjacency`; inf and -1 where unreached."""
    start, node, weight = graph
    dist, own, par = np.full(n, np.inf), np.full(n, -1), np.full(n, -1)
    heap = []
    for k, s in enumerate(sources):
        if 0 <= s < n:
            heap.append((0.0, owner[k] if owner is not None else s, s, -1))
    heapq.heapify(heap)
    while heap:
        d, o, v, p = heapq.heappop(heap)
        if dist[v] < np.inf:
            continue
        dist[v], own[v], par[v] = d, o, p
        for e in range(start[v], start[v + 1]):
            w = node[e]
            if dist[w] == np.inf and d + weight[e] <= most and (allowed is None or allowed[w]):
                heapq.heappush(heap, (d + weight[e], o, int(w), v))
    return dist, own, par


def component_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of each node's component, by pointer jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


class HeatGeodesics:
    """Geodesic distance by short-time heat flow; factors once, answers many source sets."""

    def __init__(self, m: Mesh, time_factor: float = 1.0, delaunay: bool = False):
        t = Intrinsic(m)
        if delaunay:
            t.to_delaunay()
        self.t, self.ops = t, Operators(t)
        h = self.ops.mean_edge
        self.label = component_labels(self.ops.n, self.ops.u, self.ops.v)
        lone = np.setdiff1d(np.arange(t.n), t.origin)
        self.heat = BandCholesky(self.ops.l.plus_diagonal(-time_factor * h * h, np.where(np.isin(np.arange(t.n), lone), 1.0, self.ops.star0)))
        self.pins = np.unique(self.label)
        minus = Coo(t.n, self.ops.l.i, self.ops.l.j, -self.ops.l.a)
        self.poisson = BandCholesky(minus.pinned(self.pins))
        self.area, self.cot = t.areas(), t.cotangents().reshape(-1, 3)

    def distance(self, sources: list[int]) -> np.ndarray:
        n, t = self.ops.n, self.t
        if not len(sources):
            raise ValueError("no source vertices")
        if min(sources) < 0 or max(sources) >= n:
            raise ValueError("source vertex out of range")
        b = np.zeros(n)
        b[list(sources)] = 1
        u = self.heat.solve(b)
        # each face in the plane: corner 0 at the origin, corner 1 on the x axis
        l = t.len.reshape(-1, 3)
        f = t.origin.reshape(-1, 3)
        x = (l[:, 0] ** 2 + l[:, 2] ** 2 - l[:, 1] ** 2) / (2 * np.where(l[:, 0] > 0, l[:, 0], 1))
        y = np.where(l[:, 0] > 0, 2 * self.area / np.where(l[:, 0] > 0, l[:, 0], 1), 0)
        p = np.stack([np.zeros((len(f), 2)), np.stack([l[:, 0], 0 * x], 1), np.stack([x, y], 1)], axis=1)
        turn = lambda e: np.stack([-e[..., 1], e[..., 0]], axis=-1)
        g = sum(u[f[:, k], None] * turn(p[:, (k + 2) % 3] - p[:, (k + 1) % 3]) for k in range(3))
        size = np.linalg.norm(g, axis=1, keepdims=True)
        field = np.where((size > 0) & (self.area[:, None] > 0), -g / np.where(size > 0, size, 1), 0)
        div = np.zeros(n)
        for k in range(3):
            e = ((p[:, (k + 1) % 3] - p[:, k]) * field).sum(1) * self.cot[:, k] / 2
            np.add.at(div, f[:, k], e)
            np.add.at(div, f[:, (k + 1) % 3], -e)
        rhs = -div
        rhs[self.pins] = 0
        phi = self.poisson.solve(rhs)
        out = np.full(n, np.nan)
        for c in np.unique(self.label[list(sources)]):
            mine = self.label == c
            at = [s for s in sources if self.label[s] == c]
            out[mine] = phi[mine] - phi[at].mean()
        return out
