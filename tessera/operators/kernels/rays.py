"""Rays and nearest points on one mesh: a bounding-volume tree, undercuts, wall thickness."""

from __future__ import annotations

import math

import numpy as np

from tessera.sources.meshes import Mesh

TINY_DET, SLACK = 1e-18, 1e-10


def ray_triangles(o: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, t_min: float, t_max: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t (inf on a miss), u, v of one ray with many triangles; bounds of u and v are inflated a little."""
    e, f = b - a, c - a
    p = np.cross(d, f)
    det = (e * p).sum(-1)
    ok = np.abs(det) >= TINY_DET
    inv = 1 / np.where(ok, det, 1)
    s = o - a
    u = (s * p).sum(-1) * inv
    q = np.cross(s, e)
    v = (q * d).sum(-1) * inv
    t = (f * q).sum(-1) * inv
    ok &= (u >= -SLACK) & (v >= -SLACK) & (u + v <= 1 + SLACK) & (t > t_min) & (t < t_max)
    return np.where(ok, t, np.inf), u, v


def closest_on_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest point of one triangle: clamp to the edges unless the projection lies inside."""
    n = np.cross(b - a, c - a)
    size = n @ n
    best, least = a, np.inf
    if size > 0:
        q = p - n * ((p - a) @ n) / size
        if all(np.cross(y - x, q - x) @ n >= 0 for x, y in ((a, b), (b, c), (c, a))):
            return q
    for x, y in ((a, b), (b, c), (c, a)):
        e = y - x
        l = e @ e
        q = x + e * min(1.0, max(0.0, (p - x) @ e / l)) if l > 0 else x
        dist = ((p - q) ** 2).sum()
        if dist < least:
            best, least = q, dist
    return best


class Bvh:
    """A median-split tree over triangle boxes, walked near child first."""

    def __init__(self, m: Mesh, leaf: int = 8):
        self.tri = m.x[m.f]
        self.lo, self.hi = self.tri.min(1), self.tri.max(1)
        self.nodes: list[tuple] = []
        if len(m.f):
            self._build(np.arange(len(m.f)), self.tri.mean(1), leaf)

    def _build(self, ids: np.ndarray, mid: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        lo, hi = self.lo[ids].min(0), self.hi[ids].max(0)
        self.nodes.append((lo, hi, -1, -1, ids))
        if len(ids) > leaf:
            axis = int(np.ptp(mid[ids], axis=0).argmax())
            order = ids[np.argsort(mid[ids, axis], kind="stable")]
            half = len(order) // 2
            left = self._build(order[:half], mid, leaf)
            right = self._build(order[half:], mid, leaf)
            self.nodes[at] = (lo, hi, left, right, None)
        return at

    def _enter(self, k: int, o: np.ndarray, d: np.ndarray, t0: float, t1: float) -> float:
        """Where a ray enters a node's box; inf if it misses. Axis-parallel rays are tested by position."""
        lo, hi = self.nodes[k][0], self.nodes[k][1]
        for i in range(3):
            if d[i] == 0:
                if o[i] < lo[i] or o[i] > hi[i]:
                    return math.inf
                continue
            a, b = (lo[i] - o[i]) / d[i], (hi[i] - o[i]) / d[i]
            if a > b:
                a, b = b, a
            t0, t1 = max(t0, a - SLACK), min(t1, b + SLACK)
            if t0 > t1:
                return math.inf
        return t0

    def intersect(self, o, d, t_min: float = 0.0, t_max: float = math.inf, ignore: int = -1, any_hit: bool = False) -> tuple[float, int, float, float]:
        """(t, face, u, v) of the nearest hit in the open interval; t is inf and face -1 without one."""
        o, d = np.asarray(o, float), np.asarray(d, float)
        best = (math.inf, -1, 0.0, 0.0)
        stack = [(self._enter(0, o, d, t_min, t_max), 0)] if self.nodes else []
        while stack:
            t0, k = stack.pop()
            if t0 == math.inf or t0 > min(best[0], t_max):
                continue
            _, _, left, right, ids = self.nodes[k]
            if ids is not None:
                t, u, v = ray_triangles(o, d, *(self.tri[ids, j] for j in range(3)), t_min, t_max)
                t[ids == ignore] = math.inf
                i = int(np.lexsort((ids, t))[0])
                if (t[i], ids[i]) < (best[0], best[1]) and t[i] < math.inf:
                    best = (float(t[i]), int(ids[i]), float(u[i]), float(v[i]))
                    if any_hit:
                        return best
                continue
            near = sorted(((self._enter(c, o, d, t_min, min(best[0], t_max)), c) for c in (left, right)), reverse=True)
            stack += near
        return best

    def occluded(self, o, d, t_min: float = 0.0, t_max: float = math.inf, ignore: int = -1) -> bool:
        return self.intersect(o, d, t_min, t_max, ignore, any_hit=True)[1] >= 0

    def closest(self, p) -> tuple[np.ndarray, float, int]:
        """(point, distance, face)."""
        p = np.asarray(p, float)
        box = lambda k: float((np.maximum(0, np.maximum(self.nodes[k][0] - p, p - self.nodes[k][1])) ** 2).sum())
        best = (p, math.inf, -1)
        stack = [(box(0), 0)] if self.nodes else []
        while stack:
            d, k = stack.pop()
            if d >= best[1]:
                continue
            _, _, left, right, ids = self.nodes[k]
            if ids is None:
                stack += sorted(((box(c), c) for c in (left, right)), reverse=True)
                continue
            for i in ids.tolist():
                q = closest_on_triangle(p, *self.tri[i])
                d2 = float(((p - q) ** 2).sum())
                if d2 < best[1]:
                    best = (q, d2, i)
        return best[0], math.sqrt(best[1]), best[2]


def unit(v: np.ndarray, default: tuple = (0.0, 0.0, 0.0)) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), np.asarray(default))


def frame(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors that make a right-handed frame with ``axis``."""
    helper = np.eye(3)[int(np.abs(axis).argmin())]
    u = unit(np.cross(helper, axis))
    return u, np.cross(axis, u)


def cap_directions(axis: np.ndarray, angle: float, n: int) -> np.ndarray:
    """Golden-angle spiral over the cap of half-angle ``angle`` about an axis, uniform in area."""
    k = np.arange(n)
    z = 1 - (1 - math.cos(angle)) * (k + 0.5) / n
    turn = k * math.pi * (3 - math.sqrt(5))
    r = np.sqrt(np.maximum(0, 1 - z * z))
    u, v = frame(axis)
    return z[:, None] * axis + r[:, None] * (np.cos(turn)[:, None] * u + np.sin(turn)[:, None] * v)


def undercut_faces(m: Mesh, bvh: Bvh, d: np.ndarray, region: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """Faces of the region that direction d doesn't reach: turned away, or shadowed by the mesh."""
    n = np.cross(m.x[m.f[:, 1]] - m.x[m.f[:, 0]], m.x[m.f[:, 2]] - m.x[m.f[:, 0]])
    size = np.linalg.norm(n, axis=1)
    lift = 1e-7 * np.linalg.norm(np.ptp(m.x, axis=0)) if len(m.x) else 0.0
    n, mid, out = unit(n), m.x[m.f].mean(1), np.zeros(len(m.f), bool)
    for i in np.flatnonzero(region & (size > 0)):
        out[i] = n[i] @ d < -tolerance or bvh.occluded(mid[i] + lift * n[i], d, 0.0, math.inf, int(i))
    return out


def undercut_fraction(m: Mesh, undercut: np.ndarray, region: np.ndarray) -> float:
    area = 0.5 * np.linalg.norm(np.cross(m.x[m.f[:, 1]] - m.x[m.f[:, 0]], m.x[m.f[:, 2]] - m.x[m.f[:, 0]]), axis=1)
    total = area[region].sum()
    return float(area[region & undercut].sum() / total) if total > 0 else 0.0


def best_axis(m: Mesh, region: np.ndarray, hint: np.ndarray, tilt_deg: float = 30.0, samples: int = 120, min_step_deg: float = 0.25, coarse: int = 2000) -> tuple[np.ndarray, float, int]:
    """(axis, undercut fraction, evaluations): a spiral of directions, then a pattern search.

    Above ``coarse`` faces the search uses every k-th face of the region and ends with a polish on all.
    """
    bvh, hint, tilt = Bvh(m), unit(np.asarray(hint, float)), math.radians(tilt_deg)
    ids = np.flatnonzero(region)
    few = np.zeros(len(m.f), bool)
    few[ids[:: max(1, -(-len(ids) // coarse))]] = True
    calls = 0

    def value(d: np.ndarray, faces: np.ndarray) -> tuple[float, float]:
        nonlocal calls
        calls += 1
        return undercut_fraction(m, undercut_faces(m, bvh, d, faces), faces), math.acos(max(-1.0, min(1.0, float(d @ hint))))

    def search(d: np.ndarray, score: tuple[float, float], step: float, faces: np.ndarray):
        while step >= math.radians(min_step_deg):
            u, v = frame(d)
            moved = False
            for w in (u, -u, v, -v):
                e = unit(math.cos(step) * d + math.sin(step) * w)
                if e @ hint >= math.cos(tilt) - 1e-12:
                    s = value(e, faces)
                    if s < score:
                        d, score, moved = e, s, True
                        break
            if not moved:
                step /= 2
        return d, score

    options = [hint, *cap_directions(hint, tilt, samples)]
    d, score = min(((o, value(o, few)) for o in options), key=lambda x: x[1])
    d, score = search(d, score, max(2 * tilt / math.sqrt(samples), math.radians(min_step_deg)), few)
    if few.sum() < region.sum():
        d, score = search(d, value(d, region), math.radians(1.0), region)
    return d, score[0], calls


def wall_thickness(m: Mesh, rays: int = 30, cone_deg: float = 30.0) -> np.ndarray:
    """Per vertex: least, upper median, and along the inward normal; NaN without a hit.

    A hit counts if the face is met from inside; a nearer wrong-side hit blocks the ray.
    """
    bvh = Bvh(m)
    n = np.cross(m.x[m.f[:, 1]] - m.x[m.f[:, 0]], m.x[m.f[:, 2]] - m.x[m.f[:, 0]])
    vn = np.zeros_like(m.x)
    for k in range(3):
        np.add.at(vn, m.f[:, k], n)
    vn, t_min = unit(vn), 1e-6 * np.linalg.norm(np.ptp(m.x, axis=0))
    out = np.full((len(m.x), 3), np.nan)
    for i, x in enumerate(m.x):
        if not vn[i].any():
            continue
        hits = []
        for k, d in enumerate(np.concatenate([[-vn[i]], cap_directions(-vn[i], math.radians(cone_deg), rays)])):
            t, f, _, _ = bvh.intersect(x, d, t_min)
            if f >= 0 and n[f] @ d > 0:
                hits.append(t)
                if k == 0:
                    out[i, 2] = t
        if hits:
            out[i, 0], out[i, 1] = min(hits), sorted(hits)[len(hits) // 2]
    return out
