"""Closed-form meshes as NumPy arrays; invalid parameters give an empty mesh."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Mesh:
    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    f: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))

    def __post_init__(self):
        self.x = np.asarray(self.x, np.float64).reshape(-1, 3)
        self.f = np.asarray(self.f, np.int64).reshape(-1, 3)


def append(a: Mesh, b: Mesh) -> Mesh:
    """Disjoint union; the second mesh's ids are shifted."""
    return Mesh(np.concatenate([a.x, b.x]), np.concatenate([a.f, b.f + len(a.x)]))


def _cells(nu: int, nv: int, ids) -> np.ndarray:
    """Two triangles per cell (i, j), in row order: (a, b, c), (a, c, d) counterclockwise."""
    j, i = np.divmod(np.arange(nu * nv), nu)
    a, b, c, d = ids(i, j), ids(i + 1, j), ids(i + 1, j + 1), ids(i, j + 1)
    return np.stack([a, b, c, a, c, d], axis=1).reshape(-1, 3)


def grid(nx: int, ny: int) -> Mesh:
    if nx < 1 or ny < 1:
        return Mesh()
    j, i = np.divmod(np.arange((nx + 1) * (ny + 1)), nx + 1)
    return Mesh(np.stack([i / nx, j / ny, 0.0 * i], axis=1), _cells(nx, ny, lambda i, j: j * (nx + 1) + i))


def grid_with_holes(nx: int, ny: int, cells: list[tuple[int, int]]) -> Mesh:
    g = grid(nx, ny)
    gone = {j * nx + i for i, j in cells}
    return Mesh(g.x, g.f[[c // 2 not in gone for c in range(len(g.f))]])


def torus(nu: int, nv: int, big: float = 1.0, small: float = 0.3) -> Mesh:
    if nu < 3 or nv < 3 or not 0 < small < big:
        return Mesh()
    j, i = np.divmod(np.arange(nu * nv), nu)
    u, v = 2 * np.pi * i / nu, 2 * np.pi * j / nv
    w = big + small * np.cos(v)
    return Mesh(np.stack([w * np.cos(u), w * np.sin(u), small * np.sin(v)], axis=1), _cells(nu, nv, lambda i, j: (j % nv) * nu + i % nu))


def cylinder(nu: int, nv: int, radius: float = 1.0, height: float = 1.0) -> Mesh:
    if nu < 3 or nv < 1 or radius <= 0 or height <= 0:
        return Mesh()
    j, i = np.divmod(np.arange(nu * (nv + 1)), nu)
    u = 2 * np.pi * i / nu
    return Mesh(np.stack([radius * np.cos(u), radius * np.sin(u), height * j / nv], axis=1), _cells(nu, nv, lambda i, j: j * nu + i % nu))


def mobius(n: int, radius: float = 1.0, width: float = 0.4) -> Mesh:
    """A strip of 2n vertices (bottom 2i, top 2i+1) whose seam swaps the two."""
    if n < 3 or width <= 0:
        return Mesh()
    i = np.arange(n)
    u = 2 * np.pi * i / n
    rows = []
    for s in (-0.5, 0.5):
        w = radius + s * width * np.cos(u / 2)
        rows.append(np.stack([w * np.cos(u), w * np.sin(u), s * width * np.sin(u / 2)], axis=1))
    k = (i + 1) % n
    swap = (i == n - 1).astype(int)
    a, b = 2 * i, 2 * i + 1
    c, d = 2 * k + swap, 2 * k + 1 - swap
    return Mesh(np.stack(rows, axis=1).reshape(-1, 3), np.stack([a, c, d, a, d, b], axis=1).reshape(-1, 3))


def icosphere(levels: int, radius: float = 1.0) -> Mesh:
    """Midpoint subdivision of the icosahedron; midpoints are numbered as faces first use them."""
    if levels < 0 or levels > 10 or radius <= 0:
        return Mesh()
    p = (1 + 5**0.5) / 2
    x = np.array([(-1, p, 0), (1, p, 0), (-1, -p, 0), (1, -p, 0), (0, -1, p), (0, 1, p), (0, -1, -p), (0, 1, -p), (p, 0, -1), (p, 0, 1), (-p, 0, -1), (-p, 0, 1)], float)
    # every triple of mutually adjacent vertices is a face; orient them outwards
    near = np.isclose(np.linalg.norm(x[:, None] - x[None], axis=2), 2.0)
    faces = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if near[a, b] and near[b, c] and near[a, c]]
    faces = np.array([(a, b, c) if np.dot(np.cross(x[b] - x[a], x[c] - x[a]), x[a]) > 0 else (a, c, b) for a, b, c in faces])
    for _ in range(levels):
        e = np.sort(faces[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1)
        key = e[:, 0] * len(x) + e[:, 1]
        u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        rank = np.empty(len(u), np.int64)
        rank[np.argsort(first)] = np.arange(len(u))
        mid = (len(x) + rank[inverse]).reshape(-1, 3)
        used = np.sort(first)
        x = np.concatenate([x, (x[e[used, 0]] + x[e[used, 1]]) / 2])
        (a, b, c), (ab, bc, ca) = faces.T, mid.T
        faces = np.stack([a, ab, ca, b, bc, ab, c, ca, bc, ab, bc, ca], axis=1).reshape(-1, 3)
    return Mesh(radius * x / np.linalg.norm(x, axis=1, keepdims=True), faces)


def plate_with_handle(n: int = 12, segments: int = 16, height: float = 0.35) -> Mesh:
    """A plate with two square holes, joined above it by an arched square tube: genus 1, one boundary."""
    if n < 6 or segments < 2 or height <= 0:
        return Mesh()
    j = n // 2
    left, right = n // 4, n - 1 - n // 4
    if right - left < 2:
        return Mesh()
    m = grid_with_holes(n, n, [(left, j), (right, j)])
    at = lambda i, j: j * (n + 1) + i
    start = [at(left, j), at(left + 1, j), at(left + 1, j + 1), at(left, j + 1)]
    # the far ring is met mirrored, as the tube turns over
    end = [at(right + 1, j), at(right, j), at(right, j + 1), at(right + 1, j + 1)]
    rings, points = [start], []
    for k in range(1, segments):
        t = k / segments
        c, s = np.cos(np.pi * t), np.sin(np.pi * t)
        ring = []
        for a, b in zip(start, end, strict=True):
            p, q = m.x[a], m.x[b]
            ring.append(len(m.x) + len(points))
            points.append([(p[0] + q[0]) / 2 + c * (p[0] - q[0]) / 2, p[1], s * abs(p[0] - q[0]) / 2 * height / 0.35])
        rings.append(ring)
    rings.append(end)
    faces = []
    for a, b in zip(rings[:-1], rings[1:], strict=True):
        for k in range(4):
            l = (k + 1) % 4
            faces += [(a[k], a[l], b[l]), (a[k], b[l], b[k])]
    return Mesh(np.concatenate([m.x, points]), np.concatenate([m.f, faces]))


def brick_grid(n: int, shift: float = 0.45) -> Mesh:
    """A grid whose alternate interior rows are shifted along x; boundary columns stay."""
    g = grid(n, n)
    if not len(g.x):
        return g
    j, i = np.divmod(np.arange(len(g.x)), n + 1)
    g.x[(j % 2 == 1) & (j < n) & (i > 0) & (i < n), 0] += shift / n
    return g


def synthetic_tooth(n: int = 140) -> Mesh:
    """One crown on a sloping gum over [-7, 7]^2: wall that ends at radius 4, four cusps, a cross fissure."""
    g = grid(n, n)
    if not len(g.x):
        return g
    x, y = 14 * g.x[:, 0] - 7, 14 * g.x[:, 1] - 7
    r = np.hypot(x, y)
    t = np.clip((4.0 - r) / 0.8, 0, 1)
    wall = 5.0 * t * t * (3 - 2 * t)
    cusps = sum(1.6 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * 0.8**2)) for a in (-1.8, 1.8) for b in (-1.8, 1.8))
    fissure = -0.8 * np.maximum(np.exp(-(x**2) / 0.18), np.exp(-(y**2) / 0.18)) * (r < 3)
    inside = r < 4
    return Mesh(np.stack([x, y, wall + (cusps + fissure) * inside + 0.05 * x], axis=1), g.f)


def tooth_labels(m: Mesh) -> np.ndarray:
    """36 on the crown, else 0."""
    return np.where(np.hypot(m.x[:, 0], m.x[:, 1]) < 4, 36, 0)


def defect_showcase() -> Mesh:
    """A 4 x 4 grid with every kind of defect at known ids, and a Mobius strip beside it.

    Edge 6-7 has three faces; vertex 24 joins two fans; vertex 28 is isolated; face 34 repeats the
    vertices of an earlier one; face 35 repeats an index; one grid face is turned over.
    """
    g = grid(4, 4)
    turned = 2 * (2 * 4 + 2)
    faces = g.f.copy()
    faces[turned] = faces[turned][[0, 2, 1]]
    fin, bow = 25, (26, 27)
    extra = [(6, 7, fin), (24, *bow), tuple(np.roll(faces[24], 1)), (0, 0, 1)]
    points = np.concatenate([g.x, [(0.4, 0.25, 0.3), (1.3, 1.0, 0.0), (1.3, 1.3, 0.0), (-0.5, -0.5, 0.0)]])
    strip = mobius(12, 0.35, 0.12)
    return append(Mesh(points, np.concatenate([faces, extra])), Mesh(strip.x + (2.0, 0.5, 0.0), strip.f))


PRESETS = {
    "icosphere": lambda: icosphere(4),
    "torus": lambda: torus(72, 24),
    "cylinder": lambda: cylinder(48, 15, 0.5),
    "grid": lambda: grid(16, 16),
    "holes": lambda: grid_with_holes(12, 12, [(3, 3), (8, 6)]),
    "plate": lambda: plate_with_handle(16, 24),
    "mobius": lambda: mobius(48),
    "defects": defect_showcase,
    "brick": lambda: brick_grid(30),
    "tooth": synthetic_tooth,
}


def preset(name: str) -> Mesh:
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name}")
    return PRESETS[name]()
