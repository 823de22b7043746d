"""Intraoral scans: fields on one mesh and cusp detection."""

from __future__ import annotations

import numpy as np

from tessera.sources.meshes import Mesh

from .linear import conjugate_gradient
from .surface import Intrinsic, Operators, component_labels, edges_of


def pick(values: np.ndarray, q: float) -> float:
    """sorted[floor(q (n - 1))]."""
    return float(np.sort(values)[int(q * (len(values) - 1))]) if len(values) else 0.0


def mean_and_gauss(m: Mesh) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Gaussian curvature per vertex with mixed areas; NaN on boundaries and where the area is zero."""
    n, p = len(m.x), m.x[m.f]
    area = np.linalg.norm(np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]), axis=1) / 2
    ang, cot = np.zeros((len(m.f), 3)), np.zeros((len(m.f), 3))
    for k in range(3):
        u, w = p[:, (k + 1) % 3] - p[:, k], p[:, (k + 2) % 3] - p[:, k]
        s, c = np.linalg.norm(np.cross(u, w), axis=1), (u * w).sum(1)
        ang[:, k] = np.arctan2(s, c)
        cot[:, k] = np.where(s > 0, c / np.where(s > 0, s, 1), 0)
    obtuse = ang.max(1) > np.pi / 2
    turn, mixed, pull, normal = np.zeros(n), np.zeros(n), np.zeros((n, 3)), np.zeros((n, 3))
    face = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        u, w = p[:, i] - p[:, k], p[:, j] - p[:, k]
        np.add.at(turn, m.f[:, k], ang[:, k])
        part = np.where(obtuse, np.where(ang[:, k] > np.pi / 2, area / 2, area / 4), ((u * u).sum(1) * cot[:, j] + (w * w).sum(1) * cot[:, i]) / 8)
        np.add.at(mixed, m.f[:, k], np.where(area > 0, part, 0))
        np.add.at(pull, m.f[:, k], -(u * cot[:, j, None] + w * cot[:, i, None]))
        np.add.at(normal, m.f[:, k], face)
    edge, count = np.unique(np.sort(m.f[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1), axis=0, return_counts=True)
    rim = np.zeros(n, bool)
    rim[edge[count == 1]] = True
    inner = ~rim & (mixed > 0)
    size = np.linalg.norm(normal, axis=1)
    a = np.where(inner, mixed, 1)
    mean = np.where(size > 0, (pull * normal).sum(1) / np.where(size > 0, size, 1), 0) / (4 * a)
    nan = np.where(inner, 0, np.nan)
    return mean + nan, (2 * np.pi - turn) / a + nan


def curvatures(m: Mesh) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k1, k2) per vertex, with NaN as :func:`mean_and_gauss` has it."""
    mean, gauss = mean_and_gauss(m)
    root = np.sqrt(np.maximum(mean**2 - gauss, 0))
    return mean, mean + root, mean - root


def intrinsic_curvatures(m: Mesh) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k1, k2) with mixed areas and cotangents of the intrinsic Delaunay triangulation.

    Angle defects stay those of the faces as given; faces of no area are left out of the areas.
    """
    n = len(m.x)
    t = Intrinsic(m)
    rim = np.zeros(n, bool)
    rim[t.origin[t.twin < 0]] = True
    rim[t.dest(np.flatnonzero(t.twin < 0))] = True
    turn = np.bincount(t.origin, np.arctan2(1.0, t.cotangents().reshape(-1, 3)[:, [1, 2, 0]].ravel()), n)
    t.to_delaunay()
    area, l2, cot = t.areas(), t.len.reshape(-1, 3) ** 2, t.cotangents().reshape(-1, 3)
    f, mixed, pull = t.origin.reshape(-1, 3), np.zeros(n), np.zeros((n, 3))
    obtuse = (cot < 0).any(1)
    for k in range(3):
        # corner k lies opposite edge k + 1; its own edges are k and k + 2
        i, j = (k + 1) % 3, (k + 2) % 3
        part = np.where(obtuse, np.where(cot[:, i] < 0, area / 2, area / 4), (l2[:, k] * cot[:, k] + l2[:, j] * cot[:, j]) / 8)
        np.add.at(mixed, f[:, k], np.where(area > 0, part, 0))
        e = cot[:, k, None] * (m.x[f[:, i]] - m.x[f[:, k]])
        np.add.at(pull, f[:, k], -e)
        np.add.at(pull, f[:, i], e)
    p = m.x[m.f]
    normal = np.zeros((n, 3))
    for k in range(3):
        np.add.at(normal, m.f[:, k], np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]))
    inner = ~rim & (mixed > 0)
    a, size = np.where(inner, mixed, 1), np.linalg.norm(normal, axis=1)
    mean = np.where(size > 0, (pull * normal).sum(1) / np.where(size > 0, size, 1), 0) / (4 * a)
    root = np.sqrt(np.maximum(mean**2 - (2 * np.pi - turn) / a, 0))
    nan = np.where(inner, 0, np.nan)
    return mean + nan, mean + root + nan, mean - root + nan


def diffuse(ops: Operators, f: np.ndarray, sigma: float, tol: float = 1e-4) -> np.ndarray:
    """(star0 - t L) x = star0 f with t = sigma^2 / 2."""
    s0 = np.where(ops.star0 > 0, ops.star0, 1.0)
    return conjugate_gradient(ops.l.plus_diagonal(-sigma * sigma / 2, s0), s0 * f, tol)[0] if sigma > 0 else f.copy()


def prominence(ops: Operators, f: np.ndarray, radius: float, tol: float = 1e-4) -> np.ndarray:
    """f less its diffusion, solved for directly: (star0 - t L) p = -t L f."""
    t, s0 = radius * radius / 2, np.where(ops.star0 > 0, ops.star0, 1.0)
    return conjugate_gradient(ops.l.plus_diagonal(-t, s0), -t * (ops.l @ f), tol)[0]


def largest_component(m: Mesh) -> np.ndarray:
    u, v, _ = edges_of(m)
    label = component_labels(len(m.x), u, v)
    used = np.zeros(len(m.x), bool)
    used[m.f] = True
    count = np.bincount(label[used], minlength=len(m.x))
    return used & (label == count.argmax())


def occlusal_axis(m: Mesh, mask: np.ndarray) -> np.ndarray:
    """Direction of least variance, away from the mean of the boundary half-edges' origins."""
    if not mask.any():
        return np.array([0.0, 0.0, 1.0])
    x = m.x[mask]
    mid = x.mean(0)
    axis = np.linalg.eigh(np.cov((x - mid).T, bias=True))[1][:, 0]
    t = Intrinsic(m)
    rim = t.origin[(t.twin < 0)]
    rim = rim[mask[rim]]
    away = mid - m.x[rim].mean(0) if len(rim) else np.array([0.0, 0.0, 1.0])
    return axis if axis @ away >= 0 else -axis


def local_maxima(m: Mesh, score: np.ndarray, threshold: float) -> np.ndarray:
    u, v, _ = edges_of(m)
    top = np.full(len(score), -np.inf)
    np.maximum.at(top, u, score[v])
    np.maximum.at(top, v, score[u])
    used = np.zeros(len(score), bool)
    used[u], used[v] = True, True
    return np.flatnonzero(used & (score > threshold) & (score > top))


def suppress(x: np.ndarray, ids: np.ndarray, score: np.ndarray, radius: float) -> np.ndarray:
    kept: list[int] = []
    for i in sorted(ids.tolist(), key=lambda i: (-score[i], i)):
        if all(np.linalg.norm(x[i] - x[j]) >= radius for j in kept):
            kept.append(i)
    return np.array(kept, np.int64)


def cusps(m: Mesh, method: str = "prominence", sigma: float = 0.5, radius: float = 4.0, height_q: float = 0.5, threshold: float = 1.3, nms: float = 3.5, axis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, scores), strongest first. Methods: raw and smoothed mean curvature, occlusal prominence."""
    mask = largest_component(m)
    axis = occlusal_axis(m, mask) if axis is None else axis
    height = m.x @ axis
    mean = np.nan_to_num(curvatures(m)[0])
    ops = Operators(Intrinsic(m))
    smooth = mean if method == "raw" else diffuse(ops, mean, sigma)
    score = prominence(ops, height, radius) if method == "prominence" else smooth
    gate = mask & (height >= pick(height[mask], height_q)) & (smooth > 0)
    score = np.where(gate, score, -np.inf)
    kept = suppress(m.x, local_maxima(m, score, threshold), score, nms)
    return kept, score[kept]
