"""Margin labelling on one scan: seeds, learned terms, cuts, star prior, features, comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessera.operators.learn import Logistic
from tessera.sources.meshes import Mesh

from .cuts import MaxFlow, alpha_expansion, star_repair
from .surface import Intrinsic, Operators, adjacency, component_labels, dijkstra, edges_of
from .teeth import cusps, curvatures, diffuse, largest_component, mean_and_gauss, occlusal_axis, pick

HARD, FLOOR = 1e12, 1e-6
NO_GROUPS = 1e8  # a grouping limit from here on makes every tip a tooth of its own

# The order and names of the features that trained models are stored with.
SEED_FEATURES = ["prominence_mm", "height_quantile", "normal_dot_axis", "distance_to_cut_mm", "smoothed_mean_curvature", "smoothed_gaussian_curvature"]
VERTEX_FEATURES = ["log_dG_over_dT", "height_quantile", "normal_dot_axis", "kappa_min", "kappa_max", "log1p_dist_to_cut", "log1p_dist_to_tooth_seed", "height_quantile_sq", "normal_dot_axis_sq"]
FAR, CURVATURE_LIMIT, LOG_LIMIT = 100.0, 20.0, 30.0


@dataclass
class MarginParams:
    """The operating point; ``method``: plane, voronoi, graph_cut or per_tooth.

    ``seed_model`` drops tips whose probability is below ``seed_threshold``; ``vertex_model`` adds
    ``vertex_weight`` times its log-likelihood to both cuts; vertices in ``seed_veto`` seed no tooth.
    ``star`` keeps each tooth connected to its tips along shortest paths, crease-weighted ones or,
    with ``star_plain``, plain ones. Between two teeth the deeper vertex of an edge below
    ``strip_kmin`` becomes gum.
    """

    method: str = "per_tooth"
    plane_q: float = 0.5
    valley_weight: float = 2560.0
    sigma: float = 0.0
    gingiva_q: float = 0.15
    tooth_q: float = 1.0
    mu: float = 1000.0
    beta: float = 300.0
    tau: float = -1.25
    strip_kmin: float = -np.inf
    sweeps: int = 3
    star: bool = False
    star_plain: bool = False
    label_radius: float = 15.0
    expansion_radius: float = 3.0
    min_area: float = 0.0
    cusp_seeds: bool = True
    tip_q: float = 0.0
    seed_model: Logistic | None = None
    seed_threshold: float = 0.5
    seed_veto: np.ndarray | None = None
    vertex_model: Logistic | None = None
    vertex_weight: float = 1.0


@dataclass
class Inputs:
    """What all methods share on one scan."""

    mesh: Mesh
    axis: np.ndarray
    arch: np.ndarray
    height: np.ndarray
    cut: np.ndarray
    kmin: np.ndarray
    kmax: np.ndarray
    ops: Operators
    tips: np.ndarray
    scores: np.ndarray
    edges: tuple = field(default_factory=tuple)


def margin_inputs(m: Mesh, with_cusps: bool = True, axis: np.ndarray | None = None, tips: tuple[np.ndarray, np.ndarray] | None = None, **cusp) -> Inputs:
    """``tips``: vertices and scores known already; else they are detected with the arguments in ``cusp``."""
    arch = largest_component(m)
    axis = occlusal_axis(m, arch) if axis is None else axis
    t = Intrinsic(m)
    rim = np.zeros(len(m.x), bool)
    rim[t.origin[t.twin < 0]] = True
    _, kmax, kmin = (np.nan_to_num(k) for k in curvatures(m))
    if tips is None:
        tips = cusps(m, axis=axis, **cusp) if with_cusps else (np.zeros(0, np.int64), np.zeros(0))
    return Inputs(m, axis, arch, m.x @ axis, rim & arch, kmin, kmax, Operators(t), np.asarray(tips[0], np.int64), np.asarray(tips[1], float), edges_of(m))


def valley_strength(i: Inputs, sigma: float) -> np.ndarray:
    """How concave a vertex is: the least curvature, smoothed to ``sigma``, below zero."""
    return np.maximum(0, -diffuse(i.ops, i.kmin, sigma))


def height_rank(i: Inputs) -> np.ndarray:
    """Share of the arch's vertices that lie strictly lower."""
    h = np.sort(i.height[i.arch])
    return np.searchsorted(h, i.height, side="left") / max(1, len(h))


def axis_cosine(m: Mesh, axis: np.ndarray) -> np.ndarray:
    """Cosine between each vertex's area-weighted normal and the axis; 0 without a normal."""
    p, normal = m.x[m.f], np.zeros((len(m.x), 3))
    face = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    for k in range(3):
        np.add.at(normal, m.f[:, k], face)
    size = np.linalg.norm(normal, axis=1)
    return np.where(size > 0, normal @ axis / np.where(size > 0, size, 1), 0.0)


def seed_features(i: Inputs) -> np.ndarray:
    """One row of :data:`SEED_FEATURES` for each tip."""
    if not len(i.tips):
        return np.zeros((0, len(SEED_FEATURES)))
    mean, gauss = (diffuse(i.ops, np.nan_to_num(k), 0.5) for k in mean_and_gauss(i.mesh))
    rim = i.mesh.x[i.cut]
    to_cut = [np.linalg.norm(rim - i.mesh.x[t], axis=1).min() if len(rim) else FAR for t in i.tips]
    return np.stack([i.scores, height_rank(i)[i.tips], axis_cosine(i.mesh, i.axis)[i.tips], to_cut, mean[i.tips], gauss[i.tips]], axis=1)


def seeds(i: Inputs, p: MarginParams) -> tuple[np.ndarray, np.ndarray]:
    """-1 open, 0 gum, 1 tooth per vertex, and the tips that seed; the cut overrides heights, tips the cut."""
    h, n = i.height[i.arch], len(i.height)
    free = np.ones(n, bool) if p.seed_veto is None else ~np.asarray(p.seed_veto, bool)
    out = np.full(n, -1)
    out[i.arch & free & (i.height >= pick(h, p.tooth_q))] = 1
    out[i.arch & (i.height <= pick(h, p.gingiva_q))] = 0
    out[i.cut] = 0
    use = free[i.tips] & p.cusp_seeds
    if p.tip_q > 0:
        use &= i.height[i.tips] >= pick(h, p.tip_q)
    if p.seed_model is not None and len(i.tips):
        use &= p.seed_model.probabilities(seed_features(i)) >= p.seed_threshold
    out[i.tips[use]] = 1
    return out, i.tips[use]


def _fields(i: Inputs, valley: np.ndarray, p: MarginParams, label: np.ndarray):
    u, v, length = i.edges
    graph = adjacency(len(i.height), u, v, length * (1 + p.valley_weight * (valley[u] + valley[v]) / 2))
    gum, tooth = (dijkstra(len(i.height), graph, np.flatnonzero(label == k).tolist(), allowed=i.arch)[0] for k in (0, 1))
    return graph, gum, tooth


def _vertex_rows(i: Inputs, label: np.ndarray, gum: np.ndarray, tooth: np.ndarray) -> np.ndarray:
    n = len(i.height)
    plain = adjacency(n, *i.edges)
    to_cut, to_seed = (dijkstra(n, plain, np.flatnonzero(s).tolist(), allowed=i.arch)[0] for s in (i.cut, label == 1))
    log = lambda d: np.where(np.isfinite(d), np.log(d + 1e-9), LOG_LIMIT)
    log1p = lambda d: np.log1p(np.where(np.isfinite(d), d, FAR))
    ratio = np.clip(log(gum) - log(tooth), -LOG_LIMIT, LOG_LIMIT)
    bent = [np.clip(k, -CURVATURE_LIMIT, CURVATURE_LIMIT) for k in (i.kmin, i.kmax)]
    rank, cosine = height_rank(i), axis_cosine(i.mesh, i.axis)
    rows = np.stack([ratio, rank, cosine, *bent, log1p(to_cut), log1p(to_seed), rank**2, cosine**2], axis=1)
    return np.where(i.arch[:, None], rows, 0.0)


def vertex_features(i: Inputs, p: MarginParams) -> np.ndarray:
    """One row of :data:`VERTEX_FEATURES` for each vertex; zeros off the arch."""
    label, _ = seeds(i, p)
    _, gum, tooth = _fields(i, valley_strength(i, p.sigma), p, label)
    return _vertex_rows(i, label, gum, tooth)


def _learned(i: Inputs, p: MarginParams, label: np.ndarray, gum: np.ndarray, tooth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the vertex model adds to the cost of (gum, tooth)."""
    if p.vertex_model is None:
        return np.zeros(len(gum)), np.zeros(len(gum))
    q = np.where(i.arch, np.clip(p.vertex_model.probabilities(_vertex_rows(i, label, gum, tooth)), 1e-6, 1 - 1e-6), 0.5)
    a = p.vertex_weight * i.ops.star0
    return -a * np.log(1 - q), -a * np.log(q)


def _pair_weights(i: Inputs, valley: np.ndarray, p: MarginParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interior arch edges with their dual length, made cheap along valleys."""
    o, t = i.ops, adjacency_count(i.mesh)
    length = np.linalg.norm(i.mesh.x[o.u] - i.mesh.x[o.v], axis=1)
    dual = np.maximum(o.star1, 0) * length
    keep = i.arch[o.u] & i.arch[o.v] & (dual > 0) & (t > 1)
    w = p.mu * dual / (1 + p.beta * (valley[o.u] + valley[o.v]) / 2)
    return o.u[keep], o.v[keep], w[keep]


def adjacency_count(m: Mesh) -> np.ndarray:
    """Faces at each edge, in the order of :class:`Operators` (and of :func:`edges_of`)."""
    e = np.sort(m.f[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1)
    return np.unique(e, axis=0, return_counts=True)[1] if len(e) else np.zeros(0, int)


def _binary_cut(i: Inputs, valley: np.ndarray, p: MarginParams, label: np.ndarray, gum: np.ndarray, tooth: np.ndarray, learned) -> np.ndarray:
    both = gum + tooth
    # where no tooth front arrives it's gum, else where no gum front arrives it's tooth
    prob = np.where(np.isinf(tooth), 0.0, np.where(np.isinf(gum), 1.0, np.divide(gum, both, out=np.full(len(gum), 0.5), where=np.isfinite(both) & (both > 0))))
    area = i.ops.star0
    as_gum, as_tooth = learned[0] - area * np.log(np.maximum(1 - prob, FLOOR)), learned[1] - area * np.log(np.maximum(prob, FLOOR))
    g = MaxFlow(len(gum))
    for v in np.flatnonzero(i.arch).tolist():
        if label[v] >= 0:
            g.add_terminal(v, HARD * (label[v] == 1), HARD * (label[v] == 0))
        else:
            g.add_terminal(v, as_gum[v], as_tooth[v])
    for a, b, w in zip(*(x.tolist() for x in _pair_weights(i, valley, p)), strict=True):
        g.add_edge(a, b, w, w)
    g.solve()
    return g.source_side() & i.arch


def group_tips(m: Mesh, tips: np.ndarray, region: np.ndarray, kmin: np.ndarray, tau: float) -> np.ndarray:
    """Tips joined by paths through the region above curvature tau share a group; -1 outside it."""
    if tau >= NO_GROUPS:
        inside = region[tips].astype(bool)
        return np.where(inside, np.cumsum(inside) - 1, -1)
    u, v, _ = edges_of(m)
    ok = region & (kmin > tau)
    e = ok[u] & ok[v]
    label = component_labels(len(m.x), u[e], v[e])
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(label[t]), len(seen)) if ok[t] else -1 for t in tips.tolist()], np.int64)


def margin_labels(i: Inputs, p: MarginParams) -> np.ndarray:
    """0 gum, 1.. teeth (a single label 1 for the binary methods)."""
    if p.method == "plane":
        return (i.arch & (i.height >= pick(i.height[i.arch], p.plane_q))).astype(int)
    valley = valley_strength(i, p.sigma)
    label, tips = seeds(i, p)
    graph, gum, tooth = _fields(i, valley, p, label)
    if p.method == "voronoi":
        labels = (i.arch & (tooth < gum)).astype(int)
    else:
        learned = _learned(i, p, label, gum, tooth)
        labels = _binary_cut(i, valley, p, label, gum, tooth, learned).astype(int)
        if p.method == "per_tooth":
            labels = _per_tooth(i, valley, p, labels, graph, label, tips, gum, learned)
    return drop_small(i, labels, p.min_area) if p.min_area > 0 else labels


def _per_tooth(i: Inputs, valley: np.ndarray, p: MarginParams, binary: np.ndarray, graph, label: np.ndarray, tips: np.ndarray, gum: np.ndarray, learned) -> np.ndarray:
    group = group_tips(i.mesh, tips, binary > 0, i.kmin, p.tau)
    count = int(group.max(initial=-1)) + 1
    if count < 2:
        return binary
    n = len(binary)
    d, trees = np.concatenate([gum[:, None], np.full((n, count), np.inf)], axis=1), np.tile(np.arange(n), (count + 1, 1))
    plain = adjacency(n, *i.edges) if p.star and p.star_plain else None
    for g in range(count):
        own = tips[group == g]
        close = i.arch.copy()
        if p.label_radius > 0:
            close &= np.min([np.linalg.norm(i.mesh.x - i.mesh.x[t], axis=1) for t in own], axis=0) <= p.label_radius
        d[:, g + 1], _, parent = dijkstra(n, graph, own.tolist(), allowed=close)
        if p.star:
            trees[g + 1] = parent if plain is None else dijkstra(n, plain, own.tolist(), allowed=close)[2]
            trees[g + 1, own] = own
    inverse = 1 / np.maximum(d, 1e-12)
    share = inverse / np.maximum(inverse.sum(1, keepdims=True), 1e-300)
    unary = -i.ops.star0[:, None] * np.log(np.maximum(share, FLOOR)) + np.concatenate([learned[0][:, None], np.repeat(learned[1][:, None], count, axis=1)], axis=1)
    fixed = np.where(i.arch, np.where(label == 0, 0, -1), 0)
    fixed[tips[group >= 0]] = group[group >= 0] + 1
    held = np.flatnonzero(fixed >= 0)
    unary[held] = HARD
    unary[held, fixed[held]] = 0
    start = np.where(fixed >= 0, fixed, np.where(binary > 0, 1 + unary[:, 1:].argmin(1), 0))
    cell = np.floor(i.mesh.x / p.expansion_radius).astype(np.int64) if p.expansion_radius > 0 else None

    def candidates(alpha: int, labels: np.ndarray) -> np.ndarray:
        """Vertices in or beside a grid cell that holds the label now."""
        if alpha == 0 or cell is None:
            return np.ones(n, bool)
        have = {tuple(c) for c in np.unique(cell[labels == alpha], axis=0).tolist()}
        wide = {(c[0] + a, c[1] + b, c[2] + k) for c in have for a in (-1, 0, 1) for b in (-1, 0, 1) for k in (-1, 0, 1)}
        return np.array([tuple(c) in wide for c in cell.tolist()])

    if p.star:
        start = star_repair(start, trees)
    a, b, w = _pair_weights(i, valley, p)
    labels = alpha_expansion(unary, a, b, w, start, p.sweeps, candidates, trees if p.star else None)
    u, v, _ = i.edges
    between = (labels[u] > 0) & (labels[v] > 0) & (labels[u] != labels[v])
    deeper = np.where(i.kmin[u] <= i.kmin[v], u, v)[between]
    labels[deeper[(i.kmin[deeper] < p.strip_kmin) & (fixed[deeper] < 0)]] = 0
    return labels


def drop_small(i: Inputs, labels: np.ndarray, min_area: float) -> np.ndarray:
    """Connected tooth regions, of whatever teeth, with less lumped area become gum."""
    u, v, _ = i.edges
    same = (labels[u] > 0) & (labels[v] > 0)
    comp = component_labels(len(labels), u[same], v[same])
    area = np.bincount(comp, i.ops.star0 * (labels > 0), len(labels))
    return np.where((labels > 0) & (area[comp] < min_area), 0, labels)


def margin_edges(m: Mesh, labels: np.ndarray) -> np.ndarray:
    u, v, _ = edges_of(m)
    cut = labels[u] != labels[v]
    return np.stack([u[cut], v[cut]], axis=1)


def compare_boundaries(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Midpoint sets: ASSD, HD95, F1 at .25 and .5; inf and 0 if either is empty."""
    if not len(a) or not len(b):
        return {"assd": np.inf, "hd95": np.inf, "f1_025": 0.0, "f1_050": 0.0}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    p, q = d.min(1), d.min(0)
    f1 = {}
    for name, t in (("f1_025", 0.25), ("f1_050", 0.5)):
        precision, recall = (p <= t).mean(), (q <= t).mean()
        f1[name] = 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0
    return {"assd": float(np.concatenate([p, q]).mean()), "hd95": max(pick(p, 0.95), pick(q, 0.95)), **f1}


def breakdown(m: Mesh, area: np.ndarray, predicted: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    """Where a labelling errs: areas missed and added, and teeth of which less than half is covered."""
    p = predicted > 0
    teeth_ = [k for k in np.unique(truth) if k]
    covered = [area[(truth == k) & p].sum() / max(area[truth == k].sum(), 1e-300) for k in teeth_]
    return {"missed_area": float(area[(truth > 0) & ~p].sum()), "added_area": float(area[(truth == 0) & p].sum()), "teeth": len(teeth_), "missed_teeth": int(sum(c < 0.5 for c in covered))}
