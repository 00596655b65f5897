"""Regularisation of many rings at once, as arrays: what `geometry.squared_up`, `geometry.simplify`, `offset.opened` and
`geometry.is_valid` say of a ring, one after another, for rings with finite coordinates. Rings of one length are worked on together, so a
step of the work costs a few array operations and not a few calls per ring or vertex; pairs of edges go in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .offset import blocks_of, opened_all


def _by_length(points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of rings of one length and their vertices ``(rings, vertices, 2)``, a bounded number of vertices at a time."""
    start = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        for part in np.array_split(which, max(len(which) * n // (1 << 16), 1)):
            yield part, points[start[part][:, None] + np.arange(n)]


def area(p: np.ndarray) -> np.ndarray:
    x, y = p[..., 0], p[..., 1]
    return np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(1) / 2)


def hulls(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed convex hulls by wrapping from the lowest vertex on, filled up with their last vertex, and their lengths."""
    x, y = p[..., 0] + 0.0, p[..., 1] + 0.0
    y0 = y.min(1)
    first = np.stack([np.where(y == y0[:, None], x, np.inf).min(1), y0], 1)
    hull, size, going = [first], np.ones(len(p), np.int64), np.arange(len(p))
    for _ in range(p.shape[1]):
        cx, cy = hull[-1][going, :1], hull[-1][going, 1:]
        at = np.broadcast_to(np.arange(p.shape[1]), (len(going), p.shape[1]))
        bx, by = x[going] - cx, y[going] - cy
        while at.shape[1] > 1:                          # of two vertices, the one that has the other on its left, the farther one on a line
            half = (at.shape[1] + 1) // 2
            m = at.shape[1] - half
            ax, ay, qx, qy = bx[:, :m], by[:, :m], bx[:, half:], by[:, half:]
            turn = ax * qy - ay * qx
            take = (turn < 0) | ((turn == 0) & (qx * qx + qy * qy > ax * ax + ay * ay))
            take = ((ax == 0) & (ay == 0)) | (take & ((qx != 0) | (qy != 0)))
            bx, by, at = (np.concatenate([np.where(take, v[:, half:], v[:, :m]), v[:, m:half]], 1) for v in (bx, by, at))
        cur = hull[-1].copy()
        cur[going] = np.stack([x[going, at[:, 0]], y[going, at[:, 0]]], 1)
        hull.append(cur)
        size[going] += 1
        going = going[(cur[going] != first[going]).any(1)]
        if not len(going):
            break
    return np.stack(hull, 1), size


def rectangles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest rotated rectangle around each closed hull as a ring, and its area; one side lies on a hull edge."""
    d = np.diff(h, axis=1)
    u = np.hypot(d[..., 0], d[..., 1])
    real, safe = u > 0, np.where(u > 0, u, 1.0)
    dx, dy, px, py = d[:, :, None, 0], d[:, :, None, 1], h[:, None, :, 0], h[:, None, :, 1]
    along, across = (px * dx + py * dy) / safe[..., None], (py * dx - px * dy) / safe[..., None]
    a0, a1, b0, b1 = along.min(2), along.max(2), across.min(2), across.max(2)
    keys = [(a1 - a0) * (b1 - b0), d[..., 0] / safe, d[..., 1] / safe, a0, a1, b0, b1]
    best = real
    for k in keys:                                      # the least one, by the area and then by the others in turn
        low = np.where(best, k, np.inf)
        best = best & (low == low.min(1)[:, None])
    at = np.arange(len(h)), best.argmax(1)
    size, ux, uy, a0, a1, b0, b1 = (k[at] for k in keys)
    corner = lambda a, b: np.stack([a * ux - b * uy, a * uy + b * ux], 1)
    return np.stack([corner(a0, b0), corner(a1, b0), corner(a1, b1), corner(a0, b1), corner(a0, b0)], 1), size


def squared(p: np.ndarray, min_fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rings fill more than ``min_fill`` of their smallest rotated rectangle, and these rectangles."""
    fits, rect = np.zeros(len(p), bool), np.zeros((len(p), 5, 2))
    if p.shape[1] > 2:
        hull, size = hulls(p)
        at = np.flatnonzero(size > 3)
        for some, _, _ in blocks_of(len(at), hull.shape[1]):
            k = at[some]
            if len(k):
                rect[k], whole = rectangles(hull[k])
                fits[k] = area(p[k]) > 0
                fits[k] &= np.divide(area(p[k]), whole, out=np.zeros(len(k)), where=whole != 0) > min_fill
    return fits, rect[fits]


def kept(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of each ring stay when it is thinned in one walk along it."""
    many, n = p.shape[:2]
    stay = np.ones((many, n), bool)
    if n <= 5:
        return stay
    stay[:, 1:-1] = False
    last, row = np.zeros(many, np.int64), np.arange(many)
    for i in range(2, n):
        low = int(last.min()) + 1
        a, b, v = p[row, last], p[:, i], p[:, low:i]
        e, w = b - a, v - a[:, None]
        base = np.hypot(e[:, 0], e[:, 1])[:, None]
        off = np.abs(e[:, None, 0] * w[..., 1] - e[:, None, 1] * w[..., 0])
        near = np.where(base > 0, off < tolerance * base, np.hypot(w[..., 0], w[..., 1]) < tolerance) if (base == 0).any() else off < tolerance * base
        turn = ~(near | (np.arange(low, i) <= last[:, None])).all(1)
        stay[turn, i - 1] = True
        last[turn] = i - 1
    stay[stay.sum(1) < 5] = True
    return stay


def valid(p: np.ndarray) -> np.ndarray:
    """Closed, at least four points, an area, and no two edges meet that are not neighbours."""
    ok = (p[:, 0] == p[:, -1]).all(1) & (area(p) > 0) if p.shape[1] > 3 else np.zeros(len(p), bool)
    at = np.flatnonzero(ok)
    p = p[at]
    x, y = p[..., 0], p[..., 1]
    x1, y1, x2, y2 = x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]
    lx, hx, ly, hy = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    n = x1.shape[1]
    for some, first, stop in blocks_of(len(p), n) if len(p) else ():
        pairs = (hx[some, first:stop, None] >= lx[some, None]) & (hx[some, None] >= lx[some, first:stop, None])
        pairs &= hy[some, first:stop, None] >= ly[some, None]
        pairs &= hy[some, None] >= ly[some, first:stop, None]
        e, f = np.arange(first, stop)[:, None], np.arange(n)[None]
        pairs &= (f > e + 1) & ~((e == 0) & (f == n - 1))
        k, e, f = np.unravel_index(np.flatnonzero(pairs), pairs.shape)
        k, e = k + some.start, e + first
        cross = lambda j, px, py: (x2[k, j] - x1[k, j]) * (py - y1[k, j]) - (y2[k, j] - y1[k, j]) * (px - x1[k, j])
        meet = cross(f, x1[k, e], y1[k, e]) * cross(f, x2[k, e], y2[k, e]) <= 0
        meet &= cross(e, x1[k, f], y1[k, f]) * cross(e, x2[k, f], y2[k, f]) <= 0
        ok[at[k[meet]]] = False
    return ok


def regularized(points: np.ndarray, sizes: np.ndarray, tolerance: float, distance: float, min_fill: float | None) -> list[np.ndarray]:
    """Rings that lie one after another in ``points``, each as its smallest rectangle if it fills it, else thinned and, for a positive
    ``distance``, smoothed; as it was where its new form is empty or not valid."""
    start = np.cumsum(sizes) - sizes
    out: list[np.ndarray] = [points[a: a + n] for a, n in zip(start.tolist(), sizes.tolist())]
    thin: dict[int, np.ndarray] = {}
    for which, p in _by_length(points, sizes):
        if min_fill is not None:
            fits, rect = squared(p, min_fill)
            for i, r in zip(which[fits].tolist(), rect):
                out[i] = r
            which, p = which[~fits], p[~fits]
        for i, r, stay in zip(which.tolist(), p, kept(p, tolerance) if len(p) else ()):
            thin[i] = r[stay]
    new = list(thin.values())
    if distance > 0 and new:
        new = opened_all(np.concatenate(new), np.array([len(r) for r in new]), distance)
    there = [(i, r) for i, r in zip(thin, new) if r is not None and len(r) > 3]
    if there:
        for which, p in _by_length(np.concatenate([r for _, r in there]), np.array([len(r) for _, r in there])):
            for k in which[valid(p)].tolist():
                out[there[k][0]] = there[k][1]
    return out
