"""Offset curves of rings: shrinking and growing by a distance, also far below a pixel.

Every edge is shifted by the distance; where the shifted edges part, an arc of the vertex joins them, where they cross, the curve goes through the
vertex itself. The raw curve then winds around the result once and around nothing else more than zero times, so the result is
the region of positive winding: the curve is cut at its crossings, and the pieces with that region on one side only are its boundary.
"""

from __future__ import annotations

import numpy as np

QUADRANT = 16                   # segments of a quarter circle
_STEP = np.pi / 2 / QUADRANT


def signed_area(p: np.ndarray) -> float:
    """Of an open list of vertices."""
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _open(ring: np.ndarray) -> np.ndarray:
    """Vertices without the repeated end and without repetitions."""
    p = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    return p[(p != np.roll(p, 1, 0)).any(1)] if len(p) else p


def _frame(p: np.ndarray):
    """Edge vectors, lengths, unit vectors and left normals, and the turn at every vertex."""
    e = np.roll(p, -1, 0) - p
    size = np.hypot(e[:, 0], e[:, 1])
    u = e / size[:, None]
    before = np.roll(u, 1, 0)
    turn = np.arctan2(before[:, 0] * u[:, 1] - before[:, 1] * u[:, 0], (before * u).sum(1))
    return size, u, np.column_stack([-u[:, 1], u[:, 0]]), turn


def _arc(centre: np.ndarray, radius: float, start: float, turn: float) -> np.ndarray:
    n = max(int(abs(turn) / _STEP + 0.5), 1)
    a = start + turn * np.arange(n + 1) / n
    return centre + radius * np.column_stack([np.cos(a), np.sin(a)])


def _raw(p: np.ndarray, d: float) -> np.ndarray:
    """Raw offset curve of a ring with its inside to the left; d > 0 grows."""
    _, _, normal, turn = _frame(p)
    shift = -d * normal
    out = []
    for i in range(len(p)):
        came, goes = p[i] + shift[i - 1], p[i] + shift[i]
        if turn[i] * d > 0:
            out.append(_arc(p[i], abs(d), np.arctan2(*(came - p[i])[::-1]), turn[i]))
        elif turn[i] == 0:
            out.append(goes[None])
        else:
            out.append(np.stack([came, p[i], goes]))
    return np.concatenate(out)


def _split(a: np.ndarray, b: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut where they meet others."""
    n = len(a)
    d = b - a
    cross = lambda x, y: x[..., 0] * y[..., 1] - x[..., 1] * y[..., 0]
    cuts: list[list[np.ndarray]] = [[np.array([0.0, 1.0])] for _ in range(n)]
    size = np.hypot(d[:, 0], d[:, 1])
    for i in range(n - 1):
        e, f = d[i], d[i + 1:]
        w = a[i + 1:] - a[i]
        det = cross(e, f)
        flat = np.abs(det) <= 1e-12 * size[i] * size[i + 1:]
        safe = np.where(flat, 1.0, det)
        t, s = cross(w, f) / safe, cross(w, e) / safe
        et, es = tiny / size[i], tiny / size[i + 1:]
        hit = ~flat & (t >= -et) & (t <= 1 + et) & (s >= -es) & (s <= 1 + es)
        for j in np.flatnonzero(hit).tolist():
            cuts[i].append(np.array([t[j]]))
            cuts[i + 1 + j].append(np.array([s[j]]))
        along = flat & (np.abs(cross(w, e)) <= tiny * size[i])
        for j in np.flatnonzero(along).tolist():                         # on one line: each one's ends cut the other
            k = i + 1 + j
            cuts[i].append(np.array([(w[j] @ e), ((b[k] - a[i]) @ e)]) / size[i] ** 2)
            cuts[k].append(np.array([((a[i] - a[k]) @ d[k]), ((b[i] - a[k]) @ d[k])]) / size[k] ** 2)
    begin, end = [], []
    for i in range(n):
        t = np.unique(np.clip(np.concatenate(cuts[i]), 0, 1))
        at = a[i] + t[:, None] * d[i]
        begin.append(at[:-1])
        end.append(at[1:])
    return np.concatenate(begin), np.concatenate(end)


def _winding(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = q[:, :1], q[:, 1:]
    left = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (x - a[:, 0]) * (b[:, 1] - a[:, 1])
    up = (a[:, 1] <= y) & (b[:, 1] > y) & (left > 0)
    down = (b[:, 1] <= y) & (a[:, 1] > y) & (left < 0)
    return up.sum(1) - down.sum(1)


def positive(curves: list[np.ndarray]) -> list[np.ndarray]:
    """Boundary rings (open vertex lists, inside to the left) of the region that closed curves wind around more than zero times in sum."""
    a = np.concatenate(curves)
    b = np.concatenate([np.roll(c, -1, 0) for c in curves])
    real = (a != b).any(1)
    a, b = a[real], b[real]
    if not len(a):
        return []
    origin = a.min(0)
    scale = float((a.max(0) - origin).max()) or 1.0
    tiny = 1e-9 * scale
    begin, end = _split(a, b, tiny)
    grid = np.round((np.concatenate([begin, end]) - origin) / tiny).astype(np.int64)
    _, first, node = np.unique(grid, axis=0, return_index=True, return_inverse=True)
    place = np.concatenate([begin, end])[first]
    u, v = node.ravel()[: len(begin)], node.ravel()[len(begin):]
    pairs = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)])[u != v], axis=0)
    if not len(pairs):
        return []
    p, q = place[pairs[:, 0]], place[pairs[:, 1]]
    d = q - p
    aside = np.column_stack([-d[:, 1], d[:, 0]]) / np.hypot(d[:, 0], d[:, 1])[:, None] * (50 * tiny)
    left, right = (_winding((p + q) / 2 + side, a, b) > 0 for side in (aside, -aside))
    edges = np.concatenate([pairs[left & ~right], pairs[right & ~left][:, ::-1]])
    return _rings(edges, place)


def _rings(edges: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    leaving: dict[int, list[int]] = {}
    for k, (u, _) in enumerate(edges.tolist()):
        leaving.setdefault(u, []).append(k)
    d = place[edges[:, 1]] - place[edges[:, 0]] if len(edges) else np.zeros((0, 2))
    angle = np.arctan2(d[:, 1], d[:, 0])
    free, out = np.ones(len(edges), bool), []
    for first in range(len(edges)):
        k, path = first, []
        while free[k]:
            free[k] = False
            path.append(int(edges[k, 0]))
            after = [m for m in leaving.get(int(edges[k, 1]), []) if free[m]]
            if not after:
                break
            k = max(after, key=lambda m: (angle[m] - angle[k] + np.pi) % (2 * np.pi))      # the sharpest turn to the left keeps rings apart
        if len(path) > 2:
            out.append(place[path])
    return out


def offset(rings: list[np.ndarray], d: float) -> list[np.ndarray]:
    """Rings (open, outer ones with their inside to the left, holes the other way) grown by d, or shrunk where d < 0."""
    return [r for r in positive([_raw(r, d) for r in rings if len(r) > 2]) if abs(signed_area(r)) > 1e-9 * max(abs(d), 1e-9) ** 2]


def _plain(p: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings of one length ``(rings, vertices, 2)``, insides to the left, shrunk and grown again where no part is narrow and every edge is
    longer than its roundings: only convex corners change. Which rings are so, and the new vertices of these and how many each has."""
    e = np.roll(p, -1, 1) - p
    size = np.hypot(e[..., 0], e[..., 1])
    u = e / size[..., None]
    before = np.roll(u, 1, 1)
    turn = np.arctan2(before[..., 0] * u[..., 1] - before[..., 1] * u[..., 0], before[..., 0] * u[..., 0] + before[..., 1] * u[..., 1])
    tangent = np.where(turn > 0, d * np.tan(np.minimum(turn, 3.1) / 2), 0.0)
    at = np.flatnonzero(~(tangent + np.roll(tangent, -1, 1) > size).any(1))
    ok = np.zeros(len(p), bool)
    ok[at] = ~_narrow(p[at], u[at], size[at], 2 * d * (1 + 1e-9))
    p, u, before, turn, tangent = (a[ok].reshape(-1, *a.shape[2:]) for a in (p, u, before, turn, tangent))
    normal = np.column_stack([-before[:, 1], before[:, 0]])
    round_ = turn > 1e-12
    steps = np.where(round_, np.maximum((np.abs(turn) / _STEP + 0.5).astype(np.int64), 1), 0)
    vertex = np.repeat(np.arange(len(p)), steps + 1)
    k = np.arange(len(vertex)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    angle = np.arctan2(-normal[:, 1], -normal[:, 0])[vertex] + turn[vertex] * k / np.maximum(steps, 1)[vertex]
    centre = np.where(round_[:, None], p - tangent[:, None] * before + d * normal, p)
    out = centre[vertex] + np.where(round_, d, 0.0)[vertex, None] * np.column_stack([np.cos(angle), np.sin(angle)])
    return ok, out, (steps + 1).reshape(-1, e.shape[1]).sum(1)


def _narrow(p: np.ndarray, u: np.ndarray, size: np.ndarray, width: float) -> np.ndarray:
    """Rings with a vertex nearer than ``width`` to an edge that it is no end of."""
    n = p.shape[1]
    out = np.zeros(len(p), bool)
    x, y = p[:, :, 0], p[:, :, 1]
    v, edge = np.arange(n), np.arange(n)[None]
    for some, first, stop in blocks_of(len(p), n):                      # from every edge's begin to every vertex
        wx, wy = (a[some, first:stop, None] - a[some, None] for a in (x, y))
        ux, uy, long = u[some, None, :, 0], u[some, None, :, 1], size[some, None]
        t = np.clip(wx * ux + wy * uy, 0, long)
        far = (wx - t * ux) ** 2 + (wy - t * uy) ** 2
        own = (v[first:stop, None] == edge) | (v[first:stop, None] == (edge + 1) % n)
        out[some] |= ((far < width * width) & ~own).any((1, 2))
    return out


def blocks_of(rings: int, n: int, most: int = 1 << 17):
    """Pieces of all pairs of the ``n`` edges of each of some rings, with about ``most`` pairs at most: rings, and a range of first edges."""
    many, rows = max(most // (n * n), 1), max(min(n, most // n), 1)
    for k in range(0, rings, many):
        for first in range(0, n, rows):
            yield slice(k, k + many), first, min(first + rows, n)


def opened_all(points: np.ndarray, sizes: np.ndarray, d: float) -> list[np.ndarray | None]:
    """``opened`` of rings that lie one after another in ``points``; rings of one length are worked on together."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)
    first = np.minimum(end - sizes, max(len(points) - 1, 0))
    last = np.maximum(end - 1, 0)
    keep = np.ones(len(points), bool)
    keep[last[(sizes > 1) & (points[first] == points[last]).all(1)] if len(points) else []] = False
    points, ring = points[keep], ring[keep]
    n = np.bincount(ring, minlength=len(sizes))
    before = np.arange(len(ring)) - 1
    before[(np.cumsum(n) - n)[n > 0]] += n[n > 0]
    moved = (points != points[before]).any(1)                            # vertices without repetitions
    points, ring = points[moved], ring[moved]
    n = np.bincount(ring, minlength=len(sizes))
    start = np.cumsum(n) - n
    out: list[np.ndarray | None] = [None] * len(sizes)
    for m in np.unique(n[n > 2]).tolist():
        which = np.flatnonzero(n == m)
        p = points[start[which][:, None] + np.arange(m)]
        q = np.roll(p, -1, 1)
        area = (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(1) / 2
        which, p, backwards = which[area != 0], p[area != 0], (area < 0)[area != 0]
        p[backwards] = p[backwards, ::-1]
        with np.errstate(invalid="ignore"):                              # absent coordinates stay absent
            plain, made, count = _plain(p, d)
        made = iter(np.split(made, np.cumsum(count)[:-1]))
        for k, i in enumerate(which.tolist()):
            if plain[k]:
                one = next(made)
            else:
                shrunk = offset([p[k]], -d)
                grown = [r for r in offset(shrunk, d) if signed_area(r) > 0] if shrunk else []
                if not grown:
                    continue
                one = max(grown, key=signed_area)
            one = one[::-1] if backwards[k] else one
            out[i] = np.concatenate([one, one[:1]])
    return out


def opened(ring: np.ndarray, d: float) -> np.ndarray | None:
    """A closed ring shrunk and grown again by d, so that spurs and necks narrower than 2 d go and convex corners are rounded; the
    largest part of what is left, in the ring's own direction, or None if nothing is."""
    p = np.asarray(ring, float).reshape(-1, 2)
    return opened_all(p, np.array([len(p)]), d)[0]
