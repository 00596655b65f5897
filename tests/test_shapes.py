"""The array form of regularisation against the column expressions, ring by ring."""

import numpy as np
from pyspark.sql import functions as F

from footgrid.config import SegmentationParams
from footgrid.functions import geometry as G, offset, shapes
from footgrid.operators import segment


def by_columns(df, params):
    """Regularisation as column expressions, with one call of `offset.opened` per ring."""
    square = G.squared_up(F.col("ring"), params.mbr_threshold) if params.use_mbr else F.lit(None).cast(G.RING_TYPE)
    thin = df.select("id", "ring", square.alias("square"), G.simplify(F.col("ring"), params.simplify_tolerance).alias("thin")).collect()
    out = {}
    for x in thin:
        ring = x.square
        if ring is None and x.thin is not None:
            ring = offset.opened(np.array([(p.x, p.y) for p in x.thin], float).reshape(-1, 2), params.buffer_distance) if params.buffer_distance > 0 else x.thin
            ring = None if ring is None else [(float(a), float(b)) for a, b in ring]
        out[x.id] = (x.square is not None, [(p.x, p.y) for p in ring] if x.square is not None else ring, x.ring)
    rows = [(k, r) for k, (s, r, _) in out.items() if r is not None]
    ok = {x.id for x in df.sparkSession.createDataFrame(rows, f"id long, ring {G.RING_TYPE}").where(G.is_valid(F.col("ring"))).collect()}
    return {k: r if s or k in ok else None if w is None else [(p.x, p.y) for p in w] for k, (s, r, w) in out.items()}


def odd_rings():
    rng = np.random.default_rng(7)
    rings = []
    for k in range(60):                                  # stars, rounded stars, turned boxes with a dent, stairs
        n = int(rng.integers(3, 30))
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        p = np.column_stack([np.cos(a), np.sin(a)]) * rng.uniform(1, 9, n)[:, None] + rng.integers(0, 50, 2)
        if k % 4 == 1:
            p = np.round(p)
        if k % 4 == 2:
            w, h, t = rng.integers(3, 20), rng.integers(3, 20), rng.uniform(0, 6)
            p = np.array([(0, 0), (w / 2, 0.1), (w, 0), (w, h), (0, h)]) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        if k % 4 == 3:
            steps = np.cumsum(rng.integers(1, 3, 6))
            p = np.array([(0, 0), *[(x, y) for i, x in enumerate(steps) for y in (steps[i - 1] if i else 0, x)], (0, steps[-1])], float)
        p = p[::-1] if k % 3 == 0 else p
        rings.append(np.concatenate([p, p[:1]]).tolist())
    return rings + [[], [(1.0, 1.0)], [(0.0, 0.0), (4.0, 0.0)], [(0.0, 0.0), (4.0, 0.0), (8.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)],
                    [(2.0, 2.0)] * 7, [(0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 5.0), (0.0, 0.0)], None, [(0.0, 0.0), (9.0, None), (9.0, 4.0), (0.0, 4.0), (0.0, 0.0)],
                    [(0.0, 0.0), (9.0, 0.0), None, (0.0, 4.0), (0.0, 0.0)]]


def turned(ring):
    """Open vertex list from its lowest vertex on: rectangles on two edges may be equal but for the last bits, and begin at different corners."""
    p = np.array([tuple(q) for q in ring], float).reshape(-1, 2)
    p = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
    return np.roll(p, -np.lexsort(np.round(p, 6).T)[0], 0) if len(p) else p


def test_array_form_says_what_the_columns_say(spark):
    rings = odd_rings()
    df = spark.createDataFrame(list(enumerate(rings)), f"id long, ring {G.RING_TYPE}")
    plain = [k for k, r in enumerate(rings) if r is not None and not any(p is None or None in p for p in r)]
    for params in (SegmentationParams(), SegmentationParams(simplify_tolerance=0.3, buffer_distance=0.6, mbr_threshold=0.6),
                   SegmentationParams(use_mbr=False, simplify_tolerance=0, buffer_distance=0)):
        want = by_columns(df.where(F.col("id").isin(plain)), params)
        got = {x.id: x.ring for x in segment.regularize(df, params).collect()}
        assert len(got) == len(rings) and got[rings.index(None)] is None
        for k in plain:
            a, b = turned(got[k]), turned(want[k])
            assert a.shape == b.shape and np.allclose(a, b, rtol=0, atol=1e-9), k


def test_rings_of_one_length_are_worked_on_together(monkeypatch):
    calls = []
    once = offset._plain
    monkeypatch.setattr(offset, "_plain", lambda p, d: calls.append(len(p)) or once(p, d))
    ell = np.array([(0, 0), (40, 0), (40, 30), (20, 30), (20, 60), (0, 60), (0, 0)], float)
    moved = np.concatenate([ell + k for k in range(500)])
    out = shapes.regularized(moved, np.full(500, 7), 0.5, 0.2, 0.85)
    assert calls == [500] and len(out) == 500 and all(len(r) == 5 * 17 + 2 for r in out)


def test_pairs_of_edges_go_in_bounded_pieces():
    sizes = [(p.stop - p.start, stop - first) for p, first, stop in offset.blocks_of(1, 5000)]
    assert sum(n for _, n in sizes) == 5000 and max(k * n for k, n in sizes) * 5000 <= 1 << 18
    a = np.linspace(0, 2 * np.pi, 5001)
    star = np.column_stack([np.cos(a), np.sin(a)]) * (100 + 5 * np.cos(40 * a))[:, None]
    star[-1] = star[0]
    crossed = star.copy()
    crossed[100], crossed[2000] = star[2000], star[100]
    assert shapes.valid(np.stack([star, crossed])).tolist() == [True, False]
