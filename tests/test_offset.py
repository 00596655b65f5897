"""Offset curves against fine rasters and closed forms."""

import numpy as np
import pytest

from footgrid.functions import offset as O


def ring(points):
    p = np.array(points, float)
    return np.concatenate([p, p[:1]])


def inside(q, p):
    return O._winding(q, p[:-1], p[1:]) != 0


def distance(q, p):
    """Distance of points to the edges of a ring."""
    a, d = p[:-1], np.diff(p, axis=0)
    w = q[:, None] - a[None]
    t = np.clip((w * d).sum(2) / (d ** 2).sum(1), 0, 1)
    return np.hypot(*np.moveaxis(w - t[:, :, None] * d, 2, 0)).min(1)


SHAPES = {
    "square": [(0, 0), (10, 0), (10, 10), (0, 10)],
    "ell": [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)],
    "neck": [(0, 0), (4, 0), (4, 1.8), (6, 1.8), (6, 0), (10, 0), (10, 5), (6, 5), (6, 2.1), (4, 2.1), (4, 4), (0, 4)],
    "spur": [(0, 0), (8, 0), (8, 3), (12, 3), (12, 3.3), (8, 3.3), (8, 6), (0, 6)],
    "triangle": [(0, 0), (9, 1), (3, 7)],
    "sharp": [(0, 0), (10, 0.0), (0.5, 1.2), (0, 6)],
    "steps": [(0, 0), (6, 0), (6, 0.3), (5.7, 0.3), (5.7, 0.6), (5.4, 0.6), (5.4, 5), (0, 5)],
    "dent": [(0, 0), (10, 0), (10, 6), (5.2, 6), (5.2, 5.6), (4.8, 5.6), (4.8, 6), (0, 6)],
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("d", [0.2, 0.5, 1.0])
def test_opening_like_a_fine_raster(name, d):
    p = ring(SHAPES[name])
    h = 0.08
    x, y = np.meshgrid(np.arange(p[:, 0].min() - 0.5, p[:, 0].max() + 0.5, h), np.arange(p[:, 1].min() - 0.5, p[:, 1].max() + 0.5, h))
    q = np.column_stack([x.ravel(), y.ravel()])
    core = q[inside(q, p) & (distance(q, p) >= d)]
    got = O.opened(p, d)
    if not len(core):
        assert got is None or abs(O.signed_area(got[:-1])) < 4 * d * d + 0.2
        return
    # every point of the shrunk shape has a grid point within h, which is no nearer than d - h to the edge
    loose = q[inside(q, p) & (distance(q, p) >= d - h)]
    near, far = (np.array([np.hypot(*(c - x).T).min() for x in q]) for c in (core, loose))
    sure_in, sure_out = near <= d - 2 * h, far >= d + 2 * h
    held = inside(q, got)
    parts = O.offset(O.offset([O._open(p)], -d), d)
    whole = np.zeros(len(q), bool)
    for r in parts or [got[:-1]]:
        whole |= inside(q, np.concatenate([r, r[:1]]))
    assert whole[sure_in].all() and not whole[sure_out].any()
    assert (held <= whole).mean() > 0.995                        # the largest part of them
    assert O.signed_area(got[:-1]) == pytest.approx(max(O.signed_area(r) for r in parts), rel=2e-3)


def test_closed_forms():
    d = 0.5
    rounded = d * d * (1 - 8 * np.sin(np.pi / 32))
    assert O.signed_area(O.opened(ring(SHAPES["square"]), d)[:-1]) == pytest.approx(100 - 4 * rounded)
    assert O.signed_area(O.opened(ring(SHAPES["ell"]), d)[:-1]) == pytest.approx(64 - 5 * rounded)
    assert O.signed_area(O.opened(ring(SHAPES["square"][::-1]), d)[:-1]) == pytest.approx(-100 + 4 * rounded)
    assert sum(map(O.signed_area, O.offset([np.array(SHAPES["square"], float)], -2))) == pytest.approx(36)
    assert sum(map(O.signed_area, O.offset([np.array(SHAPES["square"], float)], 1))) == pytest.approx(140 + 32 * np.sin(np.pi / 32))


def test_largest_part_of_two_and_nothing_left():
    got = O.opened(ring(SHAPES["neck"]), 0.2)
    assert got[:, 0].min() == pytest.approx(6, abs=0.1) and O.signed_area(got[:-1]) == pytest.approx(20, abs=0.1)
    assert O.opened(ring([(0, 0), (5, 0), (5, 0.3), (0, 0.3)]), 0.2) is None
    assert O.opened(ring([(0, 0), (1, 0), (2, 0)]), 0.2) is None


def test_random_grid_rings_shrink_and_grow_like_rasters(spark):
    """Rings traced from masks, whose parts of one pixel go at d = 0.6 and stay at d = 0.4."""
    from footgrid.config import SegmentationParams
    from footgrid.functions import geometry as G
    from footgrid.operators import segment
    grid = ring([(0, 0), (5, 0), (5, 1), (6, 1), (6, 2), (5, 2), (5, 5), (0, 5)])
    for d, stays in ((0.4, True), (0.6, False)):
        got = O.opened(grid, d)
        assert (got[:, 0].max() > 5.5) == stays
    frame = spark.createDataFrame([(1, [tuple(map(float, p)) for p in grid], "x")], "id int, ring array<struct<x: double, y: double>>, other string")
    for d, stays in ((0.4, True), (0.6, False)):
        out = segment.regularize(frame, SegmentationParams(use_mbr=False, simplify_tolerance=0, buffer_distance=d))
        row = out.select("*", G.bounds("ring").alias("b")).first()
        assert out.columns == frame.columns and (row.b.xmax > 5.5) == stays
    same = segment.regularize(frame, SegmentationParams(use_mbr=True, buffer_distance=0.6, mbr_threshold=0.5)).first()
    assert len(same.ring) == 5                                    # squared up, not rounded
    tiny = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.0), (5.0, 0.3), (0.0, 0.3), (0.0, 0.0)]), (2, None)], "id int, ring array<struct<x: double, y: double>>")
    kept = segment.regularize(tiny, SegmentationParams(use_mbr=False, simplify_tolerance=0, buffer_distance=0.2)).orderBy("id").collect()
    assert len(kept[0].ring) == 5 and kept[1].ring is None        # nothing would be left: it stays as it was
