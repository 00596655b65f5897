"""Overlap, union and grid joins of slanted, concave and holed shapes against rasters and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footgrid.functions import geometry as G, offset as O
from footgrid.operators import settlements as ST, spatial_join as SJ

RING = "array<struct<x: double, y: double>>"


def star(rng, cx, cy, size, n):
    """A simple ring, usually concave."""
    p = []
    for k in range(n):
        t, far = (k + rng.uniform(0.1, 0.9)) * 2 * math.pi / n, size * rng.uniform(0.3, 1)
        p.append((cx + far * math.cos(t), cy + far * math.sin(t)))
    return p + p[:1]


def grid(lo, hi, h):
    x, y = np.meshgrid(np.arange(lo, hi, h) + h / 2, np.arange(lo, hi, h) + h / 2)
    return np.column_stack([x.ravel(), y.ravel()])


def covers(q, ring):
    p = np.array(ring)
    return O._winding(q, p[:-1], p[1:]) != 0


def test_overlap_of_concave_rings(spark):
    rng = random.Random(3)
    pairs = [(star(rng, 5, 5, 4, 9), star(rng, 6, 5.5, 4, 7)) for _ in range(20)]
    pairs += [(a[::-1], b) for a, b in pairs[:3]] + [(a, a) for a, _ in pairs[:3]] + [(pairs[0][0], star(rng, 50, 50, 3, 5))]
    got = spark.createDataFrame(pairs, f"a {RING}, b {RING}").select(G.intersection_area(F.col("a"), F.col("b")).alias("i"), G.iou(F.col("a"), F.col("b")).alias("iou")).collect()
    q = grid(0, 11, 0.02)
    for (a, b), r in zip(pairs, got):
        both = (covers(q, a) & covers(q, b)).sum() * 0.0004
        assert r.i == pytest.approx(both, abs=0.05)
        either = (covers(q, a) | covers(q, b)).sum() * 0.0004
        if either and both:
            assert r.iou == pytest.approx(both / either, abs=0.01)
    assert got[-1].i == pytest.approx(0, abs=1e-9) and got[23].iou == pytest.approx(1)


def test_overlap_with_holes_and_far_coordinates(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    far = 7_000_000.0
    donut = [box(far, far, far + 10, far + 10), box(far + 2, far + 2, far + 8, far + 8)[::-1]]
    frame = spark.createDataFrame([(donut, [box(far + 1, far + 1, far + 6, far + 6)])], f"a array<{RING}>, b array<{RING}>")
    row = frame.select(G.intersection_area_of(F.col("a"), F.col("b")).alias("i"), G.net_area(F.col("a")).alias("n")).first()
    assert row.i == pytest.approx(25 - 16, abs=1e-6) and row.n == pytest.approx(64, abs=0.1)


def test_union_of_slanted_and_concave_shapes(spark):
    rng = random.Random(11)
    shapes = [("a", star(rng, rng.uniform(3, 17), rng.uniform(3, 17), 4, 8)) for _ in range(12)] + [("b", star(rng, 9, 9, 6, 11))]
    shapes += [("a", shapes[0][1]), ("a", shapes[1][1][::-1])]
    q = grid(-3, 23, 0.02)
    for cell in (2.5, 7.0, 100.0):
        got = {r.k: r for r in ST.dissolve(spark.createDataFrame(shapes, f"k string, ring {RING}"), ("k",), cell).collect()}
        for k in "ab":
            inside = np.zeros(len(q), bool)
            for name, ring in shapes:
                if name == k:
                    inside |= covers(q, ring)
            assert got[k].area == pytest.approx(inside.sum() * 0.0004, rel=3e-3)
        whole = O.positive([O._open(np.array(r))[:: 1 if O.signed_area(O._open(np.array(r))) > 0 else -1] for n, r in shapes if n == "a"])
        assert got["a"].perimeter == pytest.approx(sum(np.hypot(*(np.roll(r, -1, 0) - r).T).sum() for r in whole), rel=1e-6)
        assert got["a"].area == pytest.approx(sum(map(O.signed_area, whole)), rel=1e-9)
    assert ST.dissolve(spark.createDataFrame([], f"k string, ring {RING}"), ("k",), 1.0).count() == 0


def boxes(rng, n, sizes):
    out = []
    for k in range(n):
        x, y, w, h = rng.randint(-200, 200), rng.randint(-200, 200), rng.choice(sizes), rng.choice(sizes)
        out.append((k, float(x), float(y), float(x + w), float(y + h)))
    return out


def test_boxes_of_all_sizes_meet_once_in_few_cells(spark):
    rng = random.Random(5)
    left, right = boxes(rng, 60, [0, 1, 4, 16, 33]), boxes(rng, 60, [0, 2, 8, 64, 300, 5000])
    right.append((999, -1e7, -1e7, 1e7, 1e7))
    cols = "xmin double, ymin double, xmax double, ymax double"
    l, r = spark.createDataFrame(left, f"a int, {cols}"), spark.createDataFrame(right, f"b int, {cols}")
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for cell in (1.0, 8.0, 500.0):
        assert sorted(map(tuple, SJ.box_pairs(l, r, "a", "b", cell).collect())) == want
        assert sorted((y, x) for x, y in map(tuple, SJ.box_pairs(r, l, "b", "a", cell).collect())) == want
    country = r.where("b = 999").withColumn("lv0", SJ._level(8.0))
    level = country.first().lv0
    assert SJ.cells(country, 8.0, [0, 3, level], "lv0").count() <= 9


def test_ring_iou_pairs_like_brute_force(spark):
    rng = random.Random(8)
    pred = [(k, star(rng, rng.uniform(0, 30), rng.uniform(0, 30), 5, 7)) for k in range(25)]
    truth = [(k, star(rng, rng.uniform(0, 30), rng.uniform(0, 30), 5, 8)) for k in range(25)] + [(100, pred[0][1]), (101, pred[0][1])]
    got = SJ.ring_iou_pairs(spark.createDataFrame(pred, f"pid int, ring {RING}"), spark.createDataFrame(truth, f"tid int, ring {RING}"), 0.2, 4.0).collect()
    area = lambda r: abs(O.signed_area(np.array(r)[:-1]))
    turned = lambda r: np.array(r)[:-1][:: 1 if O.signed_area(np.array(r)[:-1]) > 0 else -1]
    want = {}
    for i, a in pred:
        for j, b in truth[:-1]:
            union = sum(map(O.signed_area, O.positive([turned(a), turned(b)])))
            iou = (area(a) + area(b) - union) / union
            if iou >= 0.2:
                want[i, j] = iou
    assert {(r.pid, r.tid): pytest.approx(r.iou, abs=1e-6) for r in got} == want
    assert [r.n_truth for r in got if (r.pid, r.tid) == (0, 100)] == [2]
