"""Operators against brute force on small random inputs, and their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pixel_rows, to_grid
from footgrid.config import SegmentationParams
from footgrid.functions import crs as K, geometry as G
from footgrid.operators import burn, components as C, polygonize as PG, sampling, segment, spatial_join as SJ, stencil as S
from footgrid.skew import attach, hot_key_join

RNG = np.random.default_rng(5)


def label(mask):
    """Flood-fill labels, 0 for background."""
    out, k = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        k += 1
        todo = [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not out[r, c]:
                out[r, c] = k
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def by_size(mask, keep):
    lab = label(mask)
    return np.isin(lab, [k for k in range(1, lab.max() + 1) if keep((lab == k).sum())])


def morph(a, element, op):
    out = np.empty_like(a)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            vals = [a[r + dy, c + dx] for dy, w in element.items() for dx in range(-w, w + 1)
                    if 0 <= r + dy < a.shape[0] and 0 <= c + dx < a.shape[1]]
            out[r, c] = op(vals)
    return out


def median(a):
    p = np.pad(a, 1, mode="symmetric")
    return np.array([[np.median(p[r:r + 3, c:c + 3]) for c in range(a.shape[1])] for r in range(a.shape[0])])


def random_blobs(h=40, w=44, p=0.52):
    m = RNG.random((h, w))
    return ((m + np.roll(m, 1, 0) + np.roll(m, 1, 1)) / 3 > p).astype(int)


@pytest.mark.parametrize("block", [8, 64])
@pytest.mark.parametrize("k", [3, 5])
def test_morphology_is_brute_force_at_any_block_size(spark, block, k):
    a = RNG.integers(0, 9, (25, 31))
    df, e = pixel_rows(spark, a), S.ellipse(k)
    want = morph(morph(a, e, min), e, max)
    assert (to_grid(S.opening(df, element=e, block=block), a.shape) == want).all()
    want = morph(morph(a, S.square(k), max), S.square(k), min)
    assert (to_grid(S.closing(df, element=S.square(k), block=block), a.shape) == want).all()


def test_scatter_is_window_form(spark):
    a = RNG.integers(0, 50, (20, 20))
    df = pixel_rows(spark, a)
    for op, f in (("min", S.erode), ("max", S.dilate)):
        assert (to_grid(S.scatter(df, "v", S.ellipse(5), op), a.shape) == to_grid(f(df, element=S.ellipse(5)), a.shape)).all()


def test_array_chain_is_window_form(spark):
    a = random_blobs()
    df, k = pixel_rows(spark, a), S.ellipse(5)
    chain = [("min", k), ("max", k), ("max", S.square(3))]
    one, two = (to_grid(S.morphology(df, "v", chain, block=16, method=m), a.shape) for m in ("window", "array"))
    assert (one == two).all()
    three = RNG.integers(0, 3, (21, 17))
    df = pixel_rows(spark, three)
    for step, f in ((("vote",), S.majority3), (("median",), S.median3)):
        assert (to_grid(S.array_chain(df, "v", [step], block=8), three.shape) == to_grid(f(df), three.shape)).all()


def test_sparse_morphology_is_dense_morphology(spark):
    a = random_blobs()
    df = pixel_rows(spark, a)
    fg = df.where("v = 1").select("image", "r", "c")
    sizes = spark.createDataFrame([(0, a.shape[1], a.shape[0])], "image long, width int, height int")
    for e in (S.square(3), S.ellipse(5)):
        for sparse, op in ((S.shrink, min), (S.spread, max)):
            got = {(r.r, r.c) for r in sparse(fg, e, sizes).collect()}
            assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(morph(a, e, op)))))


def test_morphology_order_and_idempotence(spark):
    a = random_blobs()
    df = pixel_rows(spark, a)
    lo, hi = to_grid(S.erode(df), a.shape), to_grid(S.dilate(df), a.shape)
    assert (lo <= a).all() and (a <= hi).all()
    for f in (S.opening, S.closing):
        once = f(df)
        assert (to_grid(once, a.shape) == to_grid(f(once), a.shape)).all()


@pytest.mark.parametrize("block", [8, 64])
def test_median_and_gauss(spark, block):
    a = RNG.random((19, 23)).round(3)
    df = pixel_rows(spark, a)
    assert np.allclose(to_grid(S.median3(df, block=block), a.shape), median(a))
    k = np.array([S.gauss_kernel(0.5)[abs(i)] for i in range(-2, 3)])
    p = np.pad(a, 2, mode="symmetric")
    want = np.array([[(p[r:r + 5, c:c + 5] * np.outer(k, k)).sum() for c in range(23)] for r in range(19)])
    assert np.allclose(to_grid(S.gauss(df, block=block), a.shape), want)


@pytest.mark.parametrize("block", [4, 16, 64])
def test_components_and_rings_at_any_block_size(spark, block):
    a = random_blobs()
    fg = pixel_rows(spark, a).where("v = 1")
    lab = label(a)
    got = {}
    for row in C.components(fg, block).collect():
        got.setdefault(row.label, set()).add((row.r, row.c))
    want = [set(zip(*np.nonzero(lab == k))) for k in range(1, lab.max() + 1)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    for code, px in got.items():
        assert divmod(code, C.ROW) == min(px)
    rings = PG.polygonize(fg, block).withColumn("a2", G.signed_area(F.col("ring"))).collect()
    area = {}
    for r in rings:
        assert r.a2 == r.area and (r.area < 0) == r.is_hole
        assert r.ring[0] == r.ring[-1]
        assert (r.ring[0].y, r.ring[0].x) == min((p.y, p.x) for p in r.ring)
        for p, q in zip(r.ring, r.ring[1:]):
            assert (p.x == q.x) != (p.y == q.y)
        area[r.label] = area.get(r.label, 0) + r.area
    assert area == {code: len(px) for code, px in got.items()}
    assert sum(not r.is_hole for r in rings) == len(got)
    stats = {r.label: (r.area, r.perimeter) for r in PG.shape_stats(fg, block).collect()}
    per = {}
    for r in rings:
        per[r.label] = per.get(r.label, 0) + r.perimeter
    assert stats == {k: (area[k], per[k]) for k in area}


def test_components_do_not_depend_on_partitioning(spark):
    fg = pixel_rows(spark, random_blobs()).where("v = 1")
    one = sorted(map(tuple, C.components(fg.repartition(1), 8).select("r", "c", "label").collect()))
    many = sorted(map(tuple, C.components(fg.orderBy(F.rand(3)).repartition(13), 16).select("r", "c", "label").collect()))
    assert one == many


def test_connected_graph(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    edges += [(2000, 2000 + i) for i in range(1, 200)]          # one hub
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in C.connected(df, []).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: find(n) for n in linked}


def test_edge_guided_chain(spark):
    b, e = RNG.random((30, 34)).round(3), (RNG.random((30, 34)) * 0.12).round(3)
    b = ((b + np.roll(b, 1, 0) + np.roll(b, 1, 1)) / 3).round(4)
    p = SegmentationParams(building_threshold=0.5, min_building_size=6, max_hole_size=5, morph_kernel_size=3)
    m = (median(np.where(e > p.edge_threshold, 0, b)) > p.building_threshold).astype(int)
    m = by_size(m, lambda n: n >= 6).astype(int)
    m = (m.astype(bool) | by_size(1 - m, lambda n: n < 5)).astype(int)
    k = S.ellipse(3)
    for op in (min, max, max, min, max):
        m = morph(m, k, op)
    rows = [(0, r, c, float(b[r, c]), float(e[r, c])) for r in range(30) for c in range(34)]
    df = spark.createDataFrame(rows, "image long, r int, c int, building_prob double, edge_prob double")
    assert (to_grid(segment.edge_guided(df, p), m.shape) == m).all()


def boxes(spark, n, size, id_, hot=False):
    xy = np.zeros((n, 2)) if hot else RNG.integers(0, 200, (n, 2))
    wh = RNG.integers(1, size, (n, 2))
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(xy, wh))]
    return rows, spark.createDataFrame(rows, f"{id_} long, xmin double, ymin double, xmax double, ymax double")


@pytest.mark.parametrize("hot", [False, True])
def test_grid_join_is_nested_loop_join(spark, hot):
    a, left = boxes(spark, 90, 30, "a", hot)
    b, right = boxes(spark, 60, 90, "b", hot)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for hot_rows in (5, 10 ** 6):
        got = sorted(map(tuple, SJ.box_pairs(left, right, "a", "b", 16, hot_rows=hot_rows).collect()))
        assert got == want
    swapped = sorted((y, x) for x, y in map(tuple, SJ.box_pairs(right, left, "b", "a", 16).collect()))
    assert swapped == want


def test_tiles_touched_counts_shared_borders(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0, 20.0, 15.0)], "bid int, xmin double, ymin double, xmax double, ymax double")
    got = sorted((r.tile_r, r.tile_c) for r in SJ.tiles_touched(df, 10.0).collect())
    assert got == [(r, c) for r in (0, 1) for c in (0, 1, 2)]


def test_hot_key_join_and_attach_keep_every_row(spark):
    left = spark.range(500).select(F.col("id").alias("i"), (F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"))
    right = spark.range(40).select(F.col("id").alias("j"), (F.col("id") % 2).alias("k"))
    want = left.join(right, "k")
    got = hot_key_join(left, right, ["k"], ["i"], hot_rows=7)
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count()
    table = left.select("k").distinct().withColumn("name", F.col("k") * 2)
    assert attach(left, table, ["k"], ["i"]).where("name = k * 2").count() == 500


def test_iou_is_symmetric_and_bounded(spark):
    a, left = boxes(spark, 40, 30, "pid")
    b, right = boxes(spark, 40, 30, "tid")
    one = {(r.pid, r.tid): r.iou for r in SJ.iou_pairs(left, right, 0.01, 16).collect()}
    two = {(r.tid, r.pid): r.iou for r in SJ.iou_pairs(
        right.withColumnRenamed("tid", "pid"), left.withColumnRenamed("pid", "tid"), 0.01, 16).collect()}
    assert one == two and all(0 < v <= 1 for v in one.values())


@pytest.mark.parametrize("n, share", [(1, 0.2), (10, 0.25), (997, 0.2), (1000, 0.0), (50, 1.0)])
def test_split_is_exact_and_disjoint(spark, n, share):
    df = spark.range(n)
    got = sampling.split(df, "id", share, 7)
    assert got.where("is_test").count() == int(np.ceil(share * n)) and got.count() == n
    again = sampling.split(df.repartition(5), "id", share, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_sample_of_small_population_is_everything(spark):
    assert sampling.sample(spark.range(9), "id", 20).count() == 9
    assert sampling.sample(spark.range(900), "id", 20).count() == 20
    assert sampling.sample(spark.range(0), "id", 20).count() == 0


def test_slanted_polygons_burn_pixel_centres(spark):
    tri = [(2.3, 1.7), (27.9, 8.2), (9.1, 24.6)]
    pts = ",".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in tri + tri[:1])
    polys = spark.sql(f"select 0L as image, 1L as pid, array({pts}) as ring, 26 as width, 20 as height")
    got = {(r.r, r.c) for r in burn.fill(polys).collect()}

    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(tri, tri[1:] + tri[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit
    assert got == {(r, c) for r in range(20) for c in range(26) if inside(c + .5, r + .5)}


def test_burn_then_polygonize_returns_the_box(spark):
    polys = spark.createDataFrame([(0, 1, 3.0, 5.0, 300.0, 290.0, 400, 400)],
                                  "image long, pid long, x0 double, y0 double, x1 double, y1 double, width int, height int")
    ring = PG.polygonize(burn.fill(polys.withColumn("ring", G.box_ring("x0", "y0", "x1", "y1"))), 64).collect()
    assert len(ring) == 1 and ring[0].area == 297 * 285 and len(ring[0].ring) == 5


def test_hull_and_rectangle(spark):
    for _ in range(5):
        pts = RNG.integers(0, 20, (12, 2)).astype(float)
        ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
        row = spark.range(1).withColumn("ring", ring).withColumn("hull", G.convex_hull(F.col("ring"))) \
            .withColumn("mbr", G.min_rotated_rect(F.col("hull"))).first()
        h = [(p.x, p.y) for p in row.hull]
        for (x1, y1), (x2, y2) in zip(h, h[1:]):
            assert all((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= -1e-9 for x, y in pts)
        best = min(np.ptp(pts @ d) * np.ptp(pts @ np.array([-d[1], d[0]])) for (x1, y1), (x2, y2) in zip(h, h[1:])
                   for d in [np.array([x2 - x1, y2 - y1]) / np.hypot(x2 - x1, y2 - y1)])
        (a, b, c, *_) = [(p.x, p.y) for p in row.mbr]
        assert np.isclose(np.hypot(b[0] - a[0], b[1] - a[1]) * np.hypot(c[0] - b[0], c[1] - b[1]), best)


def test_simplify_keeps_ring_and_bounds_area_change(spark):
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    pts = np.stack([50 + 30 * np.cos(t), 50 + 20 * np.sin(t)], 1)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*pts, pts[0]]])
    row = spark.range(1).withColumn("ring", ring).withColumn("s", G.simplify(F.col("ring"), 1.0)) \
        .select("s", G.area(F.col("s")).alias("a"), G.area(F.col("ring")).alias("b")).first()
    assert row.s[0] == row.s[-1] and 5 <= len(row.s) < 40 and abs(row.a - row.b) < 0.05 * row.b


def test_crs_round_trips_and_refusals(spark):
    df = spark.createDataFrame([(31.2, -1.3), (33.0, 2.5), (29.5, 60.0)], "lon double, lat double")
    for name in ("CEA", "EPSG:3857", "EPSG:32636", "TMERC:31", "TMERC:31:0.9999:1000:2000"):
        x, y = K.transform_xy(F.col("lon"), F.col("lat"), "EPSG:4326", name)
        back = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        lo, la = K.transform_xy(F.col("x"), F.col("y"), name, "EPSG:4326")
        for r in back.select("lon", "lat", lo.alias("lo"), la.alias("la")).collect():
            assert abs(r.lon - r.lo) < 1e-6 and abs(r.lat - r.la) < 1e-6, name
    with pytest.raises(K.UnknownCrs):
        K.transform_xy(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:2154")


def _walk(points, tolerance):
    """Plain form of the simplification."""
    def near(a, b, p):
        base = np.hypot(*(b - a))
        off = abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / base if base else np.hypot(*(p - a))
        return off < tolerance
    kept, passed = [points[0]], []
    for v in points[1:]:
        if all(near(kept[-1], v, p) for p in passed):
            passed.append(v)
        else:
            kept.append(passed[-1])
            passed = [v]
    return [*kept, passed[-1]]


def test_simplify_is_complete_and_bounded(spark):
    side = [(float(i), float(i % 2)) for i in range(300)]
    stairs = [*side, (299.0, 100.0), (0.0, 100.0), side[0]]
    wave = [*[(float(i), 3 * np.sin(i / 4)) for i in range(200)], (199.0, 60.0), (0.0, 60.0), (0.0, 0.0)]
    for points in (stairs, wave):
        ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
        got = [(p.x, p.y) for p in spark.range(1).select(G.simplify(ring, 1.5).alias("s")).first().s]
        want = _walk([np.array(p) for p in points], 1.5)
        assert np.allclose(got, want) and len(got) < len(points) / 2
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in stairs])
    assert len(spark.range(1).select(G.simplify(ring, 1.5).alias("s")).first().s) <= 8


def _gappy(spark):
    rng = np.random.default_rng(11)
    rows = [(0, r, c, int(rng.integers(0, 4))) for r in range(40) for c in range(40) if not (12 <= c < 16 or 20 <= r < 28 and c < 8) and rng.random() < 0.95]
    return rows, spark.createDataFrame(rows, "image long, r int, c int, v int")


def test_stencils_agree_on_rasters_with_gaps(spark):
    rows, df = _gappy(spark)
    at = {(r, c): v for _, r, c, v in rows}
    k = S.ellipse(3)
    chain = [("min", k), ("max", S.square(3)), ("max", k), ("min", k)]
    want = dict(at)
    for op, element in chain:
        fold = min if op == "min" else max
        want = {(r, c): fold(want[r + dy, c + dx] for dy, w in element.items() for dx in range(-w, w + 1) if (r + dy, c + dx) in want) for r, c in want}
    for method in ("array", "scatter"):
        got = S.morphology(df, "v", chain, block=16, method=method)
        assert {(x.r, x.c): x.v for x in got.collect()} == want, method
    one = S.erode(df, block=16)
    assert {(x.r, x.c): x.v for x in one.collect()} == {(r, c): min(at[p] for p in at if abs(p[0] - r) < 2 and abs(p[1] - c) < 2) for r, c in at}

    def row(r, c, own):
        return [at.get((r, c + d), at[r, c]) for d in (-1, 0, 1)] if (r, c) in at else own
    nine = {(r, c): sorted(sum((row(r + d, c, row(r, c, None)) for d in (-1, 0, 1)), [])) for r, c in at}
    median = {p: n[4] for p, n in nine.items()}
    vote = {p: n[4] if n.count(n[4]) >= 5 else 0 for p, n in nine.items()}
    for step, passed, expected in ((("median",), S.median_pass, median), (("vote",), S.vote_pass, vote)):
        array = S.array_chain(df, "v", [step], block=16)
        assert {(x.r, x.c): x.v for x in array.collect()} == expected, step
        window = S.core(passed(S.halo_blocks(df, 1, block=16), "v"), 16)
        assert {(x.r, x.c): x.v for x in window.collect()} == expected, step


def _ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*points, points[0]]])


def test_slanted_settlement_touches_only_its_tiles(spark):
    aoi = SJ.with_bounds(spark.range(1).select(F.col("id").alias("aoi"), _ring([(1, 1), (19, 1), (1, 19)]).alias("ring")))
    tiles = spark.createDataFrame([(r, c) for r in range(3) for c in range(3)], "tile_r int, tile_c int")
    hit = lambda a: sorted((r.tile_r, r.tile_c) for r in SJ.tiles_in_settlements(tiles, a, 10.0).collect())
    assert hit(aoi.drop("ring")) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert hit(aoi) == [(0, 0), (0, 1), (1, 0), (1, 1)]          # the long side meets the corner at (10, 10)
    small = SJ.with_bounds(spark.range(1).select(F.col("id").alias("aoi"), _ring([(1, 1), (17, 1), (1, 17)]).alias("ring")))
    assert hit(small) == [(0, 0), (0, 1), (1, 0)]


def test_equal_buildings_of_two_images_stay(spark):
    from footgrid.plans import jobs
    square = _ring([(1, 1), (3, 1), (3, 3), (1, 3)])
    polys = spark.range(2).select(F.col("id").alias("image"), F.lit(1).cast("long").alias("label"), F.lit(0).cast("long").alias("ring_id"), square.alias("ring"))
    polys = polys.union(polys.withColumn("label", F.lit(5).cast("long")))
    aois = SJ.with_bounds(spark.range(2).select((F.col("id") + 7).alias("aoi"), _ring([(0, 0), (4, 0), (0, 4)]).alias("ring")))
    got = jobs.assign_settlements(polys, aois, 8.0).collect()
    assert sorted((r.image, r.label, r.aoi) for r in got) == [(0, 1, 7), (1, 1, 7)]
    world = jobs.assign_settlements(polys, aois, 8.0, plane=()).collect()
    assert [(r.image, r.label, r.aoi) for r in world] == [(0, 1, 7)]
    own = aois.withColumn("image", F.col("aoi") - 7)
    assert sorted((r.image, r.aoi) for r in jobs.assign_settlements(polys, own, 8.0).collect()) == [(0, 7), (1, 8)]


def test_class_codes_outside_bytes_are_refused(spark):
    from footgrid.operators import metrics as M
    with pytest.raises(Exception, match="0 to 255"):
        M.class_index(spark.createDataFrame([(1,), (300,)], "v int"), "v").collect()


def test_mask_values_by_a_table(spark):
    from footgrid.functions import pixel as P
    df = spark.createDataFrame([(0,), (7,), (None,)], "v int")
    assert [r[0] for r in df.select(P.mapped(F.col("v"), {0: 3, 7: 1})).collect()] == [3, 1, None]
    with pytest.raises(Exception, match="without a class: 7"):
        df.select(P.mapped(F.col("v"), {0: 3})).collect()
