"""Packed block rasters against the pixel-row operators, on random masks cut into many small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pixel_rows, to_grid
from footgrid.config import SegmentationParams
from footgrid.operators import blocks as BL, polygonize as PG, score, segment, tiling as T
from footgrid.plans import jobs

TILE = 16
SIZES = "image long, width int, height int"


def noisy(seed, shape=(64, 80), share=0.55):
    rng = np.random.default_rng(seed)
    a = rng.random(shape)
    for _ in range(2):
        a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 0) + np.roll(a, -1, 1)) / 5
    return a > np.quantile(a, 1 - share)


def packed(spark, grid, image=0):
    sizes = spark.createDataFrame([(image, grid.shape[1], grid.shape[0])], SIZES)
    return T.pack(T.cut(pixel_rows(spark, grid.astype(float), image), sizes, TILE), TILE)


def ring_set(frame):
    return sorted((r.image, r.label, r.ring_id, [(p.x, p.y) for p in r.ring]) for r in frame.collect())


@pytest.mark.parametrize("seed, share", [(1, 0.5), (2, 0.62), (3, 0.35), (4, 0.8)])
def test_rings_like_pixel_rows(spark, seed, share):
    grid = noisy(seed, share=share)
    pieces = BL.mask_pieces(packed(spark, grid), TILE, 8, 1)
    got = BL.rings(pieces, [], 8, 1)
    rows = pixel_rows(spark, grid).where("v = 1").select("image", "r", "c")
    assert ring_set(got) == ring_set(PG.polygonize(rows).where(~F.col("is_hole")))
    with_holes = BL.rings(pieces, [], 8, 1, outer_only=False)
    assert sorted(r.ring_id for r in with_holes.collect()) == sorted(r.ring_id for r in PG.polygonize(rows).collect())


def test_one_ring_over_all_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(BL, "LEVEL", 1)
    grid = np.zeros((96, 96), bool)
    grid[3:93, 3:93] = True
    grid[6:90, 6:90] = False
    grid[40:44, :50] = True
    pieces = BL.mask_pieces(packed(spark, grid), TILE, 8, 1)
    rows = pixel_rows(spark, grid).where("v = 1").select("image", "r", "c")
    assert ring_set(BL.rings(pieces, [], 8, 1)) == ring_set(PG.polygonize(rows).where(~F.col("is_hole")))


def made():
    """Not a module's own function, which workers would have to import."""
    def model():
        def run(tile):
            p = tile / 100
            return np.stack([1 - p, p, np.abs(np.diff(p, axis=0, prepend=p[:1])) / 4])
        return run
    return model


model = made()


@pytest.mark.parametrize("seed", [5, 6])
def test_masks_and_maps_like_pixel_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(BL, "BLOCK", 32)
    rng = np.random.default_rng(seed)
    grid = (noisy(seed, (96, 96)) * 70 + rng.integers(0, 30, (96, 96))).astype(int)
    params = SegmentationParams(building_threshold=0.45, min_building_size=12, max_hole_size=9, morph_kernel_size=5, edge_threshold=0.2)
    tiles = packed(spark, grid).where("not (tile_r = 2 and tile_c = 3)").unionByName(packed(spark, grid[:48, :32], 7))
    probs = score.probabilities(score.score_tiles(tiles, model, TILE), TILE)
    want = segment.edge_guided(probs, params)
    got = BL.pixels(jobs.building_masks(tiles, model, TILE, params))
    key = lambda frame: sorted((r.image, r.r, r.c, r.v) for r in frame.select("image", "r", "c", "v").collect())
    assert key(got) == key(want)
    polys = segment.vectorize(segment.edge_guided(probs, params, vote=True), params, smooth=False)
    found = jobs.map_from_images(tiles, model, TILE, params)
    assert ring_set(found) == ring_set(polys) and found.columns == ["image", "label", "ring_id", "ring", "angle", "area"]


def test_stored_predictions_and_failed_tiles(spark, monkeypatch):
    monkeypatch.setattr(BL, "BLOCK", 32)
    grid = (noisy(8, (64, 64)) * 90).astype(int)
    params = SegmentationParams(building_threshold=0.45, min_building_size=4, max_hole_size=4, morph_kernel_size=3)
    tiles = packed(spark, grid)
    stored = score.score_tiles(tiles.where("tile_r < 2"), model, TILE)
    asked = []

    def only_rest():
        inner = model()

        def run(tile):
            asked.append(1)
            return inner(tile)
        return run

    assert ring_set(jobs.map_from_images(tiles, only_rest, TILE, params, stored=stored)) == ring_set(jobs.map_from_images(tiles, model, TILE, params))
    short = tiles.withColumn("data", F.when(F.col("tile_r") == 1, F.slice("data", 1, 5)).otherwise(F.col("data")))
    assert ring_set(jobs.map_from_images(short, model, TILE, params)) == ring_set(jobs.map_from_images(tiles.where("tile_r <> 1"), model, TILE, params))


def test_small_parts_like_labelling():
    from footgrid.operators.components import _label_grid
    for seed in range(5):
        a = noisy(seed, (40, 53), 0.5)
        label = _label_grid(a)
        size = np.bincount(label[a], minlength=a.size)
        assert (BL.small_parts(a, 12) == (a & (size[label] < 12))).all()
    assert not BL.small_parts(np.zeros((3, 3), bool), 5).any() and BL.small_parts(np.ones((2, 2), bool), 5).all()


def test_burnt_tiles(spark):
    runs = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 4, 9), (1, 7, 0, 10), (2, 3, 1, 2)], "image long, r int, a int, b int")
    images = spark.createDataFrame([(1, 10, 9), (2, 4, 4), (3, 3, 3)], SIZES)
    got = {(r.image, r.tile_r, r.tile_c): np.array(r.data).reshape(4, 4) for r in BL.burn_tiles(runs, images, 4, on=7).collect()}
    want = np.zeros((8, 8), int)
    want[0, 2:8] = 7
    want[7] = 7
    assert set(got) == {(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0)}
    assert (np.block([[got[1, 0, 0], got[1, 0, 1]], [got[1, 1, 0], got[1, 1, 1]]]) == want).all() and got[2, 0, 0][3].tolist() == [0, 7, 0, 0]


def test_empty(spark):
    tiles = spark.createDataFrame([], "image long, tile_r int, tile_c int, data array<double>")
    assert jobs.map_from_images(tiles, model, TILE, SegmentationParams()).count() == 0
    assert BL.pixels(jobs.building_masks(tiles, model, TILE, SegmentationParams())).count() == 0


def test_building_over_tiles_and_two_overlapping_images_comes_out_once(spark):
    """Two images overlap by half a tile; a building lies over the border of both, and over tile borders."""
    plane = np.zeros((64, 112), bool)
    plane[10:40, 30:75] = True
    plane[50:60, 2:12] = True                             # far from any settlement
    left, right = plane[:, :64], plane[:, 48:112]
    tiles = packed(spark, left * 100, 1).unionByName(packed(spark, right * 100, 2))
    images = spark.createDataFrame([(1, 64, 64, "plane", (0.5, 0.0, 100.0, 0.0, -0.5, 50.0)), (2, 64, 64, "plane", (0.5, 0.0, 124.0, 0.0, -0.5, 50.0))],
                                   SIZES + ", crs string, t struct<a double, b double, c double, d double, e double, f double>")
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    aois = spark.createDataFrame([(5, 116.0, 32.0, 126.0, 44.0, box(116.0, 32.0, 126.0, 44.0)), (9, 126.0, 31.0, 136.0, 44.0, box(126.0, 31.0, 136.0, 44.0))],
                                 "key int, xmin double, ymin double, xmax double, ymax double, ring array<struct<x: double, y: double>>")
    params = SegmentationParams(morph_kernel_size=1, min_building_size=1, max_hole_size=1, min_building_area=0, simplify_tolerance=0, use_mbr=False, buffer_distance=0)
    got = jobs.map_settlements(tiles, model, TILE, params, aois, "key", images, has_edge=False).collect()
    assert [(r.key, r.group) for r in got] == [(5, 5)]
    xs, ys = {p.x for p in got[0].ring}, {p.y for p in got[0].ring}
    assert (min(xs), max(xs), min(ys), max(ys)) == (100 + 0.5 * 29, 100 + 0.5 * 76, 50 - 0.5 * 41, 50 - 0.5 * 9)       # one dilation


def test_first_tile_wins_where_tiles_overlap(spark):
    on, off = [1.0] * 16, [0.0] * 16
    rows = [((0, 0, 0, 2), on), ((0, 0, 2, 1), off), ((0, 2, 2, 3), on)]
    tiles = spark.createDataFrame(rows, "place struct<image: long, r: int, c: int, rank: int>, data array<double>")
    grid = to_grid(BL.pixels(BL.chain(BL.mask_pieces(tiles, 4, 8, 1), [], 8)), (6, 6))
    want = np.zeros((6, 6))
    want[0:4, 0:2] = 1
    want[4:6, 2:6] = 1
    assert (grid == want).all()
