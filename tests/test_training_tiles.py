"""Training tiles from pieces of pixel rows against the same job on pixel rows."""

import random

from pyspark.sql import functions as F

from footgrid.config import TilingParams, TrainParams
from footgrid.functions import geometry as G, names as N, pixel as P
from footgrid.operators import burn, metrics as M, sampling, spatial_join as SJ, tiling as T
from footgrid.plans import jobs

BANDS = ["band1", "band2", "band3"]


def by_pixels(bands, images, labels, params, train):
    """The job on pixel rows."""
    rgb = T.to_bytes(T.select_rgb(bands)).groupBy("image", "r", "c").agg(*[F.max(F.when(F.col("band") == i, F.col("v"))).alias(f"band{i}") for i in (1, 2, 3)])
    columns = list(BANDS)
    if labels is not None:
        hit = SJ.labels_in_images(M.raster_bounds(images), labels.withColumnRenamed("pid", "bid"), 64.0)
        polys = burn.to_pixel_rings(hit.withColumnRenamed("bid", "pid").join(labels.select("pid", "ring"), "pid"), images)
        rgb = rgb.join(hit.select("image").distinct(), "image", "left_semi")
        mask = burn.training_mask(rgb.select("image", "r", "c"), polys, params.shrink_factor, params.has_edge, params.erosion, params.distance_weighting)
        columns += [c for c in ("building", "edge", "weight") if c in mask.columns]
        rgb = rgb.join(mask, ["image", "r", "c"])
    pos = ((F.col("r") % params.tile_size) * params.tile_size + F.col("c") % params.tile_size).cast("int").alias("pos")
    packed = T.cut(rgb, images, params.tile_size).groupBy(*T.TILE_KEYS).agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("px"))
    tiles = packed.select(*T.TILE_KEYS, N.tile_name(*map(F.col, T.TILE_KEYS)).alias("name"), *[F.col(f"px.{c}").alias(c) for c in columns])
    return sampling.split(tiles, "name", train.test_size, train.seed) if train else tiles


def scene(spark, tmp_path):
    """Three images, the last one without a label: pixels in any order, some missing, some twice, some bands absent, remainders right and below."""
    rng = random.Random(5)
    rows = []
    for image, (h, w) in {"a": (47, 53), "b": (40, 81), "c": (20, 20)}.items():
        for r in range(h):
            for c in range(w):
                if rng.random() < 0.04 or (image == "a" and 12 <= r < 15 and c > 20):
                    continue
                for band in (1, 2, 3):
                    if rng.random() < 0.98:
                        rows.append((image, band, r, c, rng.choice([None, -7.5, 300.0, 40.9] + [float(rng.randrange(256))] * 20), 3))
                    if rng.random() < 0.02:
                        rows.append((image, band, r, c, float(rng.randrange(256)), 3))
    half = len(rows) // 2                                # one half in order, the other one not
    tail = rows[half:]
    rng.shuffle(tail)
    rows = rows[:half] + tail + [(None, 1, 0, 0, 1.0, 3), ("a", 1, None, 3, 1.0, 3), ("a", 1, 3, None, 1.0, 3)]
    schema = "image string, band int, r int, c int, v double, n_bands int"
    spark.createDataFrame(rows, schema).coalesce(3).write.parquet(f"{tmp_path}/bands")
    bands = spark.read.parquet(f"{tmp_path}/bands")
    images = spark.createDataFrame([("a", 53, 47, 0.0), ("b", 81, 40, 200.0), ("c", 20, 20, 900.0)], "image string, width int, height int, x double").select(
        "image", "width", "height", P.affine(1, 0, F.col("x"), 0, 1, 0).alias("t"))
    boxes = [(1, 3, 4, 12, 13), (2, 18, 10, 31, 22), (3, 44, 30, 60, 60), (4, 190, -3, 212, 9), (5, 262, 16, 290, 34), (6, 215, 20, 216, 21)]
    labels = spark.createDataFrame([(float(a), float(b), float(c), float(d), k) for k, a, b, c, d in boxes], "x0 double, y0 double, x1 double, y1 double, pid long")
    labels = labels.select("pid", G.box_ring("x0", "y0", "x1", "y1").alias("ring"), *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"))])
    return bands, images, labels


def test_tiles_of_pieces_are_those_of_pixels(spark, tmp_path, monkeypatch):
    bands, images, labels = scene(spark, tmp_path)
    monkeypatch.setattr(T, "PIECE_ROWS", 1500)
    edge = ("background", "building", "edge")
    for params, some, train in ((TilingParams(tile_size=10, codes=edge, distance_weighting=True), labels, TrainParams()), (TilingParams(tile_size=10), None, None)):
        want, got = by_pixels(bands, images, some, params, train), jobs.prepare_tiles(bands, images, some, params, train)
        assert got.dtypes == want.dtypes
        rows = {x.name: x for x in got.collect()}
        assert len(rows) >= 50 and rows == {x.name: x for x in want.collect()}


def test_no_pixel_is_a_row_after_the_bands(spark):
    lines = spark.range(40).select(F.lit(7).alias("image"), F.col("id").cast("int").alias("r"))
    px = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("c")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("band")).withColumn("v", F.col("c") + F.col("band"))
    pieces = T.row_pieces(px, 25)
    assert pieces.count() == 80 and {(x.n, x.c, bytes(x.band2)[:2], x.gaps) for x in pieces.collect()} == {(25, 0, b"\x02\x03", None), (25, 25, b"\x1b\x1c", None)}
    images = spark.createDataFrame([(7, 50, 40)], "image int, width int, height int").withColumn("t", P.affine(1, 0, 0, 0, 1, 0))
    labels = spark.createDataFrame([(1, 3.0, 3.0, 9.0, 9.0)], "pid long, x0 double, y0 double, x1 double, y1 double")
    labels = labels.select("pid", G.box_ring("x0", "y0", "x1", "y1").alias("ring"), *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"))])
    t = jobs.prepare_tiles(px.withColumn("n_bands", F.lit(3)), images, labels, TilingParams(tile_size=10, distance_weighting=True), TrainParams())
    text = t._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "band#" not in text
    assert {x.n for x in t.select(F.size("weight").alias("n")).collect()} == {100}
