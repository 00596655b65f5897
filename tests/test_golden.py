"""Small cases with known answers."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import pixel_rows
from footgrid.config import MissingKey, SegmentationParams, TilingParams, TrainParams, fill, require_column
from footgrid.functions import geometry as G, pixel as P
from footgrid.operators import components as C, metrics as M, polygonize as PG, segment, stencil as S, tiling as T
from footgrid.plans import jobs
from footgrid.sources import registry


def square(spark, image, lo, hi, value, name, side=256):
    inside = (F.col("r") >= lo) & (F.col("r") < hi) & (F.col("c") >= lo) & (F.col("c") < hi)
    return (spark.range(side).select(F.lit(image).alias("image"), F.col("id").cast("int").alias("r"),
                                     F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("c"))
            .withColumn(name, F.when(inside, value).otherwise(0).cast("double")))


@pytest.mark.parametrize("threshold, expected", [(0.5, 0.0), (0.1, 1.0)])
def test_two_shifted_squares(spark, threshold, expected):
    truth = square(spark, 0, 30, 70, 255, "truth").union(square(spark, 1, 30, 70, 255, "truth"))
    pred = square(spark, 0, 50, 90, 1, "pred").union(square(spark, 1, 50, 90, 1, "pred"))
    m = jobs.evaluate(truth, pred, threshold).first()
    assert (m.precision, m.recall, m.accuracy, m.dice, m.iou) == (0.25, 0.25, 0.963, 0.25, 0.143)
    assert (m.building_precision, m.building_recall) == (expected, expected)


def test_one_square_is_one_polygon_and_zeros_give_none(spark):
    mask = square(spark, 0, 22, 42, 1, "v", 64).union(square(spark, 1, 0, 0, 1, "v", 64))
    polys = segment.vectorize(mask.withColumn("v", F.col("v").cast("int")), SegmentationParams()).collect()
    # the vote takes the square's four corner pixels away, so the squared-up area is near 400
    assert [p.image for p in polys] == [0] and abs(polys[0].area - 400) < 8


def test_empty_result_keeps_schema(spark, tmp_path):
    from footgrid.sources import sinks
    sinks.write_polygons(sinks.empty_polygons(spark), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["image", "label", "ring_id", "ring", "area"]


def test_block_without_centre_and_corner_touch(spark):
    ring = [[0] * 5, [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0] * 5]
    rows = PG.polygonize(pixel_rows(spark, ring).where("v = 1")).collect()
    assert sorted(r.area for r in rows) == [-1.0, 9.0]
    touch = PG.polygonize(pixel_rows(spark, [[1, 0], [0, 1]]).where("v = 1")).collect()
    assert len(touch) == 2 and len({r.label for r in touch}) == 2


@pytest.mark.parametrize("n_images, expected", [(2, 8), (1, 4)])
def test_tile_counts(spark, n_images, expected):
    images = spark.range(n_images).select(F.col("id").alias("image"), F.lit(1024).alias("width"), F.lit(1024).alias("height"))
    assert T.grid_size(images, 512).agg(F.sum("n_tiles")).first()[0] == expected
    with pytest.raises(PySparkException, match="tile_size is bigger"):
        T.grid_size(images, 2048).collect()


def test_class_index(spark):
    got = M.class_index(pixel_rows(spark, [[0, 255], [255, 0]]), "v").collect()
    assert [(r.idx, r.value) for r in got] == [(0, 0), (1, 255)]


def test_model_resolution(spark):
    reg = lambda *rows: spark.createDataFrame(list(rows), "kind string, version string, file string")
    one = reg(("model", "a", "a.pkl"))
    two = reg(("model", "a", "a.pkl"), ("model", "b", "b.pkl"), ("base", "x", "x.pkl"))
    bases = reg(("base", "x", "x.pkl"), ("base", "y", "y.pkl"))
    assert registry.resolve(one).first().file == "a.pkl"
    assert registry.resolve(one, "unknown").first().file == "a.pkl"
    assert registry.resolve(two, "b").first().file == "b.pkl"
    assert registry.resolve(two, finetune=True).first().file == "x.pkl"
    assert registry.resolve(bases, "y", finetune=True).first().file == "y.pkl"
    for bad in (lambda: registry.resolve(two), lambda: registry.resolve(bases, finetune=True),
                lambda: registry.resolve(reg(("model", "a", "1.pkl"), ("model", "a", "2.pkl")))):
        with pytest.raises(PySparkException):
            bad().collect()


def make_loader():
    """Loader defined inside a function, so that it travels to the tasks by value."""
    def load():
        return lambda t: np.stack([1 - t, t])
    return load


model = make_loader()


def tiles_and_aois(spark, aoi):
    px = square(spark, 0, 8, 24, 1, "v", 64)
    images = spark.createDataFrame([(0, 64, 64)], "image int, width int, height int")
    tiles = T.pack(T.cut(px, images, 32), 32)
    return tiles, spark.createDataFrame(aoi, "OBJECTID int, xmin double, ymin double, xmax double, ymax double")


def test_settlement_map_and_its_errors(spark):
    p = SegmentationParams(morph_kernel_size=3)
    tiles, aois = tiles_and_aois(spark, [(7, 0.0, 0.0, 20.0, 20.0), (9, 5.0, 5.0, 20.0, 20.0)])
    got = jobs.map_settlements(tiles, model, 32, p, aois, "OBJECTID", has_edge=False).collect()
    assert [(r.OBJECTID, r.image) for r in got] == [(7, 0)]
    _, far = tiles_and_aois(spark, [(7, 900.0, 900.0, 920.0, 920.0)])
    with pytest.raises(FileNotFoundError, match="No tile touches"):
        jobs.map_settlements(tiles, model, 32, p, far, "OBJECTID", has_edge=False)
    with pytest.raises(ValueError, match="without rows"):
        jobs.map_settlements(tiles, model, 32, p, aois.where("OBJECTID < 0"), "OBJECTID", has_edge=False)
    for kind in (ValueError, KeyError, MissingKey):
        with pytest.raises(kind, match="wrong"):
            require_column(aois, "wrong")


def test_no_settlements_means_no_filter(spark):
    from footgrid.operators.score import score_in_settlements
    tiles, _ = tiles_and_aois(spark, [(7, 0.0, 0.0, 1.0, 1.0)])
    assert score_in_settlements(tiles, model, 32, None).count() == 4


def test_detect_image_reports_incomplete(spark):
    px = square(spark, 0, 8, 24, 1, "v", 64)
    images = spark.createDataFrame([(0, 64, 64)], "image int, width int, height int")
    polys, report = jobs.detect_image(px, images, model, 32)
    assert [r.area for r in polys.collect()] == [18.0 * 18.0] and report.first().complete

    def failing():
        def f(t):
            if t.sum() == 0:
                raise ValueError("blank tile")
            return np.stack([1 - t, t])
        return f
    polys, report = jobs.detect_image(px, images, failing, 32)
    assert polys.count() == 0 and not report.first().complete


def test_parameters():
    assert fill(SegmentationParams, {"building_threshold": 0, "edge_threshold": None}).building_threshold == 0
    assert fill(SegmentationParams, {"edge_threshold": None}).edge_threshold == 0.1
    assert not fill(TilingParams, {"codes": ["background", "building"], "erosion": True}).has_edge
    for bad in ({"test_size": 1.5}, {"epochs": 1.5}, {"architecture": "other"}):
        with pytest.raises((ValueError, AssertionError)):
            fill(TrainParams, bad)


def test_band_count_must_be_known(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 5, 5)], "image int, band int, r int, c int, v int, n_bands int")
    with pytest.raises(PySparkException, match="Unexpected number of bands"):
        T.select_rgb(df).collect()


def test_erosion_without_edge_class(spark):
    from footgrid.operators import burn
    frame = pixel_rows(spark, np.zeros((16, 16))).select("image", "r", "c")
    polys = spark.createDataFrame([(0, 1, 3.0, 3.0, 9.0, 9.0, 16, 16)],
                                  "image long, pid long, x0 double, y0 double, x1 double, y1 double, width int, height int")
    polys = polys.withColumn("ring", G.box_ring("x0", "y0", "x1", "y1"))
    m = burn.training_mask(frame, polys, erosion=True, weights=True)
    assert m.where("building = 255").count() == 16
    assert m.agg(F.max("weight")).first()[0] == 1.0        # boundaries burn 1, so weights are not all zero


def test_affine_round_trip_and_truncation(spark):
    t = P.affine(0.5, 0.1, 500000, -0.1, -0.5, 7000000)
    df = spark.range(1).withColumn("t", t)
    x, y = P.to_world(F.lit(10.0), F.lit(20.0), F.col("t"))
    c, r = P.to_pixel(x, y, F.col("t"))
    row = df.select(F.round(c, 6).alias("c"), F.round(r, 6).alias("r"), F.lit(-0.7).cast("int").alias("z")).first()
    assert (row.c, row.r, row.z) == (10.0, 20.0, 0)


def test_kernels():
    assert S.ellipse(3) == {-1: 0, 0: 1, 1: 0} and S.ellipse(5) == {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
    assert C.ROW > 2 ** 31
