"""Work stays spread and nothing whole goes through the driver, whatever the estimates say."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from footgrid.functions import geometry as G
from footgrid.operators import blocks as BL, burn, score, spatial_join as SJ, stencil as S
from footgrid.plans import inputs as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def squares(spark, n=3, side=90.0):
    rows = [(0, k, [(5.0 * k, 2.0), (5.0 * k + side, 2.0), (5.0 * k + side, 70.0), (5.0 * k, 70.0), (5.0 * k, 2.0)], 200, 100) for k in range(n)]
    return spark.createDataFrame(rows, f"image long, pid long, ring {G.RING_TYPE}, width int, height int")


def test_overlay_never_broadcasts_outlines(spark):
    polys = squares(spark)
    rgb = spark.range(1).select(F.col("id").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("r")).select(
        "image", "r", F.explode(F.sequence(F.lit(-2), F.lit(199))).alias("c")).select("*", *[F.lit(7).alias(n) for n in ("red", "green", "blue")])
    rgb = rgb.unionByName(rgb.where("r = 2 and c = 65")).unionByName(rgb.limit(1).withColumn("c", F.lit(None).cast("int")))
    out = burn.overlay(rgb, polys)
    assert "Broadcast" not in plan(out)
    lines = {(x.r, x.c) for x in burn.outline(polys).collect()}
    got = out.collect()
    assert len(got) == 100 * 202 + 2
    assert all(((x.r, x.c) in lines) == (x.red == 255) == (x.green == 0) for x in got)


def test_burnt_tiles_never_broadcast_runs(spark):
    runs = burn.spans(squares(spark))
    images = runs.select("image").distinct().select("image", F.lit(200).alias("width"), F.lit(100).alias("height"))
    assert "Broadcast" not in plan(BL.burn_tiles(runs, images, 50))


def test_ring_pairs_never_broadcast_rings(spark):
    polys = SJ.with_bounds(squares(spark)).select("pid", "ring", "xmin", "ymin", "xmax", "ymax")
    pairs = SJ.ring_pairs(polys, polys.withColumnRenamed("pid", "bid"), "pid", "bid", 64.0)
    join = plan(pairs)
    assert pairs.count() == 9 and join.count("SortMergeJoin [pid") >= 1 and join.count("SortMergeJoin [bid") >= 1


def test_dense_frames_are_spread_by_pixels(spark):
    images = spark.range(16).select(F.col("id").alias("image"))
    parts = I.frame(images, 1024, 1024).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(x.n for x in parts) == 16 << 20 and max(x.n for x in parts) < 4 << 20


def test_footprints_are_spread_by_rows(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    b = I.buildings(spark, str(tmp_path))
    assert b.count() == 50_000 and b.select(F.spark_partition_id()).distinct().count() >= 8


def test_moves_work_out_their_centre_once(spark):
    ring = squares(spark, 1).select("ring")
    for moved in (G.rotate(F.col("ring"), 30.0), G.scale(F.col("ring"), 0.5)):
        text = ring.select(moved.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("aggregate(") <= 3
    assert ring.select(G.dominant_angle(F.col("ring")).alias("m"))._jdf.queryExecution().optimizedPlan().toString().lower().count("atan2") == 1
    empty = ring.select(F.slice("ring", 1, 0).alias("ring"), F.lit(None).cast(G.RING_TYPE).alias("none"))
    assert empty.select(G.rotate(F.col("ring"), 30.0).alias("a"), G.scale(F.col("ring"), 0.5).alias("b"), G.rotate(F.col("none"), 30.0).alias("c"), G.scale(F.col("none"), 0.5).alias("d")).first() == ([], [], None, None)
    x = ring.select(G.scale(F.col("ring"), 0.5, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("g")).first().g
    assert [(p.x, p.y) for p in x][1] == (45.0, 1.0)


def test_scores_leave_the_worker_some_at_a_time():
    class Tiles:
        dtypes = [("image", "bigint"), ("tile_r", "int"), ("tile_c", "int"), ("data", "array<int>")]

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    def load():
        return lambda a: np.stack([1 - a, a]) if a[0, 0] != 3 else 1 / 0

    pdf = pd.DataFrame({"image": range(1500), "tile_r": 0, "tile_c": 0, "data": [np.full(1024, k, np.int32) for k in range(1500)]})
    out = list(score.score_tiles(Tiles(), load, 32)(iter([pdf])))
    assert max(len(x) for x in out) * 1024 <= score.CELLS
    whole = pd.concat(out)
    assert whole["image"].tolist() == list(range(1500))
    assert whole["scores"].iloc[3] is None and whole["error"].iloc[3].startswith("ZeroDivisionError")
    assert [list(map(float, set(p))) for p in whole["scores"].iloc[9]] == [[-8.0], [9.0]]


def test_dense_pixels_are_spread_by_number(spark, sf, monkeypatch):
    monkeypatch.setattr(I, "PIXELS_PER_TASK", 1024)
    parts = I.pixels(spark, sf).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(parts) > 10 and max(p.n for p in parts) < 4096
    tp = I.truth_pred(spark, sf)
    assert tp.count() == tp.select("image", "r", "c").distinct().count()


def test_blocks_are_spread_by_number(spark):
    px = spark.range(40).select(F.col("id").alias("image"), F.lit(1).alias("r"), F.lit(2).alias("c"), F.lit(3).alias("v"))
    step = ("max", S.square(3))
    for out in (S.morphology(px, "v", [step, step], tasks=40), S.median3(px, tasks=40)):
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 15


def test_words_meet_across_their_borders(spark):
    rng = np.random.default_rng(5)
    height, width = 12, 150
    on = rng.random((height, width)) < 0.8
    on[:, 60:70] = True
    mask = spark.createDataFrame([(7, int(r), int(c)) for r, c in np.argwhere(on)], "image long, r int, c int")
    sizes = spark.createDataFrame([(7, width, height)], "image long, width int, height int")
    words = S.to_words(mask.unionByName(mask))
    assert words.count() <= 3 * height
    for element in (S.square(3), S.ellipse(5), {0: 65}):
        offsets = [(dy, dx) for dy, w in element.items() for dx in range(-w, w + 1)]
        near = [[[on[r + dy, c + dx] for dy, dx in offsets if 0 <= r + dy < height and 0 <= c + dx < width] for c in range(width)] for r in range(height)]
        for f, op in ((S.shrink_words, all), (S.spread_words, any)):
            got = {(x.r, x.c) for x in S.from_words(f(words, element, sizes)).collect()}
            assert got == {(r, c) for r in range(height) for c in range(width) if op(near[r][c])}


def test_masks_meet_rasters_as_words(spark):
    polys = squares(spark)
    frame = spark.range(100).select(F.lit(0).cast("long").alias("image"), F.col("id").cast("int").alias("r")).select(
        "image", "r", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("c"))
    frame = frame.unionByName(frame.limit(5)).unionByName(frame.limit(1).withColumn("c", F.lit(None).cast("int")))
    m = burn.training_mask(frame, polys, edge=True, erosion=False, tasks=20).collect()
    inside, lines = ({(x.r, x.c) for x in f(polys).collect()} for f in (burn.fill, burn.outline))
    assert len(m) == 100 * 200 + 1
    assert all(((x.r, x.c) in lines) == (x.edge == 255) and ((x.r, x.c) in inside - lines) == (x.building == 255) for x in m)
