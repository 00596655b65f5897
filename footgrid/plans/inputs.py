"""Imagery-shaped views over the driver tables.

Each view is integer arithmetic over a table's own keys, so its size grows with
the table and every engine sees the same input. Rasters are 128 x 128 pixels per
25 suppliers; footprints and settlements live on one 1000 x 1000 plane per scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G

SIDE = 128
PLANE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def idiv(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def n_tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """So many tasks that each gets about ``per_task`` of the rows, and no fewer than run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def dealt(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """Rows by key over so many tasks that each gets about ``per_task`` of the ``rows`` that come of them. The number is given:
    few bytes that stand for much work would else be merged into a few partitions for their size."""
    return df.repartition(n_tasks(df.sparkSession, rows, per_task), *keys)


PIXELS_PER_TASK = 1 << 20
SHAPES_PER_TASK = 5_000


def frame(images: DataFrame, height: int, width: int, key: str = "image") -> DataFrame:
    """Every pixel position of every image (one row per image in)."""
    lines = images.select(key, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r"))
    return (dealt(lines, images.count() * height * width, PIXELS_PER_TASK, key, "r")
            .select(key, "r", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c")))


def images(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(idiv(F.col("s_suppkey"), 25).alias("image")).distinct()


def _line_pixels(spark, sf_dir, *values: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        idiv(F.col("l_suppkey"), 25).alias("image"), (F.col("l_orderkey") % SIDE).cast("int").alias("r"),
        (F.col("l_partkey") % SIDE).cast("int").alias("c"), *values)


def _fill(spark, sf_dir, px: DataFrame, names: list[str]) -> DataFrame:
    """Dense raster: zeros of the frame and pixel rows meet in one aggregate.

    Both are dealt by pixel row, a row of zeros as one until it is there; the aggregate needs no shuffle then, and a task holds no
    more pixels than its share, however well they compress."""
    im = images(spark, sf_dir)
    zero = im.select("image", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("r"), F.lit(None).cast("int").alias("c"),
                     *[F.lit(0.0).alias(n) for n in names], F.lit(True).alias("_row"))
    rows = dealt(px.withColumn("_row", F.lit(False)).unionByName(zero), im.count() * SIDE * SIDE + px.count(), PIXELS_PER_TASK, "image", "r")
    c = F.when(F.col("_row"), F.sequence(F.lit(0), F.lit(SIDE - 1))).otherwise(F.array("c"))
    return rows.select("image", "r", F.explode(c).alias("c"), *names).groupBy("image", "r", "c").agg(*[F.sum(n).alias(n) for n in names])


def pixel_tasks(spark, sf_dir) -> int:
    """Tasks for every pixel of the dense rasters."""
    return n_tasks(spark, images(spark, sf_dir).count() * SIDE * SIDE, PIXELS_PER_TASK)


def pixels(spark, sf_dir) -> DataFrame:
    """``(image, r, c, v)``: single-band byte raster."""
    q = _fill(spark, sf_dir, _line_pixels(spark, sf_dir, F.col("l_quantity").alias("q")), ["q"])
    return q.select("image", "r", "c", F.least(F.lit(255), F.col("q")).cast("int").alias("v"))


def raw_pixels(spark, sf_dir) -> DataFrame:
    """``(image, r, c, v DOUBLE)``: unclipped values on both sides of the byte range."""
    q = _fill(spark, sf_dir, _line_pixels(spark, sf_dir, (F.col("l_quantity") * 4 - 60).alias("q")), ["q"])
    return q.select("image", "r", "c", F.col("q").alias("v"))


def truth_pred(spark, sf_dir) -> DataFrame:
    """``(image, r, c, g, p)``: ground-truth and predicted mask."""
    flipped = F.when(F.col("l_returnflag") == "R", 51 - F.col("l_quantity")).otherwise(F.col("l_quantity"))
    q = _fill(spark, sf_dir, _line_pixels(spark, sf_dir, F.col("l_quantity").alias("q"), flipped.alias("q2")),
              ["q", "q2"])
    return q.select("image", "r", "c", (F.col("q") >= 20).cast("int").alias("g"),
                    (F.col("q2") >= 20).cast("int").alias("p"))


def bands(spark, sf_dir, n_bands: int = 8) -> DataFrame:
    """``(image, band, r, c, v)``: multi-band raster in long form."""
    px = pixels(spark, sf_dir).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(n_bands))))
    return px.select("image", "band", "r", "c",
                     ((F.col("v") * 3 + F.col("band") * 31 + F.col("r") * 7 + F.col("c")) % 256).cast("int").alias("v"))


def buildings(spark, sf_dir) -> DataFrame:
    """``(scene, bid, x0, y0, x1, y1, confidence, wkt)`` footprints."""
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    b = dealt(part, part.count(), SHAPES_PER_TASK, "p_partkey").select(
        idiv(p, 2000).alias("scene"), p.alias("bid"),
        ((p * 7919) % PLANE).alias("x0"), ((p * 104729) % PLANE).alias("y0"),
        (2 + p % 5 + F.col("p_size") % 2).alias("w"), (2 + p % 8).alias("h"),
        ((p % 101) / 100.0).cast("double").alias("confidence"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    pt = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return b.select("scene", "bid", x0, y0, x1.alias("x1"), y1.alias("y1"), "confidence", F.concat(
        F.lit("POLYGON(("), F.concat_ws(", ", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)),
        F.lit("))")).alias("wkt"))


def predicted_buildings(spark, sf_dir) -> DataFrame:
    """Predicted footprints: all of them, shifted by none, one or two units."""
    b = buildings(spark, sf_dir)
    s = F.col("bid") % 3
    return b.select("scene", F.col("bid").alias("pid"), (F.col("x0") + s).alias("x0"), "y0",
                    (F.col("x1") + s).alias("x1"), "y1")


def rings(df: DataFrame) -> DataFrame:
    """Box columns to a ring column plus double bounds."""
    return df.withColumn("ring", G.box_ring("x0", "y0", "x1", "y1")).select(
        "*", F.col("x0").cast("double").alias("xmin"), F.col("y0").cast("double").alias("ymin"),
        F.col("x1").cast("double").alias("xmax"), F.col("y1").cast("double").alias("ymax"))


def aois(spark, sf_dir) -> DataFrame:
    """``(scene, aoi, x0, y0, x1, y1)`` settlement boundaries."""
    s = F.col("s_suppkey")
    x0, y0 = (s * 613) % 960, (s * 389) % 960
    return table(spark, sf_dir, "supplier").select(
        idiv(s, 100).alias("scene"), s.alias("aoi"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 40).alias("x1"), (y0 + 40).alias("y1"))


CLASSES = 10


def probs(spark, sf_dir) -> DataFrame:
    """``(vec_id, tile, z ARRAY<DOUBLE>, label, w)``: scores of ten classes with labels and weights."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", idiv(F.col("vec_id"), 100).alias("tile"),
        F.array(*[e[i].cast("double") * 4 for i in range(CLASSES)]).alias("z"),
        F.col("label").cast("int").alias("label"), (1 + (F.col("vec_id") % 5) / 4.0).alias("w"))


def tasks(spark, sf_dir) -> DataFrame:
    """``(id, json)`` labelling tasks as exported, one rectangle per order."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("img"), F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit(".TIF"))).alias("file_upload"),
        ((F.col("o_orderkey") * 37) % 90).cast("double").alias("px0"),
        ((F.col("o_orderkey") * 53) % 90).cast("double").alias("py0"),
        (1 + F.col("o_custkey") % 10).cast("double").alias("pw"), F.col("o_orderpriority").alias("label"))
    x0, y0, x1, y1 = F.col("px0"), F.col("py0"), F.col("px0") + F.col("pw"), F.col("py0") + F.col("pw")
    points = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    value = F.struct(points.alias("points"), F.array("label").alias("polygonlabels"))
    result = F.struct(F.lit(512).alias("original_width"), value.alias("value"))
    return o.select("id", F.to_json(F.struct(
        "id", "file_upload", F.array(F.struct(F.array(result).alias("result"))).alias("annotations"))).alias("json"))


def task_images(spark, sf_dir) -> DataFrame:
    """``(image_name, t)`` affines of the images named in the tasks."""
    k = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("k")).distinct()
    from ..functions.pixel import affine
    return k.select(F.concat(F.lit("img-"), F.col("k").cast("string"), F.lit(".TIF")).alias("image_name"),
                    affine(0.5, 0, 500000 + 1000 * F.col("k"), 0, -0.5, 7000000).alias("t"))


def scenes(spark, sf_dir) -> DataFrame:
    """``(path, name, done)`` multispectral and panchromatic image files."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("S"), idiv(k, 2).cast("string"), F.when(k % 2 == 0, "-M3DS").otherwise("-P3DS"),
                    F.lit("_R1C1.TIF"))
    return table(spark, sf_dir, "customer").where(~((k % 2 == 1) & (F.col("c_nationkey") < 5))).select(
        F.concat(F.lit("scenes/"), F.col("c_mktsegment"), F.lit("/"), name).alias("path"), name.alias("name"),
        (F.col("c_acctbal") < 0).cast("int").alias("done"))


def arrivals(spark, sf_dir) -> DataFrame:
    """``(event_id, ts, image, event_type, g, p)`` evaluation pixels arriving over time."""
    hit = F.col("value") >= 10
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 8).alias("image"), "event_type", hit.cast("int").alias("g"),
        F.when(hit == (F.col("event_id") % 3 == 0), 0).otherwise(1).alias("p"))
