"""Queries over what sources read and sinks write: tables go to files in the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SegmentationParams
from ..functions import geometry as G, names as N
from ..operators import augment, blocks as BL, metrics as M, score
from ..session import cut_lineage, new_folder
from ..sources import labels as LB, sinks, tasks as TK
from . import inputs as I, jobs
from .catalog import ORACLES, query
from .pixel_queries import TILE, _tile_cols
from .record_queries import _packed, brightness_model, footprint_tiles
from .vector_queries import _boxes
from .views_sql import AOIS, BUILDINGS, MASK, METRIC_SUMS, PIXELS, TASKS, TRUTH_PRED


@query("tasks_from_files", f"with {TASKS} select id, image_name, label, round(pw * 5.12 * pw * 5.12, 4) as area, (id % 16)::int as file from tk")
def tasks_from_files(spark, sf):
    """Task exports, one JSON array per file, among damaged elements that must not spoil their file."""
    path = new_folder(spark, "exports")
    t = I.tasks(spark, sf).select((F.col("id") % 16).alias("doc"), F.lit(1).alias("place"), F.concat(F.lit(","), "json").alias("value"))
    docs = t.select("doc").distinct()
    ends = [docs.select("doc", F.lit(k).alias("place"), F.lit(v).alias("value")) for k, v in ((0, '[{"id":1}'), (2, ',"nothing"]'))]
    # rows of a file are sorted and streamed into it, never joined into one value
    (t.unionByName(ends[0]).unionByName(ends[1]).repartition("doc").sortWithinPartitions("doc", "place").select("doc", "value")
     .write.partitionBy("doc").text(path))
    tasks = TK.read_tasks(spark, path).where("corrupt is null")
    return TK.task_polygons(tasks).select("id", "image_name", "label", F.round(G.area(F.col("ring")), 4).alias("area"), (F.col("id") % 16).cast("int").alias("file"))


@query("csv_labels_from_files", f"with {BUILDINGS} select ((x1 - x0) * (y1 - y0))::double as area, x0::double as xmin, y0::double as ymin, confidence from bld")
def csv_labels_from_files(spark, sf):
    """Labels through gzipped CSV with WKT."""
    path = new_folder(spark, "labels") + ".csv.gz"
    I.buildings(spark, sf).select("confidence", F.col("wkt").alias("geometry")).write.option("header", True).option("compression", "gzip").csv(path)
    r = LB.polygons_of_wkt(LB.label_csv(spark, path)).withColumn("b", G.bounds(F.col("ring")))
    return r.select(G.area(F.col("ring")).alias("area"), F.col("b.xmin").alias("xmin"), F.col("b.ymin").alias("ymin"), "confidence")


@query("tiles_rewritten", f"""with {PIXELS} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c, sum(v + case when image % 2 = 1 then 1 else 0 end)::bigint as total
 from px group by all""")
def tiles_rewritten(spark, sf):
    """All images' tiles are written, then those of odd images again with other values; the rest stays."""
    path = new_folder(spark, "tiles")
    tiles = cut_lineage(_packed(spark, sf))
    sinks.write_tiles(tiles, path)
    sinks.write_tiles(tiles.where("image % 2 = 1").withColumn("data", F.transform("data", lambda v: v + 1)), path)
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v)
    return sinks.read_tiles(spark, path).select(F.col("image").cast("long").alias("image"), "tile_r", "tile_c", total.alias("total"))


@query("polygons_written", f"with {BUILDINGS} select bid::varchar as bid, ((x1 - x0) * (y1 - y0))::double as area, 'Polygon' as geom_type from bld")
def polygons_written(spark, sf):
    """Footprints written as lines of GeoJSON and read again."""
    path = new_folder(spark, "geojson")
    LB.write_geojson_lines(_boxes(I.buildings(spark, sf)).select("bid", "ring"), path)
    one = LB.GEOJSON_SCHEMA["features"].dataType.elementType
    read = spark.read.text(path).select(F.array(F.from_json("value", one)).alias("features"))
    return LB.geojson_features(read).select(F.col("properties")["bid"].alias("bid"), G.area(F.col("ring")).alias("area"), "geom_type")


@query("stored_scores_masks", ORACLES["edge_guided_mask"])
def stored_scores_masks(spark, sf):
    """Scores of all tiles but those of the first column are written and read; only the rest is scored anew."""
    path = new_folder(spark, "scores")
    tiles = cut_lineage(_packed(spark, sf))
    sinks.write_tiles(score.score_tiles(tiles.where("tile_c > 0"), brightness_model, TILE), path)
    stored = sinks.read_tiles(spark, path).select(F.col("image").cast("long").alias("image"), "tile_r", "tile_c", "scores", "error")
    params = SegmentationParams(building_threshold=0.05, edge_threshold=0.09, min_building_size=8, max_hole_size=4, morph_kernel_size=3)
    m = BL.pixels(jobs.building_masks(tiles, brightness_model, TILE, params, stored=stored))
    return m.groupBy("image").agg(F.sum("v").alias("n_building"), F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * (F.col("r") * 131 + F.col("c"))).alias("place_sum"))


@query("metrics_log", f"with {TRUTH_PRED}, s as (select image, {METRIC_SUMS} from tp group by image) select image, 2::bigint as n_rows, 2 * n_pred as n_pred from s")
def metrics_log(spark, sf):
    """Two evaluations appended to a log that was not there before."""
    path = new_folder(spark, "log")
    assert sinks.read_or_empty(spark, path, "image long, n_pred long").isEmpty()
    m = M.pixel_metrics(I.truth_pred(spark, sf), ("image",), 6)
    for _ in range(2):
        sinks.append_metrics(m, path)
    return sinks.read_or_empty(spark, path, "image long, n_pred long, eval_ts timestamp").groupBy("image").agg(
        F.count("eval_ts").alias("n_rows"), F.sum("n_pred").alias("n_pred"))


@query("intermediate_mask", f"with {TRUTH_PRED} select image, sum(g)::bigint as n_on from tp where r < 64 group by image")
def intermediate_mask(spark, sf):
    """A mask is kept on the way; the plan goes on from the copy."""
    path = new_folder(spark, "mask")
    kept = sinks.write_intermediate(I.truth_pred(spark, sf).select("image", "r", "c", "g"), path)
    return kept.where("r < 64").groupBy("image").agg(F.sum("g").alias("n_on"))


@query("sample_set", f"""with {MASK}, {AOIS}, tl as (select scene, k // 8 as tr, k % 8 as tc, scene || '_r' || (k // 8) || '_c' || (k % 8) || '.TIF' as name
 from (select distinct scene from bld), (select unnest(range(0, 64)) as k)),
s as (select * from tl where exists (select 1 from aoi a where a.scene = tl.scene and x0 <= (tc + 1) * 125 and x1 >= tc * 125 and y0 <= (tr + 1) * 125 and y1 >= tr * 125)
 order by md5('2022:' || name), name limit 20)
select name, count(m.r)::bigint as n_on, round(count(m.r) / 15625, 6)::double as mean_preview from s left join mask m on m.image = s.scene and m.r // 125 = tr and m.c // 125 = tc group by name""")
def sample_set(spark, sf):
    """The sampled tiles themselves, written as a set, read again, and their previews."""
    tiles = cut_lineage(footprint_tiles(spark, sf, 125))
    place = tiles.select(F.col("image").alias("scene"), "tile_r", "tile_c", N.tile_name(F.col("image"), F.col("tile_r"), F.col("tile_c")).alias("name"))
    picked = jobs.labeling_sample(place, _boxes(I.aois(spark, sf)), 20, 125.0, keys=("scene",))
    path = new_folder(spark, "sample")
    jobs.write_sample(tiles.withColumnRenamed("image", "scene"), picked, ["scene", "tile_r", "tile_c"], path)
    read = spark.read.parquet(path)
    on = F.size(F.filter("data", lambda v: v > 0)).cast("long")
    mean = F.aggregate("preview", F.lit(0.0), lambda a, v: a + v) / F.size("preview")
    return read.select("name", on.alias("n_on"), F.round(mean, 6).alias("mean_preview"))


@query("image_mask_pairs", f"""with {MASK} select 'open_' || image || '.tif' as new_name, count(*)::bigint as n_on from mask where image % 3 <> 1 group by image""")
def image_mask_pairs(spark, sf):
    """Open imagery with its masks under a new name, whole; the scenes that are there already are left alone."""
    b = _boxes(I.buildings(spark, sf))
    scenes = b.select("scene").distinct()
    from ..functions.pixel import affine
    images = scenes.select(F.col("scene").alias("code"), F.col("scene").alias("image"), affine(1, 0, 0, 0, 1, 0).alias("t"), F.lit(I.PLANE).alias("width"), F.lit(I.PLANE).alias("height"))
    files = scenes.select(F.col("scene").alias("image"), F.concat(F.lit("RGB_AOI_"), F.col("scene").cast("string"), F.lit("_x.tif")).alias("name"))
    existing = scenes.where("scene % 3 = 1").select(F.concat(F.lit("open_"), F.col("scene").cast("string"), F.lit(".tif")).alias("new_name"))
    path = new_folder(spark, "pairs")
    jobs.write_pairs(b.select(F.col("scene").alias("code"), F.col("bid").alias("pid"), "ring"), files, existing, images, r"^RGB_AOI_(\d+)_x\.tif$", "open_$1.tif", 250, path)
    on = F.aggregate("mask", F.lit(0).cast("long"), lambda a, v: a + F.when(v > 0, 1).otherwise(0))
    return spark.read.parquet(path).select("new_name", on.alias("n")).groupBy("new_name").agg(F.sum("n").alias("n_on"))


_UNIT = "('0x' || md5('7:{salt}:' || image || ':' || (r // 32) || ':' || (c // 32))[1:12])::bigint / 281474976710656.0::double"


@query("random_flip", f"""with {PIXELS} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c, (case when {_UNIT.format(salt="v")} < 0.5 then 31 - r % 32 else r % 32 end)::int as r,
 (case when {_UNIT.format(salt="h")} < 0.5 then 31 - c % 32 else c % 32 end)::int as c, v from px""")
def random_flip(spark, sf):
    t = _tile_cols(I.pixels(spark, sf)).withColumn("r", (F.col("r") % TILE).cast("int")).withColumn("c", (F.col("c") % TILE).cast("int"))
    return augment.random_flip(t, TILE, 7, "image", "tile_r", "tile_c").select("image", "tile_r", "tile_c", "r", "c", "v")


@query("pansharpened", ORACLES["brovey"] + " where image % 2 = 0")
def pansharpened(spark, sf):
    """Only the images of the plan are sharpened."""
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int").alias(n)
    ms = I.bands(spark, sf, 4).groupBy("image", "band", quarter("r"), quarter("c")).agg(F.sum("v").alias("v"))
    plan = I.images(spark, sf).where("image % 2 = 0").select(F.col("image").alias("name"))
    return jobs.pansharpen(ms, I.pixels(spark, sf), plan, 4, 4).withColumn("v", F.round("v", 6))
