"""Queries over pixel tables: metrics, bands, tiles, stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import augment, burn, metrics as M, resample, stencil as S, tiling as T
from . import inputs as I
from .catalog import query
from .views_sql import BANDS, FRAME, METRIC_SUMS, PIXELS, RAW, TRUTH_PRED, metric_ratios

TILE = 32


def image_sizes(spark, sf):
    """Image sizes and affines: half-metre pixels, one kilometre apart."""
    return I.images(spark, sf).select(
        "image", F.lit(I.SIDE).alias("width"), F.lit(I.SIDE).alias("height"), F.lit("EPSG:32636").alias("crs"),
        P.affine(0.5, 0, 500000 + 1000 * F.col("image"), 0, -0.5, 7000000).alias("t"))


# --- metrics and statistics -------------------------------------------------

@query("pixel_metrics", f"with {TRUTH_PRED}, s as (select {METRIC_SUMS} from tp) select *, {metric_ratios(3)} from s")
def pixel_metrics(spark, sf):
    return M.pixel_metrics(I.truth_pred(spark, sf))


@query("pixel_metrics_by_image", f"""with {TRUTH_PRED}, s as (select image, {METRIC_SUMS} from tp group by image)
select *, {metric_ratios(6)} from s""")
def pixel_metrics_by_image(spark, sf):
    return M.pixel_metrics(I.truth_pred(spark, sf), ("image",), 6)


def _tile_cols(df, tile=TILE):
    return df.withColumn("tile_r", F.floor(F.col("r") / tile).cast("int")).withColumn("tile_c", F.floor(F.col("c") / tile).cast("int"))


def _stored_predictions(spark, sf):
    """Predictions of all tiles but those on the grid diagonal of odd images."""
    tp = _tile_cols(I.truth_pred(spark, sf))
    return tp.where(~((F.col("tile_r") == F.col("tile_c")) & (F.col("image") % 2 == 1)))


@query("matched_tile_metrics", f"""with {TRUTH_PRED}, t as (select * from tp
  where not (r // 32 = c // 32 and image % 2 = 1)), s as (select {METRIC_SUMS} from t) select *, {metric_ratios(3)} from s""")
def matched_tile_metrics(spark, sf):
    truth = _tile_cols(I.truth_pred(spark, sf)).select("image", "tile_r", "tile_c", "r", "c", (F.col("g") * 255).alias("truth"))
    pred = _stored_predictions(spark, sf).select("image", "tile_r", "tile_c", "r", "c", (F.col("p") * 0.9).alias("pred"))
    return M.pixel_metrics(M.match_masks(truth, pred, ["image", "tile_r", "tile_c", "r", "c"]))


@query("tile_building_share", f"""with {TRUTH_PRED} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c,
 round(avg((g <> 0)::int::double), 6) as share from tp group by all""")
def tile_building_share(spark, sf):
    return M.building_share(_tile_cols(I.truth_pred(spark, sf)), "g", ["image", "tile_r", "tile_c"]) \
        .withColumn("share", F.round("share", 6))


@query("building_share_hist", f"""with {TRUTH_PRED}, s as (select image, r // 32 as tr, c // 32 as tc,
 avg((g <> 0)::int::double) as share from tp group by all), m as (select min(share) as lo, max(share) as hi from s)
select least(floor((share - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from s, m group by 1""")
def building_share_hist(spark, sf):
    return M.share_histogram(M.building_share(_tile_cols(I.truth_pred(spark, sf)), "g", ["image", "tile_r", "tile_c"]))


@query("value_share", f"with {TRUTH_PRED} select image, round(avg((g = 1)::int::double), 6) as share from tp group by all")
def value_share(spark, sf):
    return M.value_share(I.truth_pred(spark, sf), "g", 1, ["image"]).withColumn("share", F.round("share", 6))


@query("class_index_map", f"with {PIXELS} select (row_number() over (order by v) - 1)::int as idx, v as value from (select distinct v from px)")
def class_index_map(spark, sf):
    return M.class_index(I.pixels(spark, sf), "v").select("idx", "value")


_CONF = f"{TRUTH_PRED}, cf as (select g + (r % 2) as label, p + (r % 2) as pred, count(*) as n from tp group by all)"


def _confusion(spark, sf):
    tp = I.truth_pred(spark, sf).select((F.col("g") + F.col("r") % 2).alias("label"), (F.col("p") + F.col("r") % 2).alias("pred"))
    return M.confusion(tp)


@query("confusion_matrix", f"with {_CONF} select label::int as label, pred::int as pred, n from cf")
def confusion_matrix(spark, sf):
    return _confusion(spark, sf)


@query("dice_jaccard_by_class", f"""with {_CONF}, k as (select label as cls from cf union select pred from cf),
s as (select cls, coalesce((select sum(n) from cf where label = cls), 0) as t, coalesce((select sum(n) from cf where pred = cls), 0) as p,
 coalesce((select sum(n) from cf where label = cls and pred = cls), 0) as i from k)
select cls::int as cls, round(2 * i::double / (t + p), 6) as dice, round(i::double / (t + p - i), 6) as jaccard from s""")
def dice_jaccard_by_class(spark, sf):
    return M.class_scores(_confusion(spark, sf))


@query("empty_mask_images", f"""with {TRUTH_PRED} select image, max(case when image % 3 = 1 then 0 else g end)::int as top from tp
 group by image having max(case when image % 3 = 1 then 0 else g end) = 0""")
def empty_mask_images(spark, sf):
    tp = I.truth_pred(spark, sf).withColumn("g", F.when(F.col("image") % 3 == 1, 0).otherwise(F.col("g")))
    return M.empty_masks(tp, "g")


# --- values and bands -------------------------------------------------------

@query("clip_to_byte", f"with {RAW} select image, r, c, trunc(least(greatest(v, 0), 255))::int as v from raw")
def clip_to_byte(spark, sf):
    return T.to_bytes(I.raw_pixels(spark, sf))


@query("value_range", f"""with {RAW} select image, min(v) as vmin, max(v) as vmax, (min(v) < 0 or max(v) > 255) as clipped
 from raw group by image""")
def value_range(spark, sf):
    return M.value_range(I.raw_pixels(spark, sf), "v", ["image"])


def _rgb_sql(profile: str) -> str:
    return f"""with {BANDS}, n as (select *, case image % 4 when 0 then 8 when 1 then 4 when 2 then 3 else 1 end as nb from bands),
k as (select * from n where band <= nb), m(nb, src, dst) as (values {profile})
select image, dst::int as band, r, c, v from k join m on k.nb = m.nb and k.band = m.src"""


_SMALL = "(3,1,1),(3,2,2),(3,3,3),(4,1,1),(4,2,2),(4,3,3),(1,1,1),(1,1,2),(1,1,3)"


def _mixed_bands(spark, sf):
    n = F.element_at(F.array(*map(F.lit, (8, 4, 3, 1))), (F.col("image") % 4 + 1).cast("int"))
    return I.bands(spark, sf).withColumn("n_bands", n).where(F.col("band") <= F.col("n_bands"))


@query("rgb_band_select", _rgb_sql(_SMALL + ",(8,4,1),(8,2,2),(8,1,3)"))
def rgb_band_select(spark, sf):
    return T.select_rgb(_mixed_bands(spark, sf)).select("image", "band", "r", "c", "v")


@query("rgb_band_select_named", _rgb_sql(_SMALL + ",(8,5,1),(8,3,2),(8,2,3)"))
def rgb_band_select_named(spark, sf):
    return T.select_rgb(_mixed_bands(spark, sf), profile="wv_named").select("image", "band", "r", "c", "v")


@query("minmax_preview", f"""with {RAW} select image, r, c, round((v - min(v) over (partition by image)) /
 (max(v) over (partition by image) - min(v) over (partition by image)), 6) as v from raw""")
def minmax_preview(spark, sf):
    return augment.preview(I.raw_pixels(spark, sf)).select("image", "r", "c", F.round("v", 6).alias("v"))


@query("byte_preview", f"with {PIXELS} select image, r, c, round(v / 255, 6) as v from px")
def byte_preview(spark, sf):
    return augment.preview(I.pixels(spark, sf), floating=False).withColumn("v", F.round("v", 6))


@query("stack_bands", f"""with {TRUTH_PRED} select image, r, c, g as v, 1 as band from tp union all
 select image, r, c, p, 2 from tp""")
def stack_bands(spark, sf):
    tp = I.truth_pred(spark, sf)
    return T.stack_bands(tp.select("image", "r", "c", F.col("g").alias("v")), tp.select("image", "r", "c", F.col("p").alias("v")))


@query("class_remap", f"""with {TRUTH_PRED} select image, r, c, (case when p > 0 then 2 when g > 0 then 1 else 0 end)::int as cls from tp""")
def class_remap(spark, sf):
    return I.truth_pred(spark, sf).select("image", "r", "c", P.class_code(F.col("g"), F.col("p")).alias("cls"))


@query("value_map", f"""with {PIXELS} select image, r, c, ((v + r) % 4)::int as cls from px""")
def value_map(spark, sf):
    """Mask codes 0, 85, 170 and 255 to classes by a table."""
    code = ((F.col("v") + F.col("r")) % 4) * 85
    return I.pixels(spark, sf).select("image", "r", "c", P.mapped(code, {0: 0, 85: 1, 170: 2, 255: 3}).alias("cls"))


@query("edge_carve", f"""with {TRUTH_PRED} select image, r, c, (case when p = 1 then 0 else g * 255 end)::int as building from tp""")
def edge_carve(spark, sf):
    return I.truth_pred(spark, sf).select("image", "r", "c", P.carve_edges(F.col("g") * 255, F.col("p") * 255).alias("building"))


@query("edge_suppress", f"""with {PIXELS} select image, r, c, (case when (v % 10) / 10.0 > 0.5 then 0 else v / 255 end > 0.1)::int as keep from px""")
def edge_suppress(spark, sf):
    p = P.suppress_edges(F.col("v") / 255, (F.col("v") % 10) / 10.0, 0.5)
    return I.pixels(spark, sf).select("image", "r", "c", (p > 0.1).cast("int").alias("keep"))


# --- tiles ------------------------------------------------------------------

@query("tile_index", f"""with {PIXELS} select image, (r // 50)::int as tile_r, (c // 50)::int as tile_c,
 image || '_r' || (r // 50) || '_c' || (c // 50) || '.TIF' as name, count(*) as n, sum(v)::bigint as total
 from px where r < 100 and c < 100 group by all""")
def tile_index(spark, sf):
    from ..functions.names import tile_name
    cut = T.cut(I.pixels(spark, sf), image_sizes(spark, sf), 50)
    return (cut.groupBy("image", "tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
            .select("image", "tile_r", "tile_c", tile_name(F.col("image"), F.col("tile_r"), F.col("tile_c")).alias("name"), "n", "total"))


@query("tile_pack", f"""with {PIXELS} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c, count(*) as n_values,
 md5(string_agg(v::varchar, ',' order by r, c)) as digest from px group by all""")
def tile_pack(spark, sf):
    tiles = T.pack(T.cut(I.pixels(spark, sf), image_sizes(spark, sf), TILE), TILE)
    text = F.concat_ws(",", F.transform("data", lambda v: v.cast("string")))
    return tiles.select("image", "tile_r", "tile_c", F.size("data").cast("long").alias("n_values"), F.md5(text).alias("digest"))


@query("ingested_tiles", f"""with {PIXELS} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c, count(*) as n_values,
 md5(string_agg(v::varchar, ',' order by r, c)) as digest from px group by all""")
def ingested_tiles(spark, sf):
    """Tiles stored from three batches whose borders cut through images and tiles; the first one ran twice."""
    from ..session import new_folder
    from ..sources import sinks
    out = new_folder(spark, "tiles")
    tiled = T.cut(I.pixels(spark, sf), image_sizes(spark, sf), TILE)
    part = F.pmod(F.xxhash64("image", "r", "c"), F.lit(3))
    for k in (0, 1, 2, 0):
        sinks.write_tile_parts(tiled.where(part == k), out, TILE, k)
    text = F.concat_ws(",", F.transform("data", lambda v: v.cast("string")))
    return sinks.stored_tiles(spark, out, TILE).select("image", "tile_r", "tile_c", F.size("data").cast("long").alias("n_values"), F.md5(text).alias("digest"))


@query("tile_roundtrip", f"with {PIXELS} select image, r, c, v from px")
def tile_roundtrip(spark, sf):
    tiles = T.pack(T.cut(I.pixels(spark, sf), image_sizes(spark, sf), TILE), TILE)
    return T.unpack(tiles, TILE)


@query("tile_completeness", f"""with {FRAME}, t as (select distinct image, r // 32 as tr, c // 32 as tc from fr
 where not (r // 32 = c // 32 and image % 2 = 1))
select image, 16::bigint as n_expected, count(*) as n_found, count(*) = 16 as complete from t group by image""")
def tile_completeness(spark, sf):
    return T.completeness(_stored_predictions(spark, sf), image_sizes(spark, sf), TILE)


@query("tile_georeference", f"""with {FRAME}, t as (select distinct image, r // 32 as tr, c // 32 as tc from fr)
select image, tr::int as tile_r, tc::int as tile_c, 'EPSG:32636' as crs, 500000.0::double + 1000 * image + 16 * tc as xmin,
 7000000.0::double - 16 * (tr + 1) as ymin, 500000.0::double + 1000 * image + 16 * (tc + 1) as xmax, 7000000.0::double - 16 * tr as ymax from t""")
def tile_georeference(spark, sf):
    tiles = _tile_cols(I.pixels(spark, sf)).select("image", "tile_r", "tile_c").distinct()
    return T.georeference(tiles, image_sizes(spark, sf), TILE).drop("t")


@query("raster_bounds", f"""with im as (select distinct s_suppkey // 25 as image from supplier) select image,
 500000.0::double + 1000 * image as xmin, 7000000.0::double - 64 as ymin, 500000.0::double + 1000 * image + 64 as xmax, 7000000.0::double as ymax from im""")
def raster_bounds(spark, sf):
    return M.raster_bounds(image_sizes(spark, sf)).select("image", "xmin", "ymin", "xmax", "ymax")


@query("mosaic_first_wins", f"""with {PIXELS}, w as (select image, image * 100 + c as gc, r as gr, v from px)
select gr::bigint as r, gc::bigint as c, min_by(v, image) as v from w group by gr, gc""")
def mosaic_first_wins(spark, sf):
    """Images laid 100 pixels apart overlap by 28 columns."""
    t = P.affine(0.5, 0, 50 * F.col("image"), 0, -0.5, 0)
    return T.mosaic(I.pixels(spark, sf).withColumn("t", t), "image").select("r", "c", "v")


@query("world_to_pixel", f"""with {FRAME} select image, r, c, trunc((0.5 * c + 0.3) / 0.5 + 0.0)::int as px, trunc((0.5 * r + 0.2) / 0.5)::int as py
 from fr""")
def world_to_pixel(spark, sf):
    fr = I.frame(I.images(spark, sf), I.SIDE, I.SIDE).join(image_sizes(spark, sf).select("image", "t"), "image")
    x, y = P.to_world(F.col("c"), F.col("r"), F.col("t"))
    px, py = P.to_pixel(x + 0.3, y - 0.2, F.col("t"))
    return fr.select("image", "r", "c", px.cast("int").alias("px"), py.cast("int").alias("py"))


# --- stencils ---------------------------------------------------------------

def _window_sql(agg: str, src: str = "px", view: str = PIXELS) -> str:
    w = "rows between 1 preceding and 1 following"
    return f"""with {view}, h as (select image, r, c, {agg}(v) over (partition by image, r order by c {w}) as v from {src})
select image, r, c, {agg}(v) over (partition by image, c order by r {w}) as v from h"""


@query("erode3", _window_sql("min"))
def erode3(spark, sf):
    return S.erode(I.pixels(spark, sf))


@query("dilate3", _window_sql("max"))
def dilate3(spark, sf):
    return S.dilate(I.pixels(spark, sf))


@query("dilate3_scatter", _window_sql("max"))
def dilate3_scatter(spark, sf):
    return S.scatter(I.pixels(spark, sf), "v", S.square(3), "max")


# offsets (row, half width) of the elliptical elements
_K3, _K5 = "(-1,0),(0,1),(1,0)", "(-2,0),(-1,2),(0,2),(1,2),(2,0)"


def _ellipse_sql(steps: list[tuple[str, str]]) -> str:
    """Chain of scatter aggregates over an offset list."""
    ctes, prev = [], "px"
    for i, (agg, k) in enumerate(steps):
        off = f"select dr, dx from (values {k}) o(dr, w), (select unnest(range(-2, 3)) as dx) d where abs(dx) <= w"
        ctes.append(f"""s{i} as (select a.image, a.r + o.dr as r, a.c + o.dx as c, {agg}(a.v) as v from {prev} a, ({off}) o
 where a.r + o.dr between 0 and 127 and a.c + o.dx between 0 and 127 group by 1, 2, 3)""")
        prev = f"s{i}"
    return f"with {PIXELS}, {', '.join(ctes)} select image, r::int as r, c::int as c, v from {prev}"


@query("open5", _ellipse_sql([("min", _K5), ("max", _K5)]))
def open5(spark, sf):
    return S.opening(I.pixels(spark, sf), element=S.ellipse(5), tasks=I.pixel_tasks(spark, sf))


@query("close3", _ellipse_sql([("max", _K3), ("min", _K3)]))
def close3(spark, sf):
    return S.closing(I.pixels(spark, sf), element=S.ellipse(3), tasks=I.pixel_tasks(spark, sf))


@query("open_close_dilate", _ellipse_sql([("min", _K3), ("max", _K3), ("max", _K3), ("min", _K3), ("max", _K3)]))
def open_close_dilate(spark, sf):
    k = S.ellipse(3)
    return S.morphology(I.pixels(spark, sf), "v", [("min", k), ("max", k), ("max", k), ("min", k), ("max", k)], tasks=I.pixel_tasks(spark, sf))


_NINE = """o as (select * from (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc)),
t as (select image, r, c, greatest(0, least(127, r + o.dr)) as nr, greatest(0, least(127, c + o.dc)) as nc from px, o),
n as (select t.image, t.r, t.c, b.v from t join px b on b.image = t.image and b.r = t.nr and b.c = t.nc)"""


@query("median3", f"with {PIXELS}, {_NINE} select image, r, c, median(v)::int as v from n group by 1, 2, 3")
def median3(spark, sf):
    return S.median3(I.pixels(spark, sf), tasks=I.pixel_tasks(spark, sf))


@query("label_vote3", f"""with {PIXELS.replace("px as", "p0 as")}, px as (select image, r, c, (v + r // 3 + c // 3) % 3 as v from p0), {_NINE},
m as (select image, r, c, v, count(*) as k from n group by 1, 2, 3, 4)
select image, r, c, max(case when k >= 5 then v else 0 end)::int as v from m group by 1, 2, 3""")
def label_vote3(spark, sf):
    px = I.pixels(spark, sf).withColumn("v", ((F.col("v") + F.floor(F.col("r") / 3) + F.floor(F.col("c") / 3)) % 3).cast("int"))
    return S.majority3(px, tasks=I.pixel_tasks(spark, sf))


def _gauss_sql() -> str:
    k = S.gauss_kernel(0.5)
    w = ",".join(f"({d},{k[abs(d)]!r}::double)" for d in range(-2, 3))
    mirror = lambda x: f"case when {x} < 0 then -{x} - 1 when {x} > 127 then 255 - {x} else {x} end"
    return f"""with {TRUTH_PRED}, k(d, w) as (values {w}),
h as (select a.image, a.r, a.c, sum(b.g * k.w) as v from tp a, k, tp b where b.image = a.image and b.r = a.r
      and b.c = {mirror('(a.c + k.d)')} group by 1, 2, 3),
w as (select a.image, a.r, a.c, sum(b.v * k.w) as v from h a, k, h b where b.image = a.image and b.c = a.c
      and b.r = {mirror('(a.r + k.d)')} group by 1, 2, 3)
select image, r, c, round(v / max(v) over (partition by image), 6) as v from w"""


@query("gauss_weights", _gauss_sql())
def gauss_weights(spark, sf):
    g = I.truth_pred(spark, sf).select("image", "r", "c", F.col("g").cast("double").alias("v"))
    return burn.distance_weights(g, tasks=I.pixel_tasks(spark, sf)).select("image", "r", "c", F.round("v", 6).alias("v"))


# --- resampling and augmentation --------------------------------------------

@query("affine_resample", f"""with {PIXELS}, t as (select image, r, c, floor((c + 0.5) * 0.75 + 3.25)::int as sc, floor((r + 0.5) * 1.5 - 10.0)::int as sr from fr)
select t.image, t.r, t.c, p.v from t left join px p on p.image = t.image and p.r = t.sr and p.c = t.sc""")
def affine_resample(spark, sf):
    px, im = I.pixels(spark, sf), I.images(spark, sf)
    source = im.select("image", P.affine(1, 0, 0, 0, -1, 0).alias("t"))
    target = im.select("image", P.affine(0.75, 0, 3.25, 0, -1.5, 10).alias("t"))
    return resample.resample(px, source, I.frame(im, I.SIDE, I.SIDE), target, source_crs="plane", target_crs="plane")


@query("brovey", f"""with {BANDS}, ms as materialized (select image, band, r // 4 as pr, c // 4 as pc, sum(v) as v from bands where band <= 4 group by all),
av as materialized (select image, pr, pc, avg(v) as m, list({{'band': band, 'v': v}}) as vs from ms group by all),
pk as materialized (select image, r, c, v, r // 4 as pr, c // 4 as pc from px),
j as materialized (select image, r, c, pk.v as pan, m, unnest(vs) as one from pk join av using (image, pr, pc))
select image, one.band as band, r, c, round(case when m = 0 then null else one.v * pan / m end, 6) as v from j""")
def brovey(spark, sf):
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int").alias(n)
    ms = I.bands(spark, sf, 4).groupBy("image", "band", quarter("r"), quarter("c")).agg(F.sum("v").alias("v"))
    return resample.brovey(ms, I.pixels(spark, sf), 4, 4).withColumn("v", F.round("v", 6))


@query("flip_tiles", f"""with {PIXELS} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c, (31 - r % 32)::int as r, (31 - c % 32)::int as c, v from px""")
def flip_tiles(spark, sf):
    t = _tile_cols(I.pixels(spark, sf)).withColumn("r", (F.col("r") % TILE).cast("int")).withColumn("c", (F.col("c") % TILE).cast("int"))
    return augment.flip(t, TILE, True, True).select("image", "tile_r", "tile_c", "r", "c", "v")


@query("normalize_channels", f"""with {BANDS}, s as (select band, avg(v) as m, stddev_pop(v) as d from bands group by band)
select image, band, r, c, round((v - m) / d, 6) as v from bands join s using (band)""")
def normalize_channels(spark, sf):
    return augment.normalize(I.bands(spark, sf)).select("image", "band", "r", "c", F.round("v", 6).alias("v"))


@query("random_erase", f"""with {PIXELS}, k as (select *, r // 32 as tr, c // 32 as tc, r % 32 as pr, c % 32 as pc from px),
u as (select *, md5('7:p:' || image || ':' || tr || ':' || tc) as hp, md5('7:side:' || image || ':' || tr || ':' || tc) as hs,
 md5('7:r0:' || image || ':' || tr || ':' || tc) as hr, md5('7:c0:' || image || ':' || tr || ':' || tc) as hc from k),
d as (select *, ('0x' || hp[1:12])::bigint / 281474976710656.0::double as up, floor(('0x' || hs[1:12])::bigint / 281474976710656.0::double * 9.6) + 1 as side,
 floor(('0x' || hr[1:12])::bigint / 281474976710656.0::double * 32) as r0, floor(('0x' || hc[1:12])::bigint / 281474976710656.0::double * 32) as c0 from u)
select image, tr::int as tile_r, tc::int as tile_c, pr::int as r, pc::int as c,
 case when up < 0.5 and pr >= r0 and pr < r0 + side and pc >= c0 and pc < c0 + side then 0.0 else v end::double as v from d""")
def random_erase(spark, sf):
    t = _tile_cols(I.pixels(spark, sf)).withColumn("r", (F.col("r") % TILE).cast("int")).withColumn("c", (F.col("c") % TILE).cast("int"))
    return augment.erase(t, TILE, 7, ("image", "tile_r", "tile_c")).select(
        "image", "tile_r", "tile_c", "r", "c", F.col("v").cast("double").alias("v"))


def _unit_sql(salt: str) -> str:
    return f"('0x' || substr(md5('7:{salt}:' || image || ':' || tr || ':' || tc), 1, 12))::bigint / 281474976710656.0::double"


_TILED = f"""{PIXELS}, tl as (select image, (r // 32)::int as tr, (c // 32)::int as tc, (r % 32)::int as r, (c % 32)::int as c, v from px)"""


@query("rotate_zoom", f"""with {_TILED}, k as (select distinct image, tr, tc, radians({_unit_sql('rot')} * 80 - 40) as a, {_unit_sql('zoom')} * (1.6 - 0.9) + 0.9 as z,
 {_unit_sql('warp')} * 0.2 - 0.1 as s from tl),
d as (select tl.image, tl.tr, tl.tc, r, c, (c - 15.5) / z as dx, (r - 15.5) / z as dy, a, s from tl join k using (image, tr, tc)),
t as (select image, tr, tc, r, c, round(-sin(a) * dx + cos(a) * dy + 15.5)::int as sr, round(cos(a) * dx + sin(a) * dy + s * dy + 15.5)::int as sc from d)
select t.image, t.tr as tile_r, t.tc as tile_c, t.r, t.c, tl.v from t left join tl on tl.image = t.image and tl.tr = t.tr and tl.tc = t.tc and tl.r = t.sr and tl.c = t.sc""")
def rotate_zoom(spark, sf):
    t = _tile_cols(I.pixels(spark, sf)).withColumn("r", (F.col("r") % TILE).cast("int")).withColumn("c", (F.col("c") % TILE).cast("int"))
    return augment.rotate_zoom(t, TILE, 7, ("image", "tile_r", "tile_c"))


@query("colour_jitter", f"""with {_TILED.replace('(r % 32)::int as r, (c % 32)::int as c', 'r, c')}, k as (select distinct image, tr, tc, 1 + ({_unit_sql('b')} * 2 - 1) * 0.2 as bright,
 1 + ({_unit_sql('c')} * 2 - 1) * 0.2 as contrast, 1 + ({_unit_sql('s')} * 2 - 1) * 0.2 as sat, ({_unit_sql('hue')} * 2 - 1) * 0.2 as hue from tl),
x as (select *, v / 255 as x, v / 255 * 0.8::double as y, 1 - v / 255 as w from tl join k using (image, tr, tc)),
m as (select *, (x + y + w) / 3 as g, x + hue * (y - w) as mr, y + hue * (w - x) as mg, w + hue * (x - y) as mb from x)
select image, tr as tile_r, tc as tile_c, r, c, round(least(greatest((g + (mr - g) * sat - 0.5) * contrast + 0.5 + (bright - 1), 0), 1), 6) as red,
 round(least(greatest((g + (mg - g) * sat - 0.5) * contrast + 0.5 + (bright - 1), 0), 1), 6) as green,
 round(least(greatest((g + (mb - g) * sat - 0.5) * contrast + 0.5 + (bright - 1), 0), 1), 6) as blue from m""")
def colour_jitter(spark, sf):
    px = _tile_cols(I.pixels(spark, sf))
    v = F.col("v") / 255
    rgb = px.select("image", "tile_r", "tile_c", "r", "c", v.alias("red"), (v * 0.8).alias("green"), (1 - v).alias("blue"))
    out = augment.jitter(rgb, 7, ("image", "tile_r", "tile_c"))
    return out.select("image", "tile_r", "tile_c", "r", "c", *(F.round(n, 6).alias(n) for n in ("red", "green", "blue")))
