"""Queries over files, tasks, class scores, samples and arrivals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import SegmentationParams, TilingParams
from ..functions import geometry as G, names as N, pixel as P
from ..operators import blocks as BL, burn, losses as L, metrics as M, pairing, sampling, score, spatial_join as SJ, tiling as T
from ..session import new_folder
from ..sources import labels as LB, registry, sinks, tasks as TK
from ..streaming import streams as ST
from . import inputs as I, jobs
from .catalog import query
from .pixel_queries import TILE, image_sizes
from .vector_queries import CELL, _TILES, _components_sql, _boxes, _tile_boxes
from .views_sql import AOIS, ARRIVALS, BUILDINGS, MASK, METRIC_SUMS, PIXELS, PROBS, SCENES, TASKS, TRUTH_PRED, metric_ratios

# --- class scores and losses ------------------------------------------------


_PRED = "(list_position(p, list_max(p)) - 1)::int as pred"


@query("softmax_argmax", f"""with {PROBS} select vec_id, {", ".join(f"round(p[{k + 1}], 6) as p{k}" for k in range(I.CLASSES))}, {_PRED} from pr""")
def softmax_argmax(spark, sf):
    p = L.with_probs(I.probs(spark, sf))
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(I.CLASSES)], P.argmax(F.col("p")).alias("pred"))


def _loss(df):
    return df.select(F.round("loss", 6).alias("loss"))


_DICE = """dc as (select tile, k, 1 - (2 * sum(case when label = k then pk else 0 end) + 1) / (sum(pk + (label = k)::int) + 1) as loss
 from (select tile, label, unnest(range(0, 10)) as k, unnest(p) as pk from pl) group by tile, k)"""


@query("ce_loss", f"with {PROBS} select round(avg(-ln(pt)), 6) as loss from pl")
def ce_loss(spark, sf):
    return _loss(L.cross_entropy(I.probs(spark, sf)))


@query("class_weighted_ce", f"""with {PROBS}, w as (select pt, (0.5 + label * 0.25)::double as k from pl)
select round(sum(-ln(pt) * k) / sum(k), 6) as loss from w""")
def class_weighted_ce(spark, sf):
    return _loss(L.cross_entropy(I.probs(spark, sf), [0.5 + k * 0.25 for k in range(I.CLASSES)]))


@query("dice_loss", f"with {PROBS}, {_DICE} select round(sum(loss), 6) as loss from dc")
def dice_loss(spark, sf):
    return _loss(L.dice(I.probs(spark, sf), I.CLASSES))


@query("dice_loss_by_tile", f"with {PROBS}, {_DICE} select tile, k::int as cls, round(loss, 6) as loss from dc")
def dice_loss_by_tile(spark, sf):
    return L.dice_terms(I.probs(spark, sf), I.CLASSES).withColumn("loss", F.round("loss", 6))


@query("focal_loss", f"with {PROBS} select round(avg(-(1 - pt) * (1 - pt) * ln(pt)), 6) as loss from pl")
def focal_loss(spark, sf):
    return _loss(L.focal(I.probs(spark, sf)))


@query("focal_dice_loss", f"with {PROBS}, {_DICE} select round((select avg(-(1 - pt) * (1 - pt) * ln(pt)) from pl) + 0.5 * (select sum(loss) from dc), 6) as loss")
def focal_dice_loss(spark, sf):
    return _loss(L.focal_dice(I.probs(spark, sf), alpha=0.5, n_classes=I.CLASSES))


@query("ce_dice_loss", f"with {PROBS}, {_DICE} select round((select avg(-ln(pt)) from pl) + (select avg(loss) from dc), 6) as loss")
def ce_dice_loss(spark, sf):
    return _loss(L.cross_entropy_dice(I.probs(spark, sf), reduction="mean", n_classes=I.CLASSES))


@query("weighted_ce", f"with {PROBS} select round(avg(-ln(pt) * w), 6) as loss from pl")
def weighted_ce(spark, sf):
    return _loss(L.weighted_cross_entropy(I.probs(spark, sf)))


@query("weighted_ce_dice", f"with {PROBS}, {_DICE} select round((select avg(-ln(pt) * w) from pl) + (select sum(loss) from dc), 6) as loss")
def weighted_ce_dice(spark, sf):
    return _loss(L.weighted_cross_entropy_dice(I.probs(spark, sf), n_classes=I.CLASSES))


@query("dual_focal_loss", f"""with {PROBS}, t as (select list_transform(range(0, 10), lambda k: p[k + 1] - (label = k)::int) as g from pl where vec_id % 10 <> 0)
select round(avg(list_sum(list_transform(g, lambda x: -ln(1e-5 + 1 - x * x)))), 6) as loss from t""")
def dual_focal_loss(spark, sf):
    z = I.probs(spark, sf).withColumn("label", F.when(F.col("vec_id") % 10 == 0, L.IGNORE).otherwise(F.col("label")))
    return _loss(L.dual_focal(z))


@query("score_confusion", f"""with {PROBS}, c as (select label, {_PRED} from pr) select label, pred, count(*) as n from c group by all""")
def score_confusion(spark, sf):
    p = L.with_probs(I.probs(spark, sf)).select("label", P.argmax(F.col("p")).alias("pred"))
    return M.confusion(p)


# --- samples and splits -----------------------------------------------------

def _named_tiles(spark, sf):
    t = _tile_boxes(spark, sf)
    return t.withColumn("name", N.tile_name(F.col("scene"), F.col("tile_r"), F.col("tile_c")))


@query("sample_tiles", f"""with {AOIS}, {_TILES}, t as (select scene, tr, tc, scene || '_r' || tr || '_c' || tc || '.TIF' as name from tl where exists (select 1 from aoi a
 where a.scene = tl.scene and a.x0 <= tc * 64 + 64 and a.x1 >= tc * 64 and a.y0 <= tr * 64 + 64 and a.y1 >= tr * 64))
select name from t order by md5('2022:' || name), name limit 20""")
def sample_tiles(spark, sf):
    return jobs.labeling_sample(_named_tiles(spark, sf), _boxes(I.aois(spark, sf)), 20, CELL, keys=("scene",)).select("name")


_SPLIT = """sp as (select *, row_number() over (order by md5('2022:' || doc_id), doc_id) <= ceil(0.2 * count(*) over ()) as is_test from documents)"""


@query("train_test_split", f"with {_SPLIT} select doc_id, is_test from sp")
def train_test_split(spark, sf):
    return sampling.split(I.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("split_balance", f"with {_SPLIT} select source, is_test, count(*) as n, sum(n_chars)::bigint as chars from sp group by all")
def split_balance(spark, sf):
    d = sampling.split(I.table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return d.groupBy("source", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("train_valid_test", f"""with {_SPLIT}, v as (select doc_id, is_test, row_number() over (partition by is_test order by md5('2023:' || doc_id), doc_id)
 <= ceil(0.25 * count(*) over (partition by is_test)) as first from sp)
select case when is_test then 'test' when first then 'valid' else 'train' end as part, count(*) as n, sum(doc_id)::bigint as ids from v group by all""")
def train_valid_test(spark, sf):
    d = sampling.train_valid_test(I.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2, 0.25)
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("threshold_split", """select source, ('0x' || md5('2022:' || doc_id)[1:12])::bigint / 281474976710656.0::double < 0.2 as is_test, count(*) as n
 from documents group by all""")
def threshold_split(spark, sf):
    d = sampling.split_by_threshold(I.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("source", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("first_tiles", f"""with {_TILES} select 't' || (tr * 16 + tc) || '_' || scene || '.png' as name from tl
 order by scene, 't' || (tr * 16 + tc) || '_' || scene || '.png' limit 30""")
def first_tiles(spark, sf):
    """First files of a listing in natural order (scene number, then name)."""
    n = _named_tiles(spark, sf).select(F.format_string("t%d_%d.png", "tile", "scene").alias("name"))
    return sampling.first_n(n, T.natural_order(F.col("name")), 30)


# --- files and names --------------------------------------------------------

_PAIRS = f"""{SCENES}, ms as (select distinct name, path from sc where path like '%M3DS%'),
pn as (select name, min(path) as pan_path from sc where name like '%P3DS%' group by name),
pp as (select ms.name, ms.path as ms_path, pan_path, replace(ms.name, 'M3DS', 'PS3DS') as out_name from ms join pn on pn.name = replace(ms.name, 'M3DS', 'P3DS'))"""


@query("multispectral_files", f"with {SCENES} select distinct path, name, done from sc where path like '%M3DS%'")
def multispectral_files(spark, sf):
    return pairing.multispectral(I.scenes(spark, sf).unionByName(I.scenes(spark, sf)))


@query("pan_pairs", f"with {_PAIRS} select name, ms_path, pan_path, out_name from pp")
def pan_pairs(spark, sf):
    s = I.scenes(spark, sf)
    return pairing.pan_pairs(s.where(F.col("name").contains("M3DS")), s.where(F.col("name").contains("P3DS")))


@query("pan_todo", f"""with {_PAIRS} select name, ms_path, pan_path, out_name from pp where out_name not in
 (select replace(name, 'M3DS', 'PS3DS') from sc where done = 1 and name like '%M3DS%')""")
def pan_todo(spark, sf):
    s = I.scenes(spark, sf)
    done = s.where((F.col("done") == 1) & F.col("name").contains("M3DS")).select(N.sharpened_name(F.col("name")).alias("out_name"))
    return jobs.pansharpen_plan(s, done)


@query("missing_pairs", f"""with {SCENES}, l as (select distinct replace(name, 'M3DS', 'X') as k from sc where name like '%M3DS%'),
r as (select distinct replace(name, 'P3DS', 'X') as k from sc where name like '%P3DS%')
select coalesce(l.k, r.k) as k, l.k is not null as in_left, r.k is not null as in_right from l full join r on l.k = r.k""")
def missing_pairs(spark, sf):
    s = I.scenes(spark, sf)
    key = lambda tag: s.where(F.col("name").contains(tag)).select(F.replace("name", F.lit(tag), F.lit("X")).alias("k"))
    return pairing.completeness(key("M3DS"), key("P3DS"), ["k"])


@query("copy_once", f"""with {SCENES} select substr(path, 8) as rel_path from sc where done = 0""")
def copy_once(spark, sf):
    s = I.scenes(spark, sf).withColumn("rel_path", F.regexp_replace("path", "^scenes/", ""))
    return pairing.copy_once(s, s.where("done = 1")).select("rel_path")


@query("exclude_names", f"with {SCENES} select name, path from sc where name not like '%P3DS%' and name not like '%1-%'")
def exclude_names(spark, sf):
    return pairing.exclude(I.scenes(spark, sf), "P3DS", "1-").select("name", "path")


@query("rename_open_files", f"""with {SCENES}, r as (select name, 'open_' || regexp_extract(name, '^S(\\d+)-', 1) || '.tif' as new_name, done from sc where name like '%M3DS%')
select name, new_name from r where new_name not in (select new_name from r where done = 1)""")
def rename_open_files(spark, sf):
    from ..sources.manifest import renamed
    r = renamed(I.scenes(spark, sf).where(F.col("name").contains("M3DS")), r"^S(\d+)-.*$", "open_$1.tif")
    return pairing.missing(r, r.where("done = 1"), ["new_name"]).select("name", "new_name")


@query("name_parts", f"""with {SCENES} select path, regexp_extract(path, '([^/]+)$', 1) as base, regexp_replace(name, '\\.TIF$', '') as stem, '.tif' as suffix,
 replace(path, 'scenes', 'masks') as mask_path, regexp_extract(c, '([^_]+)$', 1) as code from (select *, 'AOI_2_' || split_part(path, '/', 2) as c from sc)""")
def name_parts(spark, sf):
    p = F.col("path")
    folder = F.concat(F.lit("AOI_2_"), F.split(p, "/")[1])
    return I.scenes(spark, sf).select("path", N.base_name(p).alias("base"), N.stem(p).alias("stem"), N.suffix(p).alias("suffix"),
                                      N.mask_path(F.replace(p, F.lit("scenes"), F.lit("images"))).alias("mask_path"),
                                      N.folder_code(folder).alias("code"))


@query("surface_pairs", f"""with {SCENES}, k as (select name, regexp_replace(name, '\\.TIF$', '') as stem, done from sc)
select stem, split_part(stem, '_', -2) || '_' || split_part(stem, '_', -1) || '_elev.tif' as surface_name,
 case when exists (select 1 from k d where d.done = 1 and d.stem = k.stem) then 'dsm/' || stem end as surface_path from k""")
def surface_pairs(spark, sf):
    im = I.scenes(spark, sf).select(N.stem(F.col("name")).alias("stem"), "done")
    surf = im.where("done = 1").select(N.surface_key(F.col("stem")).alias("name"), F.concat(F.lit("dsm/"), "stem").alias("path"))
    return pairing.with_surface(im.drop("done"), surf).select("stem", "surface_name", "surface_path")


@query("required_masks", f"""with {SCENES} select name, 'masks/' || name as mask from sc""")
def required_masks(spark, sf):
    s = I.scenes(spark, sf)
    return pairing.required(s.select("name"), s.select("name", F.concat(F.lit("masks/"), "name").alias("mask")), ["name"], "mask")


@query("polygon_images", f"""with {SCENES} select replace(name, '.TIF', '_predicted.shp') as file, name, path from sc where done = 1""")
def polygon_images(spark, sf):
    s = I.scenes(spark, sf)
    files = s.where("done = 1").select(F.replace("name", F.lit(".TIF"), F.lit("_predicted.shp")).alias("file"))
    return pairing.polygon_images(files, s.select("name", "path"))


@query("predictions_todo", f"with {SCENES} select name from sc where done = 0")
def predictions_todo(spark, sf):
    s = I.scenes(spark, sf)
    return sinks.not_yet_predicted(s.select("name"), s.where("done = 1"), "name")


@query("labelled_images", f"""with {TASKS}, im as (select 'img-' || k || '.TIF' as image_name, k from (select unnest(range(0, 4)) as k)), used as (select distinct image_name from tk where id % 4 <> 3)
select image_name from im where image_name in (select image_name from used)""")
def labelled_images(spark, sf):
    polys = TK.task_polygons(TK.parse_tasks(I.tasks(spark, sf))).where("id % 4 <> 3")
    return pairing.present(I.task_images(spark, sf), polys, ["image_name"]).select("image_name")


@query("missing_task_images", f"with {TASKS} select id, image_name from tk where k = 3")
def missing_task_images(spark, sf):
    t = TK.parse_tasks(I.tasks(spark, sf))
    return jobs.labels_from_tasks(t, I.task_images(spark, sf).where("image_name <> 'img-3.TIF'"))[1]


@query("model_resolution", """with reg as (select distinct 'v' || s_nationkey as version, min(s_name) over (partition by s_nationkey) as file from supplier),
rq as (select distinct c_custkey as request, 'v' || c_nationkey as version from customer)
select request, case when reg.file is not null then rq.version when (select count(distinct version) from reg) = 1 then (select min(version) from reg) end as resolved
from rq left join reg on reg.version = rq.version""")
def model_resolution(spark, sf):
    s = I.table(spark, sf, "supplier").groupBy(F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("version")) \
        .agg(F.min("s_name").alias("file"))
    rq = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("request"),
                                               F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("version"))
    return registry.resolve_all(s, rq)


@query("run_stamps", """select event_id, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y%m%d-%H%M') as stamp from events""")
def run_stamps(spark, sf):
    return I.table(spark, sf, "events").select("event_id", N.run_stamp(F.col("ts")).alias("stamp"))


# --- labels and tasks -------------------------------------------------------

_TASK_XY = """round(500000 + 1000 * k + 0.5 * 5.12 * px0, 6) as xmin, round(500000 + 1000 * k + 0.5 * 5.12 * (px0 + pw), 6) as xmax,
 round(7000000 - 0.5 * 5.12 * (py0 + pw), 6) as ymin, round(7000000 - 0.5 * 5.12 * py0, 6) as ymax"""


@query("labels_from_tasks", f"with {TASKS} select id, image_name, label, {_TASK_XY}, 5 as n_points from tk")
def labels_from_tasks(spark, sf):
    polys, _ = jobs.labels_from_tasks(TK.parse_tasks(I.tasks(spark, sf)), I.task_images(spark, sf))
    b = polys.withColumn("b", G.bounds(F.col("ring")))
    return b.select("id", "image_name", "label", *[F.round(f"b.{n}", 6).alias(n) for n in ("xmin", "xmax", "ymin", "ymax")],
                    F.size("ring").alias("n_points"))


@query("predictions_json", f"""with {TASKS} select image_name as image, count(*) as n_polygons, (count(*) * 5) as n_points,
 round(sum(100.0::double * trunc(5.12 * px0) / 512), 4) as sum_x, round(sum(100.0::double * trunc(5.12 * py0) / 512), 4) as sum_y from tk group by image_name""")
def predictions_json(spark, sf):
    """Written and read back: the document of each image holds all of its polygons."""
    polys = TK.task_polygons(TK.parse_tasks(I.tasks(spark, sf))).select(
        F.col("image_name").alias("image"), F.col("id").alias("pid"), F.lit(0).alias("part"), "ring")
    path = new_folder(spark, "predictions")
    TK.write_predictions(TK.prediction_json(polys, 512, "google"), path)
    r = TK.read_predictions(spark, path)
    pts = F.col("result.value.points")
    return r.groupBy("image").agg(F.count(F.lit(1)).alias("n_polygons"), F.sum(F.size(pts).cast("long")).alias("n_points"),
                                  F.round(F.sum(pts[0][0]), 4).alias("sum_x"), F.round(F.sum(pts[0][1]), 4).alias("sum_y"))


@query("geojson_labels", f"""with {BUILDINGS} select bid, case when bid % 2 = 0 then 'Polygon' else 'MultiPolygon' end as geom_type, 0 as part,
 ((x1 - x0) * (y1 - y0))::double as area from bld""")
def geojson_labels(spark, sf):
    """Footprints written as GeoJSON features and parsed again."""
    b = _boxes(I.buildings(spark, sf))
    ring = F.transform("ring", lambda p: F.array(p.x, p.y))
    coords = F.when(F.col("bid") % 2 == 0, F.to_json(F.array(ring))).otherwise(F.to_json(F.array(F.array(ring))))
    kind = F.when(F.col("bid") % 2 == 0, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    text = F.concat(F.lit('{"features":[{"properties":{"id":"'), F.col("bid").cast("string"), F.lit('"},"geometry":{"type":"'), kind,
                    F.lit('","coordinates":'), coords, F.lit("}}]}"))
    parsed = b.select("bid", F.from_json(text, LB.GEOJSON_SCHEMA).alias("d")).select("bid", "d.features")
    return LB.geojson_features(parsed).select("bid", "geom_type", "part", G.area(F.col("ring")).alias("area"))


# --- scoring and jobs -------------------------------------------------------

def brightness_model():
    """Stand-in model: class scores from brightness, with an edge score from column steps."""
    def model(tile: np.ndarray) -> np.ndarray:
        b = np.asarray(tile, float) / 255
        edge = np.abs(np.diff(b, axis=1, prepend=b[:, :1])) * 0.1
        return np.stack([1 - b, b, edge])
    return model


def _packed(spark, sf, tile=TILE):
    return T.pack(T.cut(I.pixels(spark, sf), image_sizes(spark, sf), tile), tile)


@query("score_tiles", f"""with {PIXELS} select image, r, c, round(v / 255, 6) as building_prob from px""")
def score_tiles(spark, sf):
    p = score.probabilities(score.score_tiles(_packed(spark, sf), brightness_model, TILE), TILE)
    return p.select("image", "r", "c", F.round("building_prob", 6).alias("building_prob"))


@query("score_failures", f"""with {PIXELS} select distinct image, (r // 32)::int as tile_r, (c // 32)::int as tile_c from px where image % 2 = 1 and r // 32 = c // 32""")
def score_failures(spark, sf):
    """Tiles of the wrong size fail alone and are listed."""
    cut_short = (F.col("image") % 2 == 1) & (F.col("tile_r") == F.col("tile_c"))
    tiles = _packed(spark, sf).withColumn("data", F.when(cut_short, F.slice("data", 1, 10)).otherwise(F.col("data")))
    return score.failures(score.score_tiles(tiles, brightness_model, TILE)).select("image", "tile_r", "tile_c")


@query("stored_predictions_reused", f"""with {PIXELS} select image, (r // 32)::int as tile_r, (c // 32)::int as tile_c, (image % 2 = 0)::int as fresh from px group by all""")
def stored_predictions_reused(spark, sf):
    tiles = _packed(spark, sf)
    stored = tiles.where("image % 2 = 1").select("image", "tile_r", "tile_c", F.lit(None).cast("array<array<double>>").alias("scores"),
                                                 F.lit(None).cast("string").alias("error"))
    out = jobs.predict(tiles, brightness_model, TILE, stored=stored)
    return out.select("image", "tile_r", "tile_c", F.col("scores").isNotNull().cast("int").alias("fresh"))


_NINE = "[b, coalesce(lag(b) over x, b), coalesce(lead(b) over x, b)]"


def _morph_sql(name: str, src: str, fold: str) -> str:
    """One pass with the 3 x 3 plus."""
    x, y = "(partition by image, r order by c rows between 1 preceding and 1 following)", "(partition by image, c order by r rows between 1 preceding and 1 following)"
    pick = "least" if fold == "min" else "greatest"
    return f"{name} as (select image, r, c, {pick}({fold}(v) over {x}, {fold}(v) over {y}) as v from {src})"


@query("edge_guided_mask", f"""with recursive {PIXELS},
pe as (select image, r, c, v / 255 as b, abs(v / 255 - coalesce(lag(v / 255) over (partition by image, r, c // 32 order by c), v / 255)) * 0.1 as e from px),
ps as (select image, r, c, case when e > 0.09 then 0 else b end as b from pe),
h as (select image, r, c, {_NINE} as t from ps window x as (partition by image, r order by c)),
n9 as (select image, r, c, list_sort(list_concat(list_concat(t, coalesce(lag(t) over y, t)), coalesce(lead(t) over y, t))) as t from h window y as (partition by image, c order by r)),
m0 as (select image, r, c, (t[5] > 0.05)::int as v from n9),
fg as (select image, r, c from m0 where v = 1), {_components_sql("fg", "f")},
few as (select image, label from cpf group by all having count(*) < 8),
m1 as (select m0.image, m0.r, m0.c, case when few.label is not null then 0 else v end as v from m0 left join cpf using (image, r, c) left join few on few.image = cpf.image and few.label = cpf.label),
bg as (select image, r, c from m1 where v = 0), {_components_sql("bg", "b")},
hol as (select image, label from cpb group by all having count(*) < 4),
m2 as (select m1.image, m1.r, m1.c, case when hol.label is not null then 1 else v end as v from m1 left join cpb using (image, r, c) left join hol on hol.image = cpb.image and hol.label = cpb.label),
{_morph_sql("m3", "m2", "min")}, {_morph_sql("m4", "m3", "max")}, {_morph_sql("m5", "m4", "max")}, {_morph_sql("m6", "m5", "min")}, {_morph_sql("m7", "m6", "max")}
select image, sum(v)::bigint as n_building, count(*) as n, sum(v * (r * 131 + c))::bigint as place_sum from m7 group by image""")
def edge_guided_mask(spark, sf):
    """Tiles through the model to clean masks in packed blocks."""
    params = SegmentationParams(building_threshold=0.05, edge_threshold=0.09, min_building_size=8, max_hole_size=4, morph_kernel_size=3)
    m = BL.pixels(jobs.building_masks(_packed(spark, sf), brightness_model, TILE, params))
    return m.groupBy("image").agg(F.sum("v").alias("n_building"), F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * (F.col("r") * 131 + F.col("c"))).alias("place_sum"))


def footprint_model():
    """Stand-in model: building probability 0.9 on bright pixels and 0.05 elsewhere, no edge class."""
    def model(tile: np.ndarray) -> np.ndarray:
        b = 0.05 + 0.85 * (tile > 0)
        return np.stack([1 - b, b])
    return model


def footprint_tiles(spark, sf, tile, copies=1):
    """Whole footprint planes as packed tiles; ``copies`` repeats the planes under new numbers."""
    from .vector_queries import burnable
    runs = burn.spans(burnable(spark, sf))
    if copies > 1:
        runs = runs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("image", F.col("image") * copies + F.col("copy")).drop("copy")
    planes = runs.select("image").distinct().select("image", F.lit(I.PLANE).alias("width"), F.lit(I.PLANE).alias("height"))
    return BL.burn_tiles(runs, planes, tile)


def _building_map(spark, sf, copies=1):
    params = SegmentationParams(min_building_size=12, max_hole_size=6, morph_kernel_size=3)
    polys = jobs.map_from_images(footprint_tiles(spark, sf, 250, copies), footprint_model, 250, params, has_edge=False)
    return polys.select("image", "label", F.round("area", 3).alias("area"), "angle", (F.size("ring") - 1).alias("n_points"))


@query("building_map")
def building_map(spark, sf):
    """Tiles to regularised footprints, whole planes."""
    return _building_map(spark, sf)


def _vote_sql(name: str, src: str) -> str:
    """3 x 3 majority over the pixels that are there, absent ones stood in for."""
    beside = lambda v, at, w: f"coalesce(case when lag({at}) over {w} = {at} - 1 then lag({v}) over {w} end, {v}) + coalesce(case when lead({at}) over {w} = {at} + 1 then lead({v}) over {w} end, {v})"
    return f"""{name}h as (select image, r, c, v + {beside("v", "c", "x")} as s from {src} window x as (partition by image, r order by c)),
{name} as (select image, r, c, (s + {beside("s", "r", "y")} >= 5)::int as v from {name}h window y as (partition by image, c order by r))"""


@query("building_boxes", f"""with recursive {MASK}, pf as (select scene as image, rr.r::int as r, cc.c::int as c from (select distinct scene from bld),
 (select unnest(range(0, 1000)) as r) rr, (select unnest(range(0, 1000)) as c) cc),
p0 as (select pf.image, pf.r, pf.c, (m.image is not null)::int as v from pf left join mask m using (image, r, c)), {_vote_sql("p1", "p0")},
fg as (select image, r, c from p1 where v = 1), {_components_sql("fg", "f")}, few as (select image, label from cpf group by all having count(*) < 12),
q0 as (select p1.image, p1.r, p1.c, case when few.label is not null then 0 else v end as v from p1 left join cpf using (image, r, c) left join few on few.image = cpf.image and few.label = cpf.label),
{_morph_sql("q1", "q0", "min")}, {_morph_sql("q2", "q1", "max")}, {_morph_sql("q3", "q2", "max")}, {_morph_sql("q4", "q3", "min")}, {_morph_sql("q5", "q4", "max")},
{_vote_sql("q6", "q5")}, on_ as (select image, r, c from q6 where v = 1), {_components_sql("on_", "o")}
select image, label, min(c)::double as xmin, min(r)::double as ymin, (max(c) + 1)::double as xmax, (max(r) + 1)::double as ymax from cpo group by image, label""")
def building_boxes(spark, sf):
    """Tiles to buildings on whole planes with the outlines as traced: every building's first pixel and box."""
    params = SegmentationParams(min_building_size=12, max_hole_size=1, morph_kernel_size=3, simplify_tolerance=0, buffer_distance=0, use_mbr=False,
                                min_building_area=0, max_building_area=1e9)
    polys = jobs.map_from_images(footprint_tiles(spark, sf, 250), footprint_model, 250, params, has_edge=False)
    return SJ.with_bounds(polys).select("image", "label", "xmin", "ymin", "xmax", "ymax")


@query("building_map_large")
def building_map_large(spark, sf):
    """The same over ten copies of every plane."""
    return _building_map(spark, sf, 10)


@query("settlement_map", f"""with recursive {MASK}, {AOIS.strip()},
tl as (select scene, (k // 8)::int as tr, (k % 8)::int as tc from (select distinct scene from bld), (select unnest(range(0, 64)) as k)),
mb as (select a.scene, aoi, tr * 8 + tc as tile from aoi a join tl on tl.scene = a.scene and x0 <= (tc + 1) * 125 and x1 >= tc * 125 and y0 <= (tr + 1) * 125 and y1 >= tr * 125),
sy as (select distinct a.scene, a.aoi as u, b.aoi as v from mb a join mb b on a.scene = b.scene and a.tile = b.tile and a.aoi <> b.aoi),
w(scene, aoi, g) as (select distinct scene, aoi, aoi from mb union select sy.scene, sy.v, w.g from w join sy on sy.scene = w.scene and sy.u = w.aoi where w.g < sy.v),
gr as (select scene, aoi, min(g) as grp from w group by all),
gt as (select distinct mb.scene, mb.scene * 1000000 + grp as grp, tile from mb join gr on gr.scene = mb.scene and gr.aoi = mb.aoi),
ps as (select scene, grp, (tile // 8 * 125 + rr)::int as r, (tile % 8 * 125 + cc)::int as c from gt, (select unnest(range(0, 125)) as rr), (select unnest(range(0, 125)) as cc)),
p0 as (select grp as image, ps.r, ps.c, (m.image is not null)::int as v from ps left join mask m on m.image = ps.scene and m.r = ps.r and m.c = ps.c),
{_vote_sql("p1", "p0")},
p2 as (select image, r, c, greatest(v, case when lag(c) over x = c - 1 then lag(v) over x end, case when lead(c) over x = c + 1 then lead(v) over x end,
 case when lag(r) over y = r - 1 then lag(v) over y end, case when lead(r) over y = r + 1 then lead(v) over y end) as v from p1
 window x as (partition by image, r order by c), y as (partition by image, c order by r)),
{_vote_sql("p3", "p2")}, fg as (select image, r, c from p3 where v = 1), {_components_sql("fg", "f")},
bx as (select image, label, min(c) as c0, max(c) + 1 as c1, min(r) as r0, max(r) + 1 as r1 from cpf group by all),
hit as (select image, label, min(aoi) as aoi from cpf join aoi a on a.scene = image // 1000000 and c <= x1 and c + 1 >= x0 and r <= y1 and r + 1 >= y0 group by all)
select aoi, (image // 1000000 * 2000 + c0)::double as xmin, (-r1)::double as ymin, (image // 1000000 * 2000 + c1)::double as xmax, (-r0)::double as ymax
from bx join hit using (image, label)""")
def settlement_map(spark, sf):
    """Planes as four images of 4 x 4 tiles each, mapped on the mosaics of settlement groups; world rows run downwards."""
    side, n = 125, 4
    at = lambda c: F.floor(F.col(c) / n)
    tiles = footprint_tiles(spark, sf, side).select((F.col("image") * 4 + at("tile_r") * 2 + at("tile_c")).alias("image"), (F.col("tile_r") % n).alias("tile_r"),
                                                    (F.col("tile_c") % n).alias("tile_c"), "data")
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    images = I.buildings(spark, sf).select("scene").distinct().select("scene", k.alias("k")).select(
        (F.col("scene") * 4 + F.col("k")).alias("image"), F.lit(n * side).alias("width"), F.lit(n * side).alias("height"), F.lit("plane").alias("crs"),
        P.affine(1, 0, F.col("scene") * 2000 + F.col("k") % 2 * n * side, 0, -1, -F.floor(F.col("k") / 2) * n * side).alias("t"))
    aois = I.aois(spark, sf).select("aoi", (F.col("x0") + 2000 * F.col("scene")).alias("x0"), (-F.col("y1")).alias("y0"),
                                    (F.col("x1") + 2000 * F.col("scene")).alias("x1"), (-F.col("y0")).alias("y1"))
    params = SegmentationParams(min_building_size=1, max_hole_size=1, morph_kernel_size=1, min_building_area=0, max_building_area=1e9,
                                simplify_tolerance=0, buffer_distance=0, use_mbr=False)
    polys = jobs.map_settlements(tiles, footprint_model, side, params, _boxes(aois), "aoi", images, has_edge=False)
    return SJ.with_bounds(polys).select("aoi", "xmin", "ymin", "xmax", "ymax")


@query("evaluation_report", f"""with recursive {TRUTH_PRED}, gm as (select image, r, c from tp where g = 1), pm as (select image, r, c from tp where p = 1),
{_components_sql("pm", "p")}, {_components_sql("gm", "t")},
o as (select p.image, p.label as pl, t.label as tl, count(*) as n from cpp p join cpt t using (image, r, c) group by all),
np as (select image, label, count(*) as n from cpp group by all), nt as (select image, label, count(*) as n from cpt group by all),
m as (select count(*) as k from o join np on np.image = o.image and np.label = pl join nt on nt.image = o.image and nt.label = tl
 where o.n / (np.n + nt.n - o.n) >= 0.5),
s as (select {METRIC_SUMS} from tp), b as (select (select k from m) as n_matched, (select count(*) from np) as n_pred_buildings, (select count(*) from nt) as n_truth_buildings)
select s.*, {metric_ratios(3)}, b.*, round(n_matched / n_pred_buildings, 3) as building_precision, round(n_matched / n_truth_buildings, 3) as building_recall from s, b""")
def evaluation_report(spark, sf):
    tp = I.truth_pred(spark, sf)
    return jobs.evaluate(tp.select("image", "r", "c", (F.col("g") * 255).alias("truth")),
                         tp.select("image", "r", "c", F.col("p").cast("double").alias("pred")), 0.5)


@query("detected_shapes", f"""with recursive {PIXELS}, on_ as (select image, r, c from px where v / 255 > 0.3),
grown as (select distinct image, r + dr as r, c + dc as c from on_, (select unnest([-1, 0, 1]) as dr), (select unnest([-1, 0, 1]) as dc)
 where r + dr between 0 and 127 and c + dc between 0 and 127), {_components_sql("grown", "g")}
select image, label, min(c)::double as xmin, min(r)::double as ymin, (max(c) + 1)::double as xmax, (max(r) + 1)::double as ymax from cpg group by image, label having count(*) > 2""")
def detected_shapes(spark, sf):
    """Boxes of the shapes of the single-pass job."""
    polys, _ = jobs.detect_image(I.pixels(spark, sf), image_sizes(spark, sf), brightness_model, TILE, threshold=0.3)
    return SJ.with_bounds(polys).select("image", "label", "xmin", "ymin", "xmax", "ymax")


_HALF = 500


@query("training_tiles", f"""with {MASK}, ho as (select scene, x0, x1, unnest([y0, y1]) as r from bld), ve as (select scene, y0, y1, unnest([x0, x1]) as c from bld),
ln as (select scene as image, r, unnest(range(x0, x1 + 1)) as c from ho union select scene, unnest(range(y0, y1 + 1)), c from ve),
sn as (select distinct scene from bld), pf as (select scene, rr.r::int as r, cc.c::int as wc from sn, (select unnest(range(0, 1000)) as r) rr, (select unnest(range(0, 1000)) as c) cc),
d as (select pf.scene * 2 + pf.wc // 500 as image, pf.r, pf.wc, pf.wc % 500 as c, (m.image is not null)::int as b, (l.image is not null)::int as e from pf
 left join mask m on m.image = pf.scene and m.r = pf.r and m.c = pf.wc left join ln l on l.image = pf.scene and l.r = pf.r and l.c = pf.wc),
h as (select *, min(b) over x as hb, max(e) over x as he from d window x as (partition by image, r order by c rows between 1 preceding and 1 following)),
v as (select image, r, c, wc, min(hb) over y as b, max(he) over y as e from h window y as (partition by image, c order by r rows between 1 preceding and 1 following)),
t as (select image, (r // 125)::int as tile_r, (c // 125)::int as tile_c, sum(case when e = 1 then 0 else b * 255 end)::bigint as building_sum, sum(e * 255)::bigint as edge_sum,
 sum((r * 7 + wc * 3 + 31) % 256)::bigint as band1_sum, count(*) as n_weights from v group by all),
n as (select *, image || '_r' || tile_r || '_c' || tile_c || '.TIF' as name from t)
select *, row_number() over (order by md5('2022:' || name), name) <= ceil(0.2 * count(*) over ()) as is_test from n""")
def training_tiles(spark, sf):
    """Bands and labels of whole planes, two images each, to split training tiles; footprints over the border are burnt in part into both."""
    from ..config import TrainParams
    plane = I.frame(I.buildings(spark, sf).select("scene").distinct(), I.PLANE, I.PLANE, "scene")
    half = F.floor(F.col("c") / _HALF).cast("long")
    bands = plane.select((F.col("scene") * 2 + half).alias("image"), "r", F.col("c").alias("wc"), (F.col("c") % _HALF).cast("int").alias("c"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("band"))
    bands = bands.select("image", "band", "r", "c", ((F.col("r") * 7 + F.col("wc") * 3 + F.col("band") * 31) % 256).alias("v"), F.lit(3).alias("n_bands"))
    images = I.buildings(spark, sf).select("scene").distinct().select("scene", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select(
        (F.col("scene") * 2 + F.col("half")).alias("image"), F.lit(_HALF).alias("width"), F.lit(I.PLANE).alias("height"),
        P.affine(1, 0, F.col("scene") * 2000 + F.col("half") * _HALF, 0, 1, 0).alias("t"))
    moved = I.buildings(spark, sf).select("bid", *[(F.col(n) + F.col("scene") * 2000).alias(n) for n in ("x0", "x1")], "y0", "y1")
    labels = _boxes(moved).select(F.col("bid").alias("pid"), "ring", "xmin", "ymin", "xmax", "ymax")
    t = jobs.prepare_tiles(bands, images, labels, TilingParams(tile_size=125, codes=("background", "building", "edge"), distance_weighting=True), TrainParams())
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v).alias(f"{c}_sum")
    return t.select("image", "tile_r", "tile_c", "name", "is_test", total("building"), total("edge"), total("band1"), F.size("weight").cast("long").alias("n_weights"))


# --- arrivals (batch form of the streaming operators) -----------------------

@query("quality_tumbling", f"""with {ARRIVALS}, w as (select *, time_bucket(interval 1 hour, ts) as s from ar), m as (select s, {METRIC_SUMS} from w group by s)
select s as start, s + interval 1 hour as "end", n_intersect, n_pred, n_truth, n_equal, {metric_ratios(6)} from m""")
def quality_tumbling(spark, sf):
    return ST.quality_tumbling(I.arrivals(spark, sf))


@query("quality_sliding", f"""with {ARRIVALS}, w as (select *, time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as s from ar, (select unnest([0, 1]) as k)),
m as (select s, event_type, {METRIC_SUMS} from w group by all)
select s as start, s + interval 1 hour as "end", event_type, n_intersect, n_pred, n_truth, n_equal, {metric_ratios(6)} from m""")
def quality_sliding(spark, sf):
    return ST.quality_sliding(I.arrivals(spark, sf), by=("event_type",))


@query("quality_sessions", f"""with {ARRIVALS}, g as (select *, (ts - lag(ts) over (partition by image order by ts) >= interval 30 minutes)::int as b from ar),
k as (select *, sum(coalesce(b, 0)) over (partition by image order by ts, event_id rows unbounded preceding) as s from g),
m as (select image, s, min(ts) as start, max(ts) + interval 30 minutes as "end", {METRIC_SUMS} from k group by image, s)
select start, "end", image, n_intersect, n_pred, n_truth, n_equal, {metric_ratios(6)} from m""")
def quality_sessions(spark, sf):
    return ST.quality_sessions(I.arrivals(spark, sf))


@query("dedupe_arrivals", f"""with {ARRIVALS} select distinct event_id, image from (select event_id, image from ar union all select event_id, image from ar)""")
def dedupe_arrivals(spark, sf):
    a = I.arrivals(spark, sf)
    return ST.dedupe_arrivals(a.unionByName(a), ["event_id"]).select("event_id", "image")
