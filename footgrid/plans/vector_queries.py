"""Queries over polygons: geometry functions, spatial joins, settlements, burning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs as K, geometry as G
from ..operators import burn, components as C, polygonize as PG, segment, settlements as ST, spatial_join as SJ
from ..operators.pairing import concat_frames, tiles_of_names
from ..session import cut_lineage
from ..sources.labels import polygons_of_wkt
from . import inputs as I
from .catalog import query
from .views_sql import AOIS, BUILDINGS, MASK, PIXELS, PREDICTED

CELL = 64


def _rings(spark, sf):
    """Footprints parsed from their WKT text."""
    return polygons_of_wkt(I.buildings(spark, sf), "wkt").drop("part")


def _boxes(df):
    return I.rings(df)


# --- geometry functions -----------------------------------------------------

@query("wkt_area", f"""with {BUILDINGS} select bid, ((x1 - x0) * (y1 - y0))::double as area, (2 * (x1 - x0 + y1 - y0))::double as perimeter,
 5 as n_points, true as closed from bld""")
def wkt_area(spark, sf):
    ring = F.col("ring")
    return _rings(spark, sf).select("bid", G.area(ring).alias("area"), G.perimeter(ring).alias("perimeter"),
                                    F.size(ring).alias("n_points"), G.is_closed(ring).alias("closed"))


@query("ring_bounds", f"with {BUILDINGS} select bid, x0::double as xmin, y0::double as ymin, x1::double as xmax, y1::double as ymax from bld")
def ring_bounds(spark, sf):
    return SJ.with_bounds(_rings(spark, sf)).select("bid", "xmin", "ymin", "xmax", "ymax")


@query("ring_centroid", f"with {BUILDINGS} select bid, round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy from bld")
def ring_centroid(spark, sf):
    return _rings(spark, sf).withColumn("g", G.centroid(F.col("ring"))).select(
        "bid", F.round("g.x", 6).alias("cx"), F.round("g.y", 6).alias("cy"))


@query("scale_about_centroid", f"""with {BUILDINGS} select bid, round((x0 + (x1 - x0) * 0.1)::double, 6) as xmin, round((x1 - (x1 - x0) * 0.1)::double, 6) as xmax,
 round(((x1 - x0) * (y1 - y0) * 0.64)::double, 6) as area from bld""")
def scale_about_centroid(spark, sf):
    s = SJ.with_bounds(_rings(spark, sf).withColumn("ring", G.scale(F.col("ring"), 0.8)))
    return s.select("bid", F.round("xmin", 6).alias("xmin"), F.round("xmax", 6).alias("xmax"),
                    F.round(G.area(F.col("ring")), 6).alias("area"))


@query("rotate_ring", f"""with {BUILDINGS} select bid, round((x0 + x1) / 2 + (x0 - (x0 + x1) / 2) * cos(radians(30)) - (y0 - (y0 + y1) / 2) * sin(radians(30)), 6) as px,
 round((y0 + y1) / 2 + (x0 - (x0 + x1) / 2) * sin(radians(30)) + (y0 - (y0 + y1) / 2) * cos(radians(30)), 6) as py,
 round(((x1 - x0) * (y1 - y0))::double, 6) as area from bld""")
def rotate_ring(spark, sf):
    r = _rings(spark, sf).withColumn("ring", G.rotate(F.col("ring"), 30.0))
    return r.select("bid", F.round(F.col("ring")[0].x, 6).alias("px"), F.round(F.col("ring")[0].y, 6).alias("py"),
                    F.round(G.area(F.col("ring")), 6).alias("area"))


def _cea_y(lat: str) -> str:
    s, e = f"sin(radians({lat}))", K.E
    return (f"({K.A / 2!r}::double * {1 - K.E2!r}::double * ({s} / (1 - {K.E2!r}::double * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}::double))")


@query("cea_area", f"""with {BUILDINGS} select bid, round(radians(((x1 - x0) / 10000.0)::double) * {K.A!r}::double *
 ({_cea_y('(y1 / 10000.0)::double')} - {_cea_y('(y0 / 10000.0)::double')}), 1) as area from bld""")
def cea_area(spark, sf):
    """Footprints read as ten-thousandths of a degree: area through the equal-area plane."""
    deg = G.map_points(F.col("ring"), lambda x, y: x / 10000.0, lambda x, y: y / 10000.0)
    return _rings(spark, sf).withColumn("ring", deg).select(
        "bid", F.round(K.true_area(F.col("ring"), "EPSG:4326"), 1).alias("area"))


@query("web_mercator", f"""with {BUILDINGS} select bid, round(radians(x0 / 10.0) * {K.A!r}, 3) as mx,
 round(ln(tan(pi() / 4 + radians((y0 - 500) / 10.0) / 2)) * {K.A!r}, 3) as my from bld""")
def web_mercator(spark, sf):
    x, y = K.transform_xy(F.col("x0") / 10.0, (F.col("y0") - 500) / 10.0, "EPSG:4326", "EPSG:3857")
    return I.buildings(spark, sf).select("bid", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query("utm_round_trip", f"with {BUILDINGS} select bid, round(33 + (x0 - 500) / 250.0, 6) as lon, round((y0 - 500) / 8.0, 6) as lat from bld")
def utm_round_trip(spark, sf):
    lon, lat = 33 + (F.col("x0") - 500) / 250.0, (F.col("y0") - 500) / 8.0
    x, y = K.transform_xy(lon, lat, "EPSG:4326", "EPSG:32636")
    b = I.buildings(spark, sf).select("bid", x.alias("x"), y.alias("y"))
    lo, la = K.transform_xy(F.col("x"), F.col("y"), "EPSG:32636", "EPSG:4326")
    return b.select("bid", F.round(lo, 6).alias("lon"), F.round(la, 6).alias("lat"))


@query("edge_steps", f"""with {BUILDINGS} select bid, i, (case i when 0 then x1 - x0 when 2 then x0 - x1 else 0 end)::double as dx,
 (case i when 1 then y1 - y0 when 3 then y0 - y1 else 0 end)::double as dy from bld, (select unnest(range(0, 4))::int as i)""")
def edge_steps(spark, sf):
    e = _rings(spark, sf).select("bid", F.posexplode(G.edges(F.col("ring"))).alias("i", "e"))
    return e.select("bid", "i", (F.col("e.x2") - F.col("e.x1")).alias("dx"), (F.col("e.y2") - F.col("e.y1")).alias("dy"))


def _multi(spark, sf):
    """Two-part polygons: a footprint and a copy three times as wide, moved up."""
    b = I.buildings(spark, sf)
    part = lambda x0, y0, x1, y1: F.concat(F.lit("(("), F.concat_ws(", ", *[
        F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in
        ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]), F.lit("))"))
    x0, y0, x1, y1 = (F.col(n) for n in ("x0", "y0", "x1", "y1"))
    return b.select("bid", F.concat(F.lit("MULTIPOLYGON ("), part(x0, y0, x1, y1), F.lit(", "),
                                    part(x0, y0 + 20, x0 + (x1 - x0) * 3, y1 + 20), F.lit(")")).alias("wkt"))


@query("multipolygon_parts", f"""with {BUILDINGS} select bid, part, ((x1 - x0) * (y1 - y0) * (1 + 2 * part))::double as area
 from bld, (select unnest([0, 1])::int as part)""")
def multipolygon_parts(spark, sf):
    return polygons_of_wkt(_multi(spark, sf), "wkt").select("bid", "part", G.area(F.col("ring")).alias("area"))


@query("largest_part", f"with {BUILDINGS} select bid, ((x1 - x0) * (y1 - y0) * 3)::double as area, (y0 + 20)::double as ymin from bld")
def largest_part(spark, sf):
    best = segment.largest_part(polygons_of_wkt(_multi(spark, sf), "wkt").select("bid", "ring"), ["bid"])
    return best.select("bid", "area", G.bounds(F.col("ring")).ymin.alias("ymin"))


@query("valid_rings", f"""with {BUILDINGS} select bid, (bid % 4 = 0) as valid from bld""")
def valid_rings(spark, sf):
    """A good ring, a bow tie, a flat ring and an open one in turn."""
    p = lambda i: F.col("ring")[i]
    shaped = F.when(F.col("bid") % 4 == 0, F.col("ring")) \
        .when(F.col("bid") % 4 == 1, F.array(p(0), p(2), p(1), p(3), p(0))) \
        .when(F.col("bid") % 4 == 2, F.array(p(0), p(1), p(1), p(0))) \
        .otherwise(F.slice("ring", 1, 4))
    return _rings(spark, sf).select("bid", G.is_valid(shaped).alias("valid"))


@query("geometry_types", f"""with {BUILDINGS} select case when bid % 5 = 0 then 'LINESTRING' else 'POLYGON' end as kind, count(*) as n,
 sum((bid % 5 <> 0)::int)::bigint as n_rings from bld group by 1""")
def geometry_types(spark, sf):
    b = I.buildings(spark, sf).withColumn("wkt", F.when(F.col("bid") % 5 == 0, F.lit("LINESTRING(0 0, 1 1)")).otherwise(F.col("wkt")))
    p = polygons_of_wkt(b, "wkt", keep_bad=True)
    return p.groupBy(G.wkt_type(F.col("wkt")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ring").isNotNull().cast("long")).alias("n_rings"))


@query("min_rotated_rect", f"""with {BUILDINGS} select bid, round(((x1 - x0) * (y1 - y0))::double, 5) as area from bld""")
def min_rotated_rect(spark, sf):
    """Footprints turned by an angle of their own: the smallest rectangle is the footprint."""
    r = _rings(spark, sf).withColumn("ring", G.rotate(F.col("ring"), (F.col("bid") % 90).cast("double")))
    r = r.withColumn("hull", G.convex_hull(F.col("ring"))).withColumn("mbr", G.min_rotated_rect(F.col("hull")))
    return r.select("bid", F.round(G.area(F.col("mbr")), 5).alias("area"))


@query("regularized_shapes", f"""with {BUILDINGS} select bid, round(case when bid % 2 = 0 then ((x1 - x0) * (y1 - y0))::double * 100
 else ((x1 - x0) * (y1 - y0))::double * 75 - 5 * 0.04 * (1 - 8 * sin(pi() / 32)) end, 5) as area from bld""")
def regularized_shapes(spark, sf):
    """In tenths of a unit. Even ids: a box with a shallow dent is squared up. Odd ids: an L keeps its shape but for its five convex
    corners, rounded by arcs of 16 segments."""
    from ..config import SegmentationParams
    b = I.buildings(spark, sf)
    x0, y0, x1, y1 = (F.col(n).cast("double") * 10 for n in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    dent = F.array(pt(x0, y0), pt(mx, y0 + 0.2), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    ell = F.array(pt(x0, y0), pt(x1, y0), pt(x1, my), pt(mx, my), pt(mx, y1), pt(x0, y1), pt(x0, y0))
    shapes = b.select("bid", F.when(F.col("bid") % 2 == 0, dent).otherwise(ell).alias("ring"))
    out = segment.regularize(shapes, SegmentationParams(simplify_tolerance=0.5))
    return out.select("bid", F.round(G.area(F.col("ring")), 5).alias("area"))


@query("convex_overlap", f"""with {PREDICTED}, j as (select p.pid, greatest(0, least(p.x1, b.x1) - greatest(p.x0, b.x0)) * (p.y1 - p.y0) as i,
 (p.x1 - p.x0) * (p.y1 - p.y0) as a from prd p join bld b on b.bid = p.pid)
select pid, round(i::double, 6) as overlap, round(i / (2 * a - i), 6) as iou from j""")
def convex_overlap(spark, sf):
    p = _boxes(I.predicted_buildings(spark, sf)).select("pid", F.col("ring").alias("pr"))
    b = _rings(spark, sf).select(F.col("bid").alias("pid"), F.col("ring").alias("tr"))
    return p.join(b, "pid").select("pid", F.round(G.intersection_area_convex(F.col("pr"), F.col("tr")), 6).alias("overlap"),
                                   F.round(G.iou_convex(F.col("pr"), F.col("tr")), 6).alias("iou"))


@query("concave_overlap", f"""with {BUILDINGS}, d as (select bid, 10 * x0 as x0, 10 * x1 as x1, 10 * y0 as y0, 10 * y1 as y1, 10 * (bid % 3) as s from bld),
m as (select *, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, (x1 - x0) * (y1 - y0) as f from d),
o as (select bid, f, (x1 - x0 - s) * (y1 - y0) as box, greatest(0, least(x1, x1 + s) - greatest(mx, x0 + s)) * (y1 - my) as notch,
 greatest(0, least(x1 - 5, x1 + s) - greatest(x0 + 5, x0 + s)) * (y1 - y0 - 10) as hole, (x1 - x0 - 10) * (y1 - y0 - 10) as whole_hole from m)
select bid, round(box - notch, 5)::double as overlap, round((box - notch) / (0.75 * f + f - (box - notch)), 6)::double as iou, round(box - hole, 5)::double as ring_overlap,
 round(f - whole_hole, 5)::double as ring_area from o""")
def concave_overlap(spark, sf):
    """In tenths of a unit: an L, and a box with a hole, each against the whole box moved to the right."""
    b = I.buildings(spark, sf)
    x0, y0, x1, y1 = (F.col(n).cast("double") * 10 for n in ("x0", "y0", "x1", "y1"))
    mx, my, s = (x0 + x1) / 2, (y0 + y1) / 2, F.col("bid") % 3 * 10
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ell = F.array(pt(x0, y0), pt(x1, y0), pt(x1, my), pt(mx, my), pt(mx, y1), pt(x0, y1), pt(x0, y0))
    hole = F.array(pt(x0 + 5, y0 + 5), pt(x0 + 5, y1 - 5), pt(x1 - 5, y1 - 5), pt(x1 - 5, y0 + 5), pt(x0 + 5, y0 + 5))
    box = lambda d: F.array(pt(x0 + d, y0), pt(x1 + d, y0), pt(x1 + d, y1), pt(x0 + d, y1), pt(x0 + d, y0))
    r = b.select("bid", ell.alias("l"), F.array(box(F.lit(0)), hole).alias("h"), box(s).alias("p"))
    return r.select("bid", F.round(G.intersection_area(F.col("l"), F.col("p")), 5).alias("overlap"), F.round(G.iou(F.col("l"), F.col("p")), 6).alias("iou"),
                    F.round(G.intersection_area_of(F.col("h"), F.array("p")), 5).alias("ring_overlap"), F.round(G.net_area(F.col("h")), 5).alias("ring_area"))


# --- filters ----------------------------------------------------------------

@query("area_filter", f"with {BUILDINGS} select bid, ((x1 - x0) * (y1 - y0))::double as area from bld where (x1 - x0) * (y1 - y0) > 10 and (x1 - x0) * (y1 - y0) < 40")
def area_filter(spark, sf):
    r = _rings(spark, sf).select("bid", G.area(F.col("ring")).alias("area"))
    return segment.area_filter(r, 10, 40)


@query("drop_largest", f"""with {BUILDINGS}, k as (select x0 // 100 as image, bid, ((x1 - x0) * (y1 - y0))::double as area from bld),
n as (select *, row_number() over (partition by image order by area desc, bid) as rn, count(*) over (partition by image) as n from k)
select image, bid, area from n where not (n > 1 and rn = 1)""")
def drop_largest(spark, sf):
    r = _rings(spark, sf).select(I.idiv(F.col("x0"), 100).alias("image"), "bid", G.area(F.col("ring")).alias("area"))
    return segment.drop_largest(r, ["image"], id_="bid")


@query("dedupe_labels", f"with {BUILDINGS} select scene, min(bid) as bid, count(*) as n_copies from bld group by scene, x0, y0, x1, y1")
def dedupe_labels(spark, sf):
    r = _rings(spark, sf).withColumn("k", G.ring_key(F.col("ring")))
    return r.groupBy("scene", "k").agg(F.min("bid").alias("bid"), F.count(F.lit(1)).alias("n_copies")).drop("k")


@query("concat_labels", f"""with {BUILDINGS} select x0, y0, x1, y1, confidence, null as source from bld where bid % 2 = 0
 union select x0, y0, x1, y1, null, 'survey' from bld where bid % 2 = 1 or bid % 3 = 0""")
def concat_labels(spark, sf):
    b = I.buildings(spark, sf)
    one = b.where("bid % 2 = 0").select("x0", "y0", "x1", "y1", "confidence")
    two = b.where("bid % 2 = 1 or bid % 3 = 0").select("x0", "y0", "x1", "y1", F.lit("survey").alias("source"))
    return concat_frames(one, two)


@query("dominant_angle", f"""with {BUILDINGS} select bid, (case when bid % 2 = 0 then -180.0 else -160.0 end)::double as angle from bld""")
def dominant_angle(spark, sf):
    """Axis-parallel and tilted (25 degrees) footprints: the lowest of the equally full bins."""
    ring = F.when(F.col("bid") % 2 == 0, G.rotate(F.col("ring"), 5.0)).otherwise(G.rotate(F.col("ring"), 25.0))
    return _rings(spark, sf).withColumn("ring", ring).select("bid", G.dominant_angle(F.col("ring")).alias("angle"))


@query("edge_direction_hist", f"""with {BUILDINGS}, e as (select scene, d from bld, (select unnest([9, 13, 17, 4]) as d))
select scene, d::int as bin, count(*) as n from e group by all""")
def edge_direction_hist(spark, sf):
    return ST.edge_directions(_rings(spark, sf), by=("scene",))


_IN_AOI = f"""{BUILDINGS}, {AOIS}, ba as (select a.scene, a.aoi, b.bid from aoi a join bld b on a.scene = b.scene
 and b.x0 <= a.x1 and b.x1 >= a.x0 and b.y0 <= a.y1 and b.y1 >= a.y0)"""


@query("settlement_angle", f"""with {_IN_AOI}, g as (select scene, aoi, (bid % 3 * 20 - 180)::double as angle, bid % 3 * 2 as bin from ba),
k as (select scene, aoi, bin, count(*) as n from g group by all),
m as (select scene, aoi, sum(n)::bigint as n_buildings, arg_max(bin, n * 100 - bin) as bin from k group by all)
select scene, aoi, n_buildings, bin::int as bin, (bin * 10 - 180)::double as angle from m where n_buildings > 3""")
def settlement_angle(spark, sf):
    pairs = SJ.box_pairs(_boxes(I.buildings(spark, sf)), _boxes(I.aois(spark, sf)), "bid", "aoi", CELL, ("scene",))
    angles = pairs.select("scene", "aoi", ((F.col("bid") % 3) * 20 - 180 + 0.001).cast("double").alias("angle"))
    return ST.settlement_angle(angles, ("scene", "aoi"))


# --- spatial joins ----------------------------------------------------------

@query("settlement_building_pairs", f"with {_IN_AOI} select scene, bid, aoi from ba")
def settlement_building_pairs(spark, sf):
    return SJ.box_pairs(_boxes(I.buildings(spark, sf)), _boxes(I.aois(spark, sf)), "bid", "aoi", CELL, ("scene",))


@query("settlement_building_pairs_exact", f"with {_IN_AOI} select scene, bid, aoi from ba")
def settlement_building_pairs_exact(spark, sf):
    return SJ.ring_pairs(_boxes(I.buildings(spark, sf)), _boxes(I.aois(spark, sf)), "bid", "aoi", CELL, G.intersects, ("scene",))


@query("buildings_in_aoi", f"""with {_IN_AOI}, d as (select b.scene, min(b.bid) as bid, min(ba.aoi) as aoi from bld b join ba on ba.scene = b.scene and ba.bid = b.bid
 group by b.scene, b.x0, b.y0, b.x1, b.y1) select scene, bid, aoi from d""")
def buildings_in_aoi(spark, sf):
    return SJ.buildings_in_settlements(_boxes(I.buildings(spark, sf)), _boxes(I.aois(spark, sf)), CELL, ("scene",))


_TILES = "tl as (select scene, tr, tc from (select distinct p_partkey // 2000 as scene from part), (select unnest(range(0, 16)) as tr) a, (select unnest(range(0, 16)) as tc) b)"


def _tile_boxes(spark, sf):
    scenes = I.buildings(spark, sf).select("scene").distinct()
    t = I.frame(scenes, 16, 16, "scene").withColumnsRenamed({"r": "tile_r", "c": "tile_c"})
    return t.select("scene", "tile_r", "tile_c", (F.col("tile_r") * 16 + F.col("tile_c")).cast("long").alias("tile"),
                    *[(F.col(n) * CELL + d).cast("double").alias(k) for k, n, d in (
                        ("xmin", "tile_c", 0), ("ymin", "tile_r", 0), ("xmax", "tile_c", CELL), ("ymax", "tile_r", CELL))])


@query("tiles_in_aoi", f"""with {AOIS}, {_TILES} select scene, tr::int as tile_r, tc::int as tile_c from tl where exists (select 1 from aoi a
 where a.scene = tl.scene and a.x0 <= tc * 64 + 64 and a.x1 >= tc * 64 and a.y0 <= tr * 64 + 64 and a.y1 >= tr * 64)""")
def tiles_in_aoi(spark, sf):
    tiles = _tile_boxes(spark, sf).select("scene", "tile_r", "tile_c")
    return SJ.tiles_in_settlements(tiles, _boxes(I.aois(spark, sf)), CELL, ("scene",))


@query("labels_in_image", f"""with {BUILDINGS}, {_TILES} select scene, bid, tr * 16 + tc as image from tl join bld using (scene)
 where x0 <= tc * 64 + 64 and x1 >= tc * 64 and y0 <= tr * 64 + 64 and y1 >= tr * 64""")
def labels_in_image(spark, sf):
    images = _tile_boxes(spark, sf).withColumnRenamed("tile", "image")
    return SJ.labels_in_images(images, _boxes(I.buildings(spark, sf)), CELL, ("scene",))


@query("images_with_labels", f"""with {BUILDINGS}, {_TILES} select scene, tr * 16 + tc as image from tl where exists (select 1 from bld b
 where b.scene = tl.scene and x0 <= tc * 64 + 64 and x1 >= tc * 64 and y0 <= tr * 64 + 64 and y1 >= tr * 64)""")
def images_with_labels(spark, sf):
    """Images without any label are left out of training."""
    images = _tile_boxes(spark, sf)
    hit = SJ.tiles_touched(_boxes(I.buildings(spark, sf)), CELL, "scene").distinct()
    return images.join(hit, ["scene", "tile_r", "tile_c"], "left_semi").select("scene", F.col("tile").alias("image"))


_PER_TILE = f"""{BUILDINGS}, {_TILES}, t as (select scene, tr, tc, confidence from tl left join bld using (scene)
 where x0 <= tc * 64 + 64 and x1 >= tc * 64 and y0 <= tr * 64 + 64 and y1 >= tr * 64)"""


@query("buildings_per_tile", f"""with {_PER_TILE} select tl.scene, tl.tr::int as tile_r, tl.tc::int as tile_c, count(confidence) as n_buildings
 from tl left join t on t.scene = tl.scene and t.tr = tl.tr and t.tc = tl.tc group by all""")
def buildings_per_tile(spark, sf):
    counts = SJ.per_tile(_boxes(I.buildings(spark, sf)), CELL, ("scene",)).drop("mean_confidence")
    return _tile_boxes(spark, sf).select("scene", "tile_r", "tile_c").join(counts, ["scene", "tile_r", "tile_c"], "left") \
        .withColumn("n_buildings", F.coalesce("n_buildings", F.lit(0)).cast("long"))


@query("mean_confidence_per_tile", f"""with {_PER_TILE} select scene, tr::int as tile_r, tc::int as tile_c, round(avg(confidence), 6) as mean_confidence
 from t group by all""")
def mean_confidence_per_tile(spark, sf):
    d = SJ.per_tile(_boxes(I.buildings(spark, sf)), CELL, ("scene",)).where("tile_r < 16 and tile_c < 16")
    return d.select("scene", F.col("tile_r").cast("int").alias("tile_r"), F.col("tile_c").cast("int").alias("tile_c"),
                    F.round("mean_confidence", 6).alias("mean_confidence"))


_IOU = f"""{PREDICTED}, dp as (select scene, min(pid) as pid, count(*) as n_pred, x0, y0, x1, y1 from prd group by scene, x0, y0, x1, y1),
dt as (select scene, min(bid) as tid, count(*) as n_truth, x0, y0, x1, y1 from bld group by scene, x0, y0, x1, y1),
j as (select p.scene, p.pid, t.tid, p.n_pred, t.n_truth, (least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0)) as i,
 (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) as ab from dp p join dt t on p.scene = t.scene
 and p.x0 < t.x1 and p.x1 > t.x0 and p.y0 < t.y1 and p.y1 > t.y0),
iou as (select scene, pid, tid, n_pred, n_truth, i / (ab - i) as iou from j)"""


@query("building_iou_pairs", f"with {_IOU} select scene, pid, tid, n_pred, n_truth, round(iou, 6) as iou from iou where iou >= 0.1")
def building_iou_pairs(spark, sf):
    p = SJ.iou_pairs(_boxes(I.predicted_buildings(spark, sf)),
                     _boxes(I.buildings(spark, sf)).withColumnRenamed("bid", "tid"), 0.1, CELL, ("scene",))
    return p.withColumn("iou", F.round("iou", 6))


@query("building_pr", f"""with {_IOU}, m as (select * from iou where iou >= 0.5),
s as (select (select sum(n_pred * n_truth) from m)::bigint as n_pairs, (select sum(n_pred) from (select distinct scene, pid, n_pred from m))::bigint as matched_pred,
 (select sum(n_truth) from (select distinct scene, tid, n_truth from m))::bigint as matched_truth, (select count(*) from prd) as n_pred, (select count(*) from bld) as n_truth)
select *, round(n_pairs / n_pred, 3) as building_precision, round(n_pairs / n_truth, 3) as building_recall from s""")
def building_pr(spark, sf):
    return SJ.building_scores(_boxes(I.predicted_buildings(spark, sf)),
                              _boxes(I.buildings(spark, sf)).withColumnRenamed("bid", "tid"), 0.5, CELL, ("scene",))


@query("ring_iou_pairs", f"""with {_IOU}, h as (select p.scene, p.pid, t.tid, p.n_pred, t.n_truth,
 greatest(0, least(p.x1, t.x1) - greatest(p.x0, (t.x0 + t.x1) / 2)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, (t.y0 + t.y1) / 2)) as notch,
 (least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0)) as i, (p.x1 - p.x0) * (p.y1 - p.y0) + 0.75 * (t.x1 - t.x0) * (t.y1 - t.y0) as ab
 from dp p join dt t on p.scene = t.scene and p.x0 < t.x1 and p.x1 > t.x0 and p.y0 < t.y1 and p.y1 > t.y0)
select scene, pid, tid, n_pred, n_truth, round((i - notch) / (ab - (i - notch)), 6)::double as iou from h where (i - notch) / (ab - (i - notch)) >= 0.3""")
def ring_iou_pairs(spark, sf):
    """Boxes against L-shaped footprints, measured on the rings."""
    x0, y0, x1, y1 = (F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ell = F.array(pt(x0, y0), pt(x1, y0), pt(x1, my), pt(mx, my), pt(mx, y1), pt(x0, y1), pt(x0, y0))
    truth = I.buildings(spark, sf).select("scene", F.col("bid").alias("tid"), ell.alias("ring"))
    pred = _boxes(I.predicted_buildings(spark, sf)).select("scene", "pid", "ring")
    return SJ.ring_iou_pairs(pred, truth, 0.3, CELL, ("scene",)).withColumn("iou", F.round("iou", 6))


# --- settlement groups ------------------------------------------------------

_MEMBER = f"""{AOIS}, {_TILES}, mb as (select aoi.scene, aoi, tr * 16 + tc as tile from aoi join tl on tl.scene = aoi.scene
 and aoi.x0 <= tc * 64 + 64 and aoi.x1 >= tc * 64 and aoi.y0 <= tr * 64 + 64 and aoi.y1 >= tr * 64),
lk as (select distinct a.scene, a.aoi as u, b.first as v from mb a join (select scene, tile, min(aoi) as first from mb group by all) b
 on a.scene = b.scene and a.tile = b.tile where a.aoi <> b.first)"""
_GROUPS = f"""recursive {_MEMBER}, sy as (select scene, u, v from lk union select scene, v, u from lk),
w(scene, aoi, g) as (select distinct scene, aoi, aoi from mb union select sy.scene, sy.v, w.g from w join sy on sy.scene = w.scene and sy.u = w.aoi where w.g < sy.v),
gr as (select scene, aoi, min(g) as grp from w group by all)"""


def _membership(spark, sf):
    t = SJ.tiles_touched(_boxes(I.aois(spark, sf)), CELL, "scene", "aoi").where("tile_r < 16 and tile_c < 16")
    return t.select("scene", "aoi", (F.col("tile_r") * 16 + F.col("tile_c")).alias("tile"))


@query("aoi_tile_pairs", f"with {_MEMBER} select scene, aoi, tile from mb")
def aoi_tile_pairs(spark, sf):
    tiles = _tile_boxes(spark, sf)
    return SJ.box_pairs(_boxes(I.aois(spark, sf)), tiles, "aoi", "tile", CELL, ("scene",)).select("scene", "aoi", "tile")


@query("aoi_links", f"with {_MEMBER} select scene, u, v from lk")
def aoi_links(spark, sf):
    return ST.tile_links(_membership(spark, sf), ("scene",))


@query("aoi_components", f'with {_GROUPS} select scene, aoi, grp as "group" from gr')
def aoi_components(spark, sf):
    return ST.groups(_membership(spark, sf), ("scene",))


@query("aoi_group_names", f"""with {_GROUPS} select scene, grp as "group", string_agg(aoi::varchar, '_' order by aoi) as aoi_group, count(*) as n_aois
 from gr group by scene, grp""")
def aoi_group_names(spark, sf):
    return ST.group_names(ST.groups(_membership(spark, sf), ("scene",)), ("scene",))


@query("aoi_group_tiles", f'with {_GROUPS} select distinct mb.scene, grp as "group", tile from mb join gr on gr.scene = mb.scene and gr.aoi = mb.aoi')
def aoi_group_tiles(spark, sf):
    m = _membership(spark, sf)
    return ST.group_tiles(ST.groups(m, ("scene",)), m, ("scene",))


@query("tiles_by_name_list", f"""with {_MEMBER} select distinct mb.scene * 1000 + aoi as "group", 't' || tile as name, tile from mb""")
def tiles_by_name_list(spark, sf):
    m = _membership(spark, sf)
    lists = m.groupBy((F.col("scene") * 1000 + F.col("aoi")).alias("group")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("t"), F.col("tile").cast("string")))).alias("names"))
    tiles = m.select("tile").distinct().withColumn("name", F.concat(F.lit("t"), F.col("tile").cast("string")))
    return tiles_of_names(lists, tiles)


@query("dissolved_area", f"""with {_GROUPS}, ax as (select a.scene, grp, x0, x1, y0, unnest(range(y0, y1)) as y from aoi a join gr on gr.scene = a.scene and gr.aoi = a.aoi),
cv as (select distinct scene, grp, y, unnest(range(x0, case when y >= y0 + 20 then x0 + 20 else x1 end)) as x from ax),
nb as (select cv.scene, cv.grp, cv.x, cv.y, 4 - count(o.x) as open from cv left join cv o on o.scene = cv.scene and o.grp = cv.grp and abs(o.x - cv.x) + abs(o.y - cv.y) = 1
 and o.x between cv.x - 1 and cv.x + 1 and o.y between cv.y - 1 and cv.y + 1 group by all)
select scene, grp as "group", count(*)::double as area, sum(open)::double as perimeter from nb group by all""")
def dissolved_area(spark, sf):
    """Area and outline length of each group's L-shaped settlements, overlaps counted once."""
    g = ST.groups(_membership(spark, sf), ("scene",))
    a = I.aois(spark, sf).join(g, ["scene", "aoi"])
    x0, y0, x1, y1 = (F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ell = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y0 + 20), pt(x0 + 20, y0 + 20), pt(x0 + 20, y1), pt(x0, y1), pt(x0, y0))
    out = ST.dissolve(a.select("scene", "group", ell.alias("ring")), ("scene", "group"), CELL)
    return out.select("scene", "group", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


# --- burning, components, polygons ------------------------------------------

def burnable(spark, sf):
    b = _boxes(I.buildings(spark, sf))
    return b.select(F.col("scene").alias("image"), F.col("bid").alias("pid"), "ring",
                    F.lit(I.PLANE).alias("width"), F.lit(I.PLANE).alias("height"))


def burnt(spark, sf):
    return burn.fill(burnable(spark, sf))


@query("burn_boxes", f"with {MASK} select image, r, c from mask")
def burn_boxes(spark, sf):
    return burnt(spark, sf)


_LINES = f"""{BUILDINGS}, ho as (select scene, x0, x1, unnest([y0, y1]) as r from bld), ve as (select scene, y0, y1, unnest([x0, x1]) as c from bld),
ln as (select scene as image, r, unnest(range(x0, x1 + 1)) as c from ho union select scene, unnest(range(y0, y1 + 1)), c from ve)"""


@query("burn_outlines", f"with {_LINES} select image, r::int as r, c::int as c from ln where r < 1000 and c < 1000")
def burn_outlines(spark, sf):
    return burn.outline(burnable(spark, sf))


_DENSE = """sn as (select distinct p_partkey // 2000 as image from part),
pf as (select image, rr.r::int as r, cc.c::int as c from sn, (select unnest(range(0, 1000)) as r) rr, (select unnest(range(0, 1000)) as c) cc)"""


def plane_frame(spark, sf):
    return I.frame(I.buildings(spark, sf).select(F.col("scene").alias("image")).distinct(), I.PLANE, I.PLANE)


@query("overlay_outline", f"""with {_LINES}, {_DENSE}, o as (select pf.*, ln.image is not null as hit from pf left join ln using (image, r, c))
select image, (r // 100)::bigint as block, sum(case when hit then 255 else (r + c) % 256 end)::bigint as red, sum(case when hit then 0 else (r * 2 + c) % 256 end)::bigint as green,
 sum(case when hit then 0 else (r + c * 3) % 256 end)::bigint as blue from o group by all""")
def overlay_outline(spark, sf):
    r, c = F.col("r"), F.col("c")
    rgb = plane_frame(spark, sf).select("image", "r", "c", ((r + c) % 256).alias("red"), ((r * 2 + c) % 256).alias("green"),
                                        ((r + c * 3) % 256).alias("blue"))
    out = burn.overlay(rgb, burnable(spark, sf))
    return out.groupBy("image", I.idiv(F.col("r"), 100).alias("block")).agg(*[F.sum(n).alias(n) for n in ("red", "green", "blue")])


_ER = "rows between 1 preceding and 1 following"


@query("training_mask", f"""with {MASK}, {_DENSE}, {_LINES[len(BUILDINGS) + 2:]},
d as (select pf.image, pf.r, pf.c, (m.image is not null)::int as b, (l.image is not null)::int as e from pf
 left join mask m using (image, r, c) left join ln l using (image, r, c)),
h as (select *, min(b) over (partition by image, r order by c {_ER}) as hb, max(e) over (partition by image, r order by c {_ER}) as he from d),
v as (select image, r, c, min(hb) over (partition by image, c order by r {_ER}) as b, max(he) over (partition by image, c order by r {_ER}) as e from h)
select image, r, c, (case when e = 1 then 0 else b * 255 end)::int as building, (e * 255)::int as edge from v where e = 1 or b = 1""")
def training_mask(spark, sf):
    planes = I.buildings(spark, sf).select("scene").distinct().count()
    tasks = I.n_tasks(spark, planes * I.PLANE * I.PLANE, I.PIXELS_PER_TASK)
    m = burn.training_mask(plane_frame(spark, sf), burnable(spark, sf), edge=True, erosion=True, tasks=tasks)
    return m.where("building > 0 or edge > 0").select("image", "r", "c", "building", "edge")


def _components_sql(mask: str = "mask", tag: str = "") -> str:
    """Recursive labelling of a pixel view: ``cp<tag>(image, r, c, label)``."""
    t = tag
    return f"""px{t} as (select image, r, c, r::bigint * 4294967296 + c as k from {mask}),
nb{t} as (select a.image, a.k as u, b.k as v from px{t} a join px{t} b on a.image = b.image and b.r = a.r and b.c = a.c + 1
 union all select a.image, a.k, b.k from px{t} a join px{t} b on a.image = b.image and b.c = a.c and b.r = a.r + 1),
sy{t} as (select image, u, v from nb{t} union all select image, v, u from nb{t}),
w{t}(image, k, g) as (select image, k, k from px{t} union select s.image, s.v, w{t}.g from w{t} join sy{t} s on s.image = w{t}.image and s.u = w{t}.k where w{t}.g < s.v),
cm{t} as (select image, k, min(g) as label from w{t} group by all),
cp{t} as (select px{t}.image, r, c, label from px{t} join cm{t} using (image, k))"""


_COMP = f"recursive {MASK}, {_components_sql()}"


@query("components", f"with {_COMP} select image, r::bigint as r, c::bigint as c, label from cp")
def components(spark, sf):
    return C.components(burnt(spark, sf)).select("image", "r", "c", "label")


@query("component_sizes", f"""with {_COMP} select image, label, count(*) as n, min(r)::bigint as rmin, min(c)::bigint as cmin,
 max(r)::bigint as rmax, max(c)::bigint as cmax from cp group by image, label""")
def component_sizes(spark, sf):
    return C.component_sizes(C.label_mask(burnt(spark, sf), limit=0)).withColumnRenamed("root", "label")


@query("remove_small", f"""with {_COMP}, s as (select image, label from cp group by all having count(*) >= 30)
select image, r::bigint as r, c::bigint as c from cp join s using (image, label)""")
def remove_small(spark, sf):
    return C.remove_small(cut_lineage(burnt(spark, sf)), 30).select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query("pixel_runs", f"""with {MASK}, g as (select image, r, c, c - row_number() over (partition by image, r order by c) as g from mask)
select image, r, min(c) as c0, max(c) as c1 from g group by image, r, g""")
def pixel_runs(spark, sf):
    return C.runs(burnt(spark, sf))


@query("fill_holes", f"""with recursive {PIXELS}, hole as (select image, r, c from px where v = 0), {_components_sql("hole", "h")},
s as (select image, label from cph group by all having count(*) < 5)
select px.image, px.r, px.c, (px.v > 0 or s.label is not null)::int as v from px left join cph using (image, r, c) left join s on s.image = cph.image and s.label = cph.label""")
def fill_holes(spark, sf):
    dense = I.pixels(spark, sf).withColumn("v", (F.col("v") > 0).cast("int"))
    return C.fill_holes(dense, "v", 5).select("image", "r", "c", "v")


@query("polygonize_shapes", f"""with {_COMP}, e as (select a.image, a.label, 4 - (select count(*) from cp b where b.image = a.image
 and ((abs(b.r - a.r) = 1 and b.c = a.c) or (abs(b.c - a.c) = 1 and b.r = a.r))) as sides from cp a)
select image, label, count(*)::double as area, sum(sides)::double as perimeter from e group by image, label""")
def polygonize_shapes(spark, sf):
    return PG.shape_stats(burnt(spark, sf))


@query("polygonize_rings", f"""with {_COMP} select image, label, count(*)::double as net_area, min(c)::double as xmin, min(r)::double as ymin,
 (max(c) + 1)::double as xmax, (max(r) + 1)::double as ymax from cp group by image, label""")
def polygonize_rings(spark, sf):
    """Areas and boxes recomputed from the traced vertices (holes count negative)."""
    rings = PG.polygonize(burnt(spark, sf), block=128).withColumn("b", G.bounds(F.col("ring")))
    return rings.groupBy("image", "label").agg(
        F.sum(G.signed_area(F.col("ring"))).alias("net_area"), F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"),
        F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


@query("mask_iou", f"""with recursive {MASK}, prd as (select scene, bid as pid, x0 + bid % 3 as x0, y0, x1 + bid % 3 as x1, y1 from bld),
prow as (select scene as image, x0, x1, unnest(range(y0, least(y1, 1000))) as r from prd),
pmask as (select distinct image, r::int as r, c::int as c from (select image, r, unnest(range(x0, least(x1, 1000))) as c from prow)),
{_components_sql()}, {_components_sql("pmask", "p")},
o as (select p.image, p.label as pred_label, t.label as truth_label, count(*) as n from cpp p join cp t using (image, r, c) group by all),
np as (select image, label, count(*) as n from cpp group by all), nt as (select image, label, count(*) as n from cp group by all)
select o.image, pred_label, truth_label, round(o.n / (np.n + nt.n - o.n), 6) as iou from o join np on np.image = o.image and np.label = o.pred_label
join nt on nt.image = o.image and nt.label = o.truth_label where o.n / (np.n + nt.n - o.n) >= 0.3""")
def mask_iou(spark, sf):
    """Overlap of predicted and true shapes from pixel counts."""
    p = _boxes(I.predicted_buildings(spark, sf)).select(
        F.col("scene").alias("image"), "pid", "ring", F.lit(I.PLANE).alias("width"), F.lit(I.PLANE).alias("height"))
    pred = C.components(burn.fill(p)).withColumnRenamed("label", "pred_label")
    truth = C.components(burnt(spark, sf)).withColumnRenamed("label", "truth_label")
    return SJ.mask_iou_pairs(pred.join(truth, ["image", "r", "c"], "full_outer"), 0.3).withColumn("iou", F.round("iou", 6))
