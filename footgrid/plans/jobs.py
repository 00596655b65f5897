"""Whole jobs: the operators put together the way a user runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SegmentationParams, TilingParams, TrainParams, require_column
from ..functions import geometry as G, names as N, pixel as P
from ..operators import (blocks as BL, burn, metrics as M, mosaic as MO, pairing, polygonize as PG, resample, sampling, score, segment,
                         settlements as ST, spatial_join as SJ, stencil as S, tiling as T)
from ..session import cut_lineage
from ..skew import attach
from ..sources import tasks as TK


def prepare_tiles(bands: DataFrame, images: DataFrame, labels: DataFrame | None, params: TilingParams,
                  train: TrainParams | None = None) -> DataFrame:
    """Image bands plus polygon labels to packed training tiles.

    Input ``bands(image, band, r, c, v)``, ``images(image, width, height, t)``,
    ``labels(pid, ring, xmin..ymax)`` in world units. Output one row per tile with the
    RGB arrays, mask arrays (and weights) and, for training, ``is_test``. Images without
    any label are left out."""
    tile = params.tile_size
    rgb = cut_lineage(T.row_pieces(T.to_bytes(T.select_rgb(bands)), tile))     # a byte per pixel and band; no pixel is a row from here on
    size = rgb.agg(F.sum("n")).first()[0] or 0
    tasks = max(rgb.sparkSession.sparkContext.defaultParallelism, -(-size // PIXELS_PER_TASK))
    cut = T.cut(rgb, images, tile)
    if labels is not None:
        boxes = M.raster_bounds(images)
        hit = SJ.labels_in_images(boxes, labels.withColumnRenamed("pid", "bid"), _cell_of(boxes))
        polys = hit.withColumnRenamed("bid", "pid").join(labels.select("pid", "ring").hint("merge"), "pid")
        polys = burn.to_pixel_rings(polys, images)
        labelled = images.join(hit.select("image").distinct(), "image", "left_semi").select("image").distinct()
        frame = attach(rgb.select("image", "r", "c", "n"), labelled, ["image"], ["r", "c"], shuffle=True)
        tiles = burn.training_mask(frame, polys, params.shrink_factor, params.has_edge, params.erosion, params.distance_weighting, tasks=tasks, cut=cut, tile=tile)
    else:
        tiles = T.pack_pieces(cut, tile, tasks)
    name = N.tile_name(F.col("image"), F.col("tile_r"), F.col("tile_c")).alias("name")
    tiles = tiles.select(*T.TILE_KEYS, name, *[c for c in tiles.columns if c not in T.TILE_KEYS])
    if train is None:
        return tiles
    keys = cut.select(*T.TILE_KEYS).distinct()          # the tiles themselves are made once
    if labels is not None:
        keys = keys.join(labelled, "image", "left_semi")
    return sampling.split(tiles, "name", train.test_size, train.seed, cut_lineage(keys.select(name)))


PIXELS_PER_TASK = 1 << 22


def _cell_of(boxes: DataFrame, default: float = 512.0) -> float:
    """Grid cell of the label join: the usual image extent, so an image touches few cells."""
    row = boxes.agg(F.expr("percentile_approx(greatest(xmax - xmin, ymax - ymin), 0.5)").alias("m")).first()
    return float(row.m) if row and row.m else default


def labeling_sample(tiles: DataFrame, settlements: DataFrame, k: int, tile: float, seed: int = 2022,
                    key: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """Seeded sample of the tiles that touch a settlement."""
    return sampling.sample(SJ.tiles_in_settlements(tiles, settlements, tile, keys), key, k, seed)


def write_sample(tiles: DataFrame, picked: DataFrame, keys: list[str], path: str) -> None:
    """The picked tiles with their data and a preview scaled to 0..1, as a set of its own."""
    preview = G.let(F.greatest(F.array_max("data"), F.lit(1)), lambda peak: F.transform("data", lambda v: v / peak))
    # few of many tiles: those of other keys go before the join, which then has only the sample to send
    wanted = tiles.join(picked.select(*keys), keys, "left_semi").join(picked.hint("merge"), keys)
    wanted.withColumn("preview", preview).write.mode("overwrite").parquet(path)


def labels_from_tasks(tasks: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """World polygons of labelling tasks, and the tasks whose image is missing."""
    polys = TK.task_polygons(tasks)
    return TK.to_world(polys, images), pairing.missing(polys.select("id", "image_name").distinct(), images, ["image_name"])


def predict(tiles: DataFrame, load_model, tile: int, settlements: DataFrame | None = None,
            stored: DataFrame | None = None) -> DataFrame:
    """Scored tiles; stored predictions (``image, tile_r, tile_c, scores, error``) are
    reused and only the missing tiles are scored."""
    if stored is None:
        return score.score_in_settlements(tiles, load_model, tile, settlements)
    todo = tiles.join(stored.select("image", "tile_r", "tile_c"), ["image", "tile_r", "tile_c"], "left_anti")
    return stored.select("image", "tile_r", "tile_c", "scores", "error").unionByName(
        score.score_in_settlements(todo, load_model, tile, settlements))


def _pieces(tiles: DataFrame, load_model, tile: int, params: SegmentationParams, has_edge: bool, steps: list[tuple],
            stored: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Thresholded pieces of all tiles for a chain of steps, and the block size that they are cut for. Stored predictions are reused."""
    radius = max(BL.reach(steps), 1)
    block = BL.block_for(radius)
    if stored is not None:
        tiles = tiles.join(stored.select("image", "tile_r", "tile_c"), ["image", "tile_r", "tile_c"], "left_anti")
    pieces = BL.scored_pieces(tiles, load_model, tile, params, has_edge, block, radius)
    return (pieces if stored is None else pieces.unionByName(BL.stored_pieces(stored, tile, params, has_edge, block, radius))), block


def building_masks(tiles: DataFrame, load_model, tile: int, params: SegmentationParams, has_edge: bool = True,
                   stored: DataFrame | None = None) -> DataFrame:
    """Tiles to clean building masks as packed blocks (`blocks.pixels` unfolds them)."""
    steps = BL.clean_steps(params, vote=False)
    pieces, block = _pieces(tiles, load_model, tile, params, has_edge, steps, stored)
    return BL.chain(pieces, steps, block)


def map_from_images(tiles: DataFrame, load_model, tile: int, params: SegmentationParams,
                    images: DataFrame | None = None, has_edge: bool = True, stored: DataFrame | None = None) -> DataFrame:
    """Tiles to building polygons without settlements: one shuffle of packed pieces from the model to the rings."""
    steps = BL.clean_steps(params)
    pieces, block = _pieces(tiles, load_model, tile, params, has_edge, steps, stored)
    return segment.vectorize_rings(BL.rings(pieces, steps, block), params, images)


def map_settlements(tiles: DataFrame, load_model, tile: int, params: SegmentationParams, settlements: DataFrame,
                    primary_key: str, images: DataFrame | None = None, has_edge: bool = True) -> DataFrame:
    """Tiles to building polygons, each assigned to a settlement.

    ``settlements`` carries its key column, bounds and, for exact tests, a ``ring``: on the tiles' plane without ``images`` (and then
    may carry ``image`` to belong to one image), in world units with them. Only touched tiles are scored. With ``images (image, width, height,
    t, crs)``, settlements that share tiles form groups, and a group's tiles are laid on one mosaic, so that a building over a tile border or over
    two images comes out once; such polygons carry ``group``. Buildings keep the lowest settlement key they touch, one row per distinct geometry."""
    require_column(settlements, primary_key)
    if settlements.isEmpty():
        raise ValueError("map_settlements got a settlements table without rows.")
    aois = settlements.withColumnRenamed(primary_key, "aoi")
    if images is None:
        touched = SJ.tiles_in_settlements(tiles, aois, tile, ("image",) if "image" in aois.columns else ())
        _some(touched, primary_key)
        polys = map_from_images(touched, load_model, tile, params, None, has_edge)
        return assign_settlements(polys, aois, float(tile), ("image",)).withColumnRenamed("aoi", primary_key)
    place = T.georeference(tiles.select("image", "tile_r", "tile_c"), images, tile).withColumn(
        "tile_id", F.struct("image", "tile_r", "tile_c")).withColumn("ring", G.box_ring("xmin", "ymin", "xmax", "ymax"))
    cell = _cell_of(place)
    pairs = (SJ.ring_pairs(place, aois, "tile_id", "aoi", cell) if "ring" in aois.columns
             else SJ.box_pairs(place, aois, "tile_id", "aoi", cell)).withColumnRenamed("tile_id", "tile")
    _, grouped_tiles = MO.group_members(_some(cut_lineage(pairs), primary_key))
    on_mosaic, planes = MO.placed(tiles, grouped_tiles, place.select("tile_id", "t", "crs"))
    polys = map_from_images(on_mosaic, load_model, tile, params, planes, has_edge)
    polys = polys.withColumn("group", F.col("image.group")).drop("image")
    return assign_settlements(polys, aois, cell, ()).withColumnRenamed("aoi", primary_key)


def _some(hit: DataFrame, key: str) -> DataFrame:
    if hit.isEmpty():
        raise FileNotFoundError(f"No tile touches a settlement of '{key}': are tiles and settlements in one coordinate system?")
    return hit


def assign_settlements(polys: DataFrame, aois: DataFrame, cell: float, plane: tuple[str, ...] = ("image",)) -> DataFrame:
    """Building polygons joined to settlements, without geometric duplicates.

    ``plane`` names the columns that tell planes of coordinates apart: rings in pixels are equal only within one
    image, rings in world units wherever they are. Of equal geometries the one of the lowest image, label and
    ring number stays. Settlements with a ``ring`` are met exactly, others by their box; where they carry the plane's
    columns, only settlements of a building's own plane are met."""
    geometry = [*plane, "geom_key"]
    keyed = polys.withColumn("geom_key", G.ring_key(F.col("ring")))
    order = [c for c in ("image", "group", "label", "ring_id") if c in polys.columns and c not in plane]
    first = keyed.groupBy(*geometry).agg(F.min_by(F.struct(*[c for c in polys.columns if c not in plane]), F.struct(*order) if order else F.lit(0)).alias("_one"))
    b = SJ.with_bounds(cut_lineage(first.select(*geometry, "_one.*").select(*polys.columns, "geom_key")))
    shared = tuple(c for c in plane if c in aois.columns)
    b = b.withColumn("bid", F.struct(*[c for c in geometry if c not in shared]))
    hit = ST.assign(b, aois, cell, G.intersects if "ring" in aois.columns else None, shared)
    return b.join(hit.hint("merge"), [*shared, "bid"]).select(*polys.columns, "geom_key", "aoi")


def settlement_directions(polys: DataFrame, membership: DataFrame) -> DataFrame:
    """Shared building direction of each settlement group, from polygons with ``angle``."""
    return ST.settlement_angle(polys.join(membership, "geom_key"), ("group",))


def evaluate(truth: DataFrame, pred: DataFrame, iou_threshold: float = 0.5, digits: int = 3) -> DataFrame:
    """One row of pixel and building measures from ``truth(image, r, c, truth)`` and
    ``pred(image, r, c, pred)``; building overlap is counted in pixels."""
    from ..operators.components import components
    both = M.match_masks(truth, pred, ["image", "r", "c"])
    pixel = M.pixel_metrics(both, digits=digits)
    p = components(both.where("p = 1").select("image", "r", "c")).withColumnRenamed("label", "pred_label")
    t = components(both.where("g = 1").select("image", "r", "c")).withColumnRenamed("label", "truth_label")
    pairs = SJ.mask_iou_pairs(p.join(t, ["image", "r", "c"], "full_outer"), iou_threshold)
    tagged = (pairs.select(F.lit("m").alias("k"))
              .unionAll(p.select("image", "pred_label").distinct().select(F.lit("p").alias("k")))
              .unionAll(t.select("image", "truth_label").distinct().select(F.lit("t").alias("k"))))
    n = tagged.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(a) for k, a in
                     (("m", "n_matched"), ("p", "n_pred_buildings"), ("t", "n_truth_buildings"))])
    scored = n.select("*", M.ratio(F.col("n_matched"), F.col("n_pred_buildings"), digits).alias("building_precision"),
                      M.ratio(F.col("n_matched"), F.col("n_truth_buildings"), digits).alias("building_recall"))
    return pixel.withColumn("_one", F.lit(1)).join(scored.withColumn("_one", F.lit(1)), "_one").drop("_one")


def pansharpen_plan(scenes: DataFrame, finished: DataFrame) -> DataFrame:
    """Multispectral images still to be sharpened, with their panchromatic file."""
    ms = pairing.multispectral(scenes).select("name", "path")
    pan = scenes.where(F.col("name").contains("P3DS"))
    return pairing.to_do(pairing.pan_pairs(ms, pan), finished)


def pansharpen(ms: DataFrame, pan: DataFrame, plan: DataFrame, ratio: int, n_bands: int) -> DataFrame:
    """Sharpened bands of the images in the plan (``image`` names the scene)."""
    todo = plan.select(F.col("name").alias("image"))
    return resample.brovey(ms.join(todo, "image", "left_semi"), pan.join(todo, "image", "left_semi"), ratio, n_bands)


def detect_image(pixels: DataFrame, images: DataFrame, load_model, tile: int, lo: float = 2.0,
                 hi: float = 500000.0, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Single-pass service form: cut, score, check, reassemble, dilate, polygonise, filter.
    Returns the polygons and the tile completeness report; an image with missing or failed
    tiles gives no polygons."""
    scored = cut_lineage(score.score_tiles(T.pack(T.cut(pixels, images, tile), tile), load_model, tile))     # the report and the pixels read it
    report = T.completeness(scored.where("error is null"), images, tile)
    probs = score.probabilities(scored, tile).join(report.where("complete").select("image"), "image", "left_semi")
    mask = probs.select("image", "r", "c", P.is_predicted(F.col("building_prob"), threshold).alias("v"))
    rings = PG.polygonize(S.dilate(mask).where("v = 1").select("image", "r", "c"))
    polys = rings.where(~F.col("is_hole")).withColumn("area", G.area(F.col("ring")))
    return segment.area_filter(polys, lo, hi), report


def import_open_dataset(features: DataFrame, files: DataFrame, existing: DataFrame, images: DataFrame,
                        pattern: str, template: str) -> tuple[DataFrame, DataFrame]:
    """Open imagery with polygon labels: ``(files to copy under their new name, masks)``.

    ``features(code, pid, ring)`` pair with ``images(code, image, t, width, height)`` by folder code."""
    from ..sources.manifest import renamed
    todo = pairing.missing(renamed(files, pattern, template), existing, ["new_name"])
    polys = features.join(images.select("code", "image"), "code").select("image", "pid", "ring")
    return todo, burn.fill(burn.to_pixel_rings(polys, images))


def write_pairs(features: DataFrame, files: DataFrame, existing: DataFrame, images: DataFrame, pattern: str, template: str, tile: int, path: str) -> None:
    """Masks of open images, whole, in packed tiles beside the name that the image gets: ``(new_name, image, tile_r, tile_c, mask)``.

    ``files(image, name)`` says which file an image is; names that ``existing(new_name)`` has are left alone. ``features(code, pid, ring)`` pair with
    ``images(code, image, t, width, height)`` by folder code."""
    from ..sources.manifest import renamed
    todo = pairing.missing(renamed(files, pattern, template), existing, ["new_name"]).select("image", "new_name")
    wanted = images.join(todo.select("image"), "image", "left_semi")
    polys = features.join(wanted.select("code", "image"), "code").select("image", "pid", "ring")
    masks = BL.burn_tiles(burn.spans(burn.to_pixel_rings(polys, wanted)), wanted.select("image", "width", "height"), tile)
    masks.withColumnRenamed("data", "mask").join(todo, "image").write.mode("append").parquet(path)
