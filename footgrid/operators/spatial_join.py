"""Spatial joins as equi-joins on grid cells.

Both sides list the cells their bounding box touches, meet on the cell, and the
pair is kept only in the cell of its reference point (the larger lower corner), so
each pair appears once without a distinct. Only ids and boxes are shuffled; rings
are attached to the surviving pairs. A cell that is hot is split by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..skew import HOT_ROWS, hot_key_join

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_bounds(df: DataFrame, ring: str = "ring") -> DataFrame:
    return df.withColumn("_b", G.bounds(F.col(ring))).select(*df.columns, *[F.col(f"_b.{n}").alias(n) for n in BOX])


def _level(cell: float) -> Column:
    """How often the cell is doubled until it is as wide as the row's box."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.when(extent > cell, F.ceil(F.log2(extent / cell))).otherwise(0).cast("int")


def cells(df: DataFrame, cell: float, levels: list[int], own: str) -> DataFrame:
    """One row per grid cell ``(lv, cx, cy)`` that the row's box touches, at its own level and at the coarser ones of ``levels``: at most 3 x 3 each."""
    out = df.withColumn("lv", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(own))))
    size = F.pow(F.lit(2.0), F.col("lv")) * cell
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return out.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))


def box_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float,
              keys: tuple[str, ...] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(*keys, left_id, right_id)`` of all box pairs that share a point (touching counts).

    Every box belongs to the level of its size and also shows up in the ancestor cells of the levels that occur; two boxes
    meet at the larger one's level, so a country among houses makes a handful of rows, not one per cell it covers."""
    l = left.select(*keys, left_id, *[F.col(n).alias(f"l_{n}") for n in BOX], *BOX, _level(cell).alias("l_lv"))
    r = right.select(*keys, right_id, *[F.col(n).alias(f"r_{n}") for n in BOX], *BOX, _level(cell).alias("r_lv"))
    found = l.select(F.col("l_lv").alias("lv")).unionByName(r.select(F.col("r_lv").alias("lv"))).where("lv is not null").distinct()
    levels = sorted(x["lv"] for x in found.collect()) or [0]                     # a row per doubling of size, so a few dozen
    met = hot_key_join(cells(l, cell, levels, "l_lv").drop(*BOX), cells(r, cell, levels, "r_lv").drop(*BOX), [*keys, "lv", "cx", "cy"], [left_id], hot_rows)
    x, y = F.greatest("l_xmin", "r_xmin"), F.greatest("l_ymin", "r_ymin")
    size = F.pow(F.lit(2.0), F.col("lv")) * cell
    return met.where((F.col("lv") == F.greatest("l_lv", "r_lv")) & (x <= F.least("l_xmax", "r_xmax")) & (y <= F.least("l_ymax", "r_ymax"))
                     & (F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy"))
                     ).select(*keys, left_id, right_id)


def ring_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float,
               predicate=G.intersects, keys: tuple[str, ...] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs whose rings pass an exact predicate (both sides carry ``ring`` and bounds)."""
    pairs = box_pairs(left, right, left_id, right_id, cell, keys, hot_rows)
    lr = left.select(*keys, left_id, F.col("ring").alias("_lr"))
    rr = right.select(*keys, right_id, F.col("ring").alias("_rr"))
    return (pairs.join(lr.hint("merge"), [*keys, left_id]).join(rr.hint("merge"), [*keys, right_id])
            .where(predicate(F.col("_lr"), F.col("_rr"))).select(*keys, left_id, right_id))


# --- operators --------------------------------------------------------------

def tiles_touched(polys: DataFrame, tile: float, *carry: str | Column) -> DataFrame:
    """``(tile_r, tile_c)`` of every square tile a polygon shares a point with: its box picks tiles, and where there is a ``ring``
    it decides. The tile grid is the join grid, so no join is needed."""
    lo = lambda n: F.ceil(F.col(n) / tile) - 1  # noqa: E731  (a box on a tile line touches both tiles)
    hi = lambda n: F.floor(F.col(n) / tile)
    exact = "ring" in polys.columns
    out = polys.select(*carry, "xmin", "ymin", "xmax", "ymax", *([F.col("ring").alias("_ring")] if exact else []))
    out = (out.withColumn("tile_r", F.explode(F.sequence(F.greatest(lo("ymin"), F.lit(0)), hi("ymax"))))
            .withColumn("tile_c", F.explode(F.sequence(F.greatest(lo("xmin"), F.lit(0)), hi("xmax")))))
    if exact:
        # a polygon within one tile, or equal to its box, needs no test
        one = (lo("ymin") == hi("ymax")) & (lo("xmin") == hi("xmax"))
        box = F.abs(G.area(F.col("_ring")) - (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))) == 0
        square = G.box_ring(F.col("tile_c") * tile, F.col("tile_r") * tile, (F.col("tile_c") + 1) * tile, (F.col("tile_r") + 1) * tile)
        out = out.where(one | box | G.intersects(F.col("_ring"), square)).drop("_ring")
    return out.drop("xmin", "ymin", "xmax", "ymax")


def tiles_in_settlements(tiles: DataFrame, aois: DataFrame, tile: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tiles that share a point with any settlement (semi-join). Without any
    settlement there is no filter."""
    hit = tiles_touched(aois, tile, *keys).distinct()
    return tiles.join(hit, [*keys, "tile_r", "tile_c"], "left_semi")


def per_tile(buildings: DataFrame, tile: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Building count and mean confidence per touched tile (D1, D2)."""
    return tiles_touched(buildings, tile, *keys, "confidence").groupBy(*keys, "tile_r", "tile_c").agg(
        F.count(F.lit(1)).alias("n_buildings"), F.avg("confidence").alias("mean_confidence"))


def labels_in_images(images: DataFrame, labels: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(image, bid)``: labels that share a point with an image's bounding box; where labels have a ``ring``, it decides."""
    if "ring" not in labels.columns:
        return box_pairs(labels, images, "bid", "image", cell, keys)
    framed = images.withColumn("ring", G.box_ring("xmin", "ymin", "xmax", "ymax"))
    return ring_pairs(labels, framed, "bid", "image", cell, G.intersects, keys).select(*keys, "bid", "image")


def buildings_in_settlements(buildings: DataFrame, aois: DataFrame, cell: float,
                             keys: tuple[str, ...] = (), exact=None) -> DataFrame:
    """One row per distinct building geometry inside a settlement: lowest building id
    and lowest settlement key. Copies of a geometry collapse before the join."""
    geom = [*keys, *BOX] if exact is None else [*keys, "_gk", *BOX]
    src = buildings if exact is None else buildings.withColumn("_gk", G.ring_key(F.col("ring")))
    firsts = [F.min("bid").alias("bid")] + ([] if exact is None else [F.first("ring").alias("ring")])
    distinct = src.groupBy(*geom).agg(*firsts)
    pairs = (box_pairs(distinct, aois, "bid", "aoi", cell, keys) if exact is None
             else ring_pairs(distinct, aois, "bid", "aoi", cell, exact, keys))
    return pairs.groupBy(*keys, "bid").agg(F.min("aoi").alias("aoi"))


def iou_pairs(pred: DataFrame, truth: DataFrame, threshold: float, cell: float,
              keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct predicted and true boxes with IoU at or above the threshold.

    Equal boxes collapse to one row with a count before the join, so many copies of
    one footprint give one pair: ``(keys, pid, tid, n_pred, n_truth, iou)``."""
    def collapse(df, id_, n):
        return df.groupBy(*keys, *BOX).agg(F.min(id_).alias(id_), F.count(F.lit(1)).alias(n))
    p, t = collapse(pred, "pid", "n_pred"), collapse(truth, "tid", "n_truth")
    pairs = box_pairs(p, t, "pid", "tid", cell, keys)
    pb = p.select(*keys, "pid", "n_pred", F.struct(*BOX).alias("_p"))
    tb = t.select(*keys, "tid", "n_truth", F.struct(*BOX).alias("_t"))
    return (pairs.join(pb, [*keys, "pid"]).join(tb, [*keys, "tid"])
            .withColumn("iou", G.box_iou(F.col("_p"), F.col("_t"))).where(F.col("iou") >= threshold)
            .select(*keys, "pid", "tid", "n_pred", "n_truth", "iou"))


def ring_iou_pairs(pred: DataFrame, truth: DataFrame, threshold: float, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct predicted and true rings, concave ones too, with exact IoU at or above the threshold: ``(keys, pid, tid, n_pred, n_truth, iou)``.

    Equal rings collapse to one row with a count before the join; boxes pick the pairs that are measured."""
    def collapse(df, id_, n):
        return with_bounds(df.groupBy(*keys, G.ring_key(F.col("ring")).alias("_k")).agg(F.min(id_).alias(id_), F.first("ring").alias("ring"), F.count(F.lit(1)).alias(n)).drop("_k"))
    p, t = collapse(pred, "pid", "n_pred"), collapse(truth, "tid", "n_truth")
    pairs = box_pairs(p, t, "pid", "tid", cell, keys)
    pr, tr = p.select(*keys, "pid", "n_pred", F.col("ring").alias("_p")), t.select(*keys, "tid", "n_truth", F.col("ring").alias("_t"))
    met = G.materialize(pairs.join(pr, [*keys, "pid"]).join(tr, [*keys, "tid"]), "iou", G.iou(F.col("_p"), F.col("_t")))
    return met.where(F.col("iou") >= threshold).select(*keys, "pid", "tid", "n_pred", "n_truth", "iou")


def building_scores(pred: DataFrame, truth: DataFrame, threshold: float, cell: float,
                    keys: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Building precision and recall. Matches count pairs, so precision can pass 1;
    ``matched_pred`` and ``matched_truth`` count distinct boxes with a partner."""
    pairs = iou_pairs(pred, truth, threshold, cell, keys)
    n_pairs = pairs.select(F.lit("m").alias("k"), (F.col("n_pred") * F.col("n_truth")).alias("v"))
    mp = pairs.groupBy(*keys, "pid").agg(F.first("n_pred").alias("v")).select(F.lit("mp").alias("k"), "v")
    mt = pairs.groupBy(*keys, "tid").agg(F.first("n_truth").alias("v")).select(F.lit("mt").alias("k"), "v")
    np_ = pred.select(F.lit("p").alias("k"), F.lit(1).cast("long").alias("v"))
    nt = truth.select(F.lit("t").alias("k"), F.lit(1).cast("long").alias("v"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("long")
    s = n_pairs.union(mp).union(mt).union(np_).union(nt).agg(
        of("m").alias("n_pairs"), of("mp").alias("matched_pred"), of("mt").alias("matched_truth"),
        of("p").alias("n_pred"), of("t").alias("n_truth"))
    return s.select("*", F.round(F.try_divide(F.col("n_pairs").cast("double"), "n_pred"), digits).alias("building_precision"),
                    F.round(F.try_divide(F.col("n_pairs").cast("double"), "n_truth"), digits).alias("building_recall"))


def mask_iou_pairs(overlap: DataFrame, threshold: float, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """IoU of mask-born shapes from pixel counts: ``overlap(keys, r, c, pred_label,
    truth_label)`` with NULL where a mask has no component."""
    counts = overlap.groupBy(*keys, "pred_label", "truth_label").agg(F.count(F.lit(1)).alias("n"))
    p = counts.where("pred_label is not null").groupBy(*keys, "pred_label").agg(F.sum("n").alias("np"))
    t = counts.where("truth_label is not null").groupBy(*keys, "truth_label").agg(F.sum("n").alias("nt"))
    both = counts.where("pred_label is not null and truth_label is not null")
    return (both.join(p, [*keys, "pred_label"]).join(t, [*keys, "truth_label"])
            .withColumn("iou", F.col("n") / (F.col("np") + F.col("nt") - F.col("n")))
            .where(F.col("iou") >= threshold).select(*keys, "pred_label", "truth_label", "iou"))
