"""Polygons to pixels: filled masks, outlines, overlays and weights.

Work is spread by ring edge and by scan line, never by whole polygon, so one huge
polygon is many small rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions import pixel as P
from ..session import cut_lineage
from ..skew import attach
from . import stencil as S, tiling as T


def to_pixel_rings(polys: DataFrame, images: DataFrame, truncate: bool = False) -> DataFrame:
    """World rings to pixel coordinates of their image; ``truncate`` cuts to whole pixels."""
    p = attach(polys, images.select("image", "t", "width", "height"), ["image"], ["pid"], shuffle=True)
    cut = (lambda v: v.cast("int").cast("double")) if truncate else (lambda v: v)
    ring = G.map_points(F.col("ring"), lambda x, y: cut(P.to_pixel(x, y, F.col("t"))[0]),
                        lambda x, y: cut(P.to_pixel(x, y, F.col("t"))[1]))
    return p.withColumn("ring", ring).drop("t")


def spans(polys: DataFrame) -> DataFrame:
    """Pixel runs ``(image, r, a, b)``, columns ``a`` up to but not ``b``, whose centres lie in a ring ``(image, pid, ring, width,
    height)`` (half-open on the right and bottom); exterior rings only. Runs of different rings may overlap.

    Each edge reports where it crosses the centre line of each pixel row; the sorted
    crossings of a row pair up to spans."""
    e = polys.select("image", "pid", "width", "height", F.explode(G.edges(F.col("ring"))).alias("e"))
    lo, hi = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    first = F.greatest(F.ceil(lo - 0.5), F.lit(0))
    last = F.least(F.ceil(hi - 0.5), F.col("height")) - 1
    e = e.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x = F.col("e.x1") + (F.col("r") + 0.5 - F.col("e.y1")) * (F.col("e.x2") - F.col("e.x1")) / (F.col("e.y2") - F.col("e.y1"))
    rows = e.groupBy("image", "pid", "r").agg(F.array_sort(F.collect_list(x)).alias("xs"), F.first("width").alias("width"))
    xs = F.col("xs")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1),
                        lambda i: F.struct(F.greatest(F.ceil(xs[2 * i] - 0.5), F.lit(0)).alias("a"),
                                           F.least(F.ceil(xs[2 * i + 1] - 0.5), F.col("width")).alias("b")))
    return (rows.where(F.size(xs) > 1).select("image", "r", F.explode(pairs).alias("s")).where("s.a < s.b")
            .select("image", F.col("r").cast("int").alias("r"), F.col("s.a").cast("int").alias("a"), F.col("s.b").cast("int").alias("b")))


def fill_words(polys: DataFrame) -> DataFrame:
    """The runs of ``spans`` as words of pixels (see ``stencil``)."""
    return S.word_runs(spans(polys))


def fill(polys: DataFrame) -> DataFrame:
    """Pixels ``(image, r, c)`` of the runs of ``spans``, each once."""
    return S.from_words(fill_words(polys))


def outline(polys: DataFrame) -> DataFrame:
    """Pixels ``(image, r, c)`` under ring boundaries: each edge in unit steps along its
    longer axis."""
    return S.from_words(outline_words(polys))


def outline_words(polys: DataFrame) -> DataFrame:
    """The pixels of ``outline`` as words."""
    e = polys.select("image", "width", "height", F.explode(G.edges(F.col("ring"))).alias("e"))
    dx, dy = F.col("e.x2") - F.col("e.x1"), F.col("e.y2") - F.col("e.y1")
    n = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy))), F.lit(1))
    pts = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    r = F.floor(F.col("e.y1") + dy * F.col("i") / F.col("n"))
    c = F.floor(F.col("e.x1") + dx * F.col("i") / F.col("n"))
    inside = (pts.select("image", r.cast("int").alias("r"), c.cast("int").alias("c"), "width", "height")
            .where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("height")) & (F.col("c") < F.col("width"))))
    return S.to_words(inside)


def on_raster(frame: DataFrame, *layers: tuple[str, DataFrame], on: int = 255, tasks: int | None = None) -> DataFrame:
    """Dense 0/``on`` columns from sparse layers of words: the frame ``(image, r, c)`` and the layers meet in one aggregate of
    words instead of a join per layer. A frame that lies by ``image, r`` stays where it is until it is words, a 64th of its pixels.
    ``tasks`` is the number of tasks that unpack them; without it their bytes decide, which are few."""
    names = [n for n, _ in layers]
    none = F.lit(0).cast("long")
    words = S.to_words(frame).select("image", "r", "w", F.col("bits").alias("_there"), *[none.alias(n) for n in names])
    for n, layer in layers:
        words = words.unionByName(layer.select("image", "r", "w", none.alias("_there"), *[
            (F.col("bits") if m == n else none).alias(m) for m in names]))
    if tasks:
        words = words.repartition(tasks, "image", "r")
    words = S.merged(words, "_there", *names)
    bit = lambda n: F.call_function("getbit", n, F.col("_i")) == 1
    any_ = reduce(Column.bitwiseOR, [F.col(n) for n in names], F.col("_there"))
    lost = F.col("w").isNull()                      # frame rows without a column
    places = F.when(lost, F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(S.WORD - 1)))
    each = words.select("*", any_.alias("_any"), F.explode(places).alias("_i")).where(lost | bit(F.col("_any")))
    return each.select("image", "r", (F.col("w") * S.WORD + F.col("_i")).alias("c"), *[F.when(bit(F.col(n)), on).otherwise(0).alias(n) for n in names])


def training_layers(polys: DataFrame, shrink: float, edge: bool, erosion: bool, weights: bool) -> list[tuple[str, DataFrame]]:
    """The layers of ``training_mask`` as words: building, edge, and the outlines that weights are made from."""
    if shrink != 1.0:
        polys = polys.withColumn("ring", G.scale(F.col("ring"), shrink))
    building = fill_words(polys)
    lines = outline_words(polys) if edge or weights else None
    border = lines
    if erosion:
        sizes = polys.groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"))
        building = S.shrink_words(building, S.square(3), sizes)
        border = S.spread_words(lines, S.square(3), sizes) if edge else None
    return [("building", building)] + ([("edge", border)] if edge else []) + ([("weight", lines)] if weights else [])


def training_mask(frame: DataFrame, polys: DataFrame, shrink: float = 1.0, edge: bool = False,
                  erosion: bool = True, weights: bool = False, block: int = S.BLOCK, tasks: int | None = None,
                  cut: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """``(image, r, c, building[, edge][, weight])`` for training.

    Polygons may shrink about their centroid; erosion thins the building mask and
    widens the edge mask (only when there is one), both on the burnt pixels before they
    meet the raster; an edge pixel is no building pixel.
    Weights are the blurred boundary, scaled so that each image peaks at 1. ``tasks``: see ``on_raster``.

    With ``cut`` no pixel is a row: the frame is pieces of pixel rows (`tiling.row_pieces`), ``cut`` the same pieces in their tiles of ``tile``
    pixels a side (`tiling.cut`), masks meet them as words, and the result is packed tiles ``(image, tile_r, tile_c, band1, band2, band3,
    building[, edge][, weight])`` of what both the frame and the tiles hold."""
    layers = training_layers(polys, shrink, edge, erosion, weights)
    if cut is not None:
        return _mask_tiles(frame, cut, layers, tile, tasks)
    m = on_raster(frame, *layers, tasks=tasks)
    if weights:
        m = m.withColumn("weight", (F.col("weight") / 255).cast("double"))
        m = S.core(S.gauss_pass(S.halo_blocks(m, 4, block=block), "weight"), block)
    if edge:
        m = m.withColumn("building", P.carve_edges(F.col("building"), F.col("edge")))
    if weights:
        peak = m.groupBy("image").agg(F.max("weight").alias("_peak"))
        m = attach(m, peak, ["image"], ["r", "c"]).withColumn("weight", F.try_divide("weight", F.col("_peak"))).drop("_peak")
    return m


HALO = len(S.gauss_kernel(0.5)) - 1


def _windows(group: pa.Table, names: list[str], tile: int, tile_r: int, tile_c: int) -> np.ndarray:
    """The layers ``(names, tile + 2 HALO, tile + 2 HALO)`` around a tile from the words of its window."""
    side, top, left = tile + 2 * HALO, tile_r * tile - HALO, tile_c * tile - HALO
    group = group.filter(pc.is_valid(group.column("w")))
    w0 = left // S.WORD
    out = np.zeros((len(names), side, -(-(left + side) // S.WORD) - w0, S.WORD), bool)
    at, w = group.column("r").to_numpy() - top, group.column("w").to_numpy() - w0
    for k, n in enumerate(names):
        bits = group.column(n).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
        out[k, at, w] = np.unpackbits(bits, axis=1, bitorder="little")
    return out.reshape(len(names), side, -1)[:, :, left - w0 * S.WORD:][:, :, :side]


def _blurred(layers: np.ndarray) -> np.ndarray:
    """Weights of a tile before they are scaled, from the layers around it; the last one holds the outlines. Absent pixels are NaN."""
    return S.gauss_array(np.where(layers.any(0), layers[-1].astype(float), np.nan))[HALO:-HALO, HALO:-HALO]


def _mask_tiles(frame: DataFrame, cut: DataFrame, layers: list[tuple[str, DataFrame]], tile: int, tasks: int | None, on: int = 255) -> DataFrame:
    """``training_mask`` over pieces. Words go to the windows of the tiles that see them; a first pass over them finds each image's
    largest weight, a second one, with the pieces, makes the tiles. Blurring twice is little work beside writing every weight down."""
    names, kind = [n for n, _ in layers], dict(frame.dtypes)["image"]
    none = F.lit(0).cast("long")
    words = S.word_runs(frame.select("image", F.col("r"), F.col("c").alias("a"), (F.col("c") + F.col("n")).alias("b")))
    words = words.select("image", "r", "w", F.col("bits").alias("_there"), *[none.alias(n) for n in names])
    for n, layer in layers:
        words = words.unionByName(layer.select("image", F.col("r").cast("long").alias("r"), "w", none.alias("_there"), *[(F.col("bits") if m == n else none).alias(m) for m in names]))
    names = ["_there", *names]
    words = cut_lineage(S.merged(words, *names))
    seen = lambda low, high: F.explode(F.sequence(F.floor((low - HALO) / tile).cast("int"), F.floor((high + HALO) / tile).cast("int")))
    first = F.col("w") * S.WORD
    windows = words.withColumn("tile_r", seen(F.col("r"), F.col("r"))).withColumn("tile_c", seen(first, first + S.WORD - 1))
    spread = lambda df: df.repartition(*([tasks] if tasks else []), *T.TILE_KEYS).groupBy(*T.TILE_KEYS)
    rows = cut.unionByName(windows, allowMissingColumns=True)
    keys = f"image {kind}, tile_r int, tile_c int"
    own = lambda key, group: {k: pa.array([x.as_py()], group.schema.field(k).type) for k, x in zip(T.TILE_KEYS, key)}

    def highest(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        there = _windows(group, names, tile, key[1].as_py(), key[2].as_py())
        got = _blurred(there)
        return pa.table(own(key, group) | {"peak": pa.array([None if np.isnan(got).all() else float(np.nanmax(got))], pa.float64())})

    if "weight" in names:
        tops = spread(windows).applyInArrow(highest, f"{keys}, peak double")
        tops = cut_lineage(tops)
        peaks = attach(tops.drop("peak"), tops.groupBy("image").agg(F.max("peak").alias("peak")), ["image"], ["tile_r", "tile_c"])
        rows = rows.unionByName(peaks, allowMissingColumns=True)

    def masked(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tile_r, tile_c = key[1].as_py(), key[2].as_py()
        there, bands = T.laid(group, tile, tile_r, tile_c)
        around = _windows(group, names, tile, tile_r, tile_c)
        core = dict(zip(names, around[:, HALO:-HALO, HALO:-HALO]))
        there &= core["_there"]
        building = core["building"] & ~core["edge"] if "edge" in core else core["building"]
        out = {n: np.where(m[there], on, 0) for n, m in (("building", building), ("edge", core.get("edge"))) if m is not None}
        made = own(key, group) | T.band_columns(there, bands) | {n: T.listed(v, None, pa.int32()) for n, v in out.items()}
        if "weight" in core:
            peak = pc.max(group.column("peak")).as_py()
            weight = _blurred(around)[there] / peak if peak else np.full(int(there.sum()), np.nan)
            made["weight"] = T.listed(weight, np.isnan(weight), pa.float64())
        return pa.table(made).slice(0, int(there.any()))

    columns = [f"band{k} array<int>" for k in (1, 2, 3)] + [f"{n} array<{'double' if n == 'weight' else 'int'}>" for n in names[1:]]
    return spread(rows).applyInArrow(masked, f"{keys}, {', '.join(columns)}")


def distance_weights(dense: DataFrame, value: str = "v", sigma: float = 0.5, block: int = S.BLOCK, tasks: int | None = None) -> DataFrame:
    """Gaussian weights of a 0/1 boundary raster, divided by the image maximum."""
    g = S.gauss(dense.withColumn(value, F.col(value).cast("double")), value, sigma, block=block, tasks=tasks)
    peak = g.groupBy("image").agg(F.max(value).alias("_peak"))
    return attach(g, peak, ["image"], ["r", "c"]).withColumn(value, F.try_divide(F.col(value), F.col("_peak"))).drop("_peak")


def overlay(rgb: DataFrame, polys: DataFrame, colour: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    """RGB pixels ``(image, r, c, red, green, blue)`` with polygon outlines drawn in.

    The outlines meet the pixels as one row of 64-column words per pixel row, so pixels that lie by ``image, r`` stay where they are. The
    join is told to shuffle: outlines count as the few bytes of their polygons, and would be broadcast whole."""
    word, bit = F.floor(F.col("c") / 64).cast("int"), F.pmod("c", F.lit(64)).cast("int")
    words = outline(polys).groupBy("image", "r", word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    lines = words.groupBy("image", "r").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("_on"))
    out = rgb.join(lines.hint("shuffle_hash"), ["image", "r"], "left")
    hit = F.call_function("getbit", F.try_element_at("_on", word), bit) == 1
    for name, value in zip(("red", "green", "blue"), colour):
        out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return out.select("image", "r", "c", *[n for n in rgb.columns if n not in ("image", "r", "c")])
