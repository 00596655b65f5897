"""Bands, tiles and mosaics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixel as P
from ..skew import attach

# fixed values: source bands shown as red, green, blue per band count
RGB_PROFILES = {
    "default": {3: (1, 2, 3), 4: (1, 2, 3), 8: (4, 2, 1), 1: (1, 1, 1)},
    "wv_named": {3: (1, 2, 3), 4: (1, 2, 3), 8: (5, 3, 2), 1: (1, 1, 1)},
}


def to_bytes(df: DataFrame, value: str = "v") -> DataFrame:
    return df.withColumn(value, P.to_byte(F.col(value)))


def select_rgb(df: DataFrame, n_bands: str = "n_bands", profile: str = "default") -> DataFrame:
    """Long-form bands to three output bands by the image's band count. One row per
    source band maps to the list of its output bands, so nothing is shuffled; a band
    count outside the profile is an error."""
    table = RGB_PROFILES[profile]
    known = F.col(n_bands).isin(list(table))
    targets = F.when(~known, F.raise_error(F.concat(F.lit("Unexpected number of bands: "), F.col(n_bands).cast("string"))))
    for count, picked in table.items():
        for src in sorted(set(picked)):
            out = [i + 1 for i, b in enumerate(picked) if b == src]
            targets = targets.when((F.col(n_bands) == count) & (F.col("band") == src), F.array(*map(F.lit, out)))
    return df.withColumn("band", F.explode(targets)).drop(n_bands)


def stack_bands(*bands: DataFrame) -> DataFrame:
    """Single-band tables to one long-form table, numbered from 1."""
    out = None
    for i, b in enumerate(bands, start=1):
        b = b.withColumn("band", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return out


def grid_size(images: DataFrame, tile: int) -> DataFrame:
    """Whole tiles per image; an image smaller than one tile is an error."""
    tx, ty = F.floor(F.col("width") / tile).cast("long"), F.floor(F.col("height") / tile).cast("long")
    return images.select("*", tx.alias("tiles_x"), ty.alias("tiles_y")).withColumn(
        "n_tiles", F.when((F.col("tiles_x") * F.col("tiles_y")) == 0, F.raise_error(F.concat(
            F.lit("tile_size is bigger than the input image "), F.col("image").cast("string"))).cast("long"))
        .otherwise(F.col("tiles_x") * F.col("tiles_y")))


def cut(pixels: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """Adds ``tile_r, tile_c`` and drops the right and bottom remainder. The tile is an
    expression over the pixel position; only the image sizes are looked up."""
    sizes = grid_size(images, tile).select("image", "tiles_x", "tiles_y", "n_tiles")
    out = attach(pixels, sizes, ["image"], ["r", "c"]).where(F.col("n_tiles") > 0)
    return (out.withColumn("tile_r", F.floor(F.col("r") / tile).cast("int"))
            .withColumn("tile_c", F.floor(F.col("c") / tile).cast("int"))
            .where((F.col("tile_r") < F.col("tiles_y")) & (F.col("tile_c") < F.col("tiles_x")))
            .drop("tiles_x", "tiles_y", "n_tiles"))


def pack(tiled: DataFrame, tile: int, value: str = "v", keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """One row per tile with its values in row-major order (tile * tile at most)."""
    pos = (F.col("r") % tile) * tile + F.col("c") % tile
    return (tiled.groupBy(*keys, "tile_r", "tile_c")
            .agg(F.sort_array(F.collect_list(F.struct(pos.cast("int").alias("pos"), F.col(value).alias("v")))).alias("s"))
            .select(*keys, "tile_r", "tile_c", F.transform("s", lambda s: s.v).alias("data")))


PIECE_ROWS = 1 << 20             # long-form rows that are made into pieces at a time


def row_pieces(pixels: DataFrame, tile: int, n_bands: int = 3) -> DataFrame:
    """Byte bands in long form ``(image, band, r, c, v)`` to pieces of pixel rows ``(image, r, c, n, band1.., gaps)``: a byte per pixel
    and band for ``n`` columns from ``c`` on within one tile column; of repeated values the largest counts. ``gaps``, where there are any, holds
    bit k for a pixel without a value of band k + 1. Nothing is shuffled: pixels that lie by row make long pieces, others short ones."""
    names = [f"band{k + 1}" for k in range(n_bands)]
    rows = pixels.select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("band").cast("int").alias("band"),
                         F.col("v").cast("int").alias("v")).where("image is not null and r is not null and c is not null")

    def pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        image = table.column("image").combine_chunks().dictionary_encode()
        code = image.indices.to_numpy()
        r, c, band = (table.column(k).to_numpy() for k in ("r", "c", "band"))
        v = pc.fill_null(table.column("v"), -1).to_numpy()

        def breaks() -> np.ndarray:
            step = np.diff(c)
            return np.concatenate([[True], (np.diff(code) != 0) | (np.diff(r) != 0) | (step < 0) | (step > 1) | (np.diff(c // tile) != 0)])

        new = breaks()
        if new.sum() * 16 > len(new):                   # in no order of rows
            order = np.lexsort((band, c, r, code))
            code, r, c, band, v = (a[order] for a in (code, r, c, band, v))
            new = breaks()
        slot = np.cumsum(new | np.concatenate([[True], np.diff(c) != 0])) - 1
        values = np.full((int(slot[-1]) + 1, n_bands), -1, np.int16)
        known = (band >= 1) & (band <= n_bands)
        place = (slot * n_bands + band - 1)[known]
        if (np.diff(place) > 0).all():
            values.ravel()[place] = v[known]
        else:
            np.maximum.at(values.ravel(), place, v[known].astype(np.int16))
        at = np.flatnonzero(new)
        first = slot[at]
        ends = np.append(first, len(values)).astype(np.int32)
        binary = lambda a, valid=None: pa.Array.from_buffers(pa.binary(), len(at), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a))])
        lost = values < 0
        gaps = (lost << np.arange(n_bands)).sum(1).astype(np.uint8)
        some = np.add.reduceat(gaps.astype(np.int64), first) > 0
        # a piece without a gap has none of them
        gap = binary(gaps) if some.any() else pa.nulls(len(at), pa.binary())
        gap = pc.if_else(pa.array(some), gap, pa.scalar(None, pa.binary()))
        body = np.where(lost, 0, values).astype(np.uint8)
        columns = [image.dictionary.take(pa.array(code[at])), pa.array(r[at]), pa.array(c[at]), pa.array(np.diff(ends)), *[binary(body[:, k]) for k in range(n_bands)], gap]
        return pa.RecordBatch.from_arrays(columns, ["image", "r", "c", "n", *names, "gaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PIECE_ROWS:
                yield pieces(held)
                held = []
        if held:
            yield pieces(held)

    return rows.mapInArrow(run, f"image {dict(rows.dtypes)['image']}, r long, c long, n int, {', '.join(f'{b} binary' for b in names)}, gaps binary")


def laid(group: pa.Table, tile: int, tile_r: int, tile_c: int, n_bands: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Which pixels of a tile its pieces have, and their bands ``(bands, tile, tile)``, -1 where a value is absent."""
    group = group.filter(pc.is_valid(group.column("band1")))
    r, c, n = (group.column(k).to_numpy().astype(np.int64) for k in ("r", "c", "n"))
    piece = np.repeat(np.arange(len(n)), n)
    place = (r[piece] - tile_r * tile) * tile + c[piece] - tile_c * tile + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    often = np.bincount(place, minlength=tile * tile)
    out = np.full((n_bands, tile * tile), -1, np.int16)
    gaps = [(k, g) for k, g in enumerate(group.column("gaps").to_pylist()) if g is not None] if group.column("gaps").null_count < len(n) else []
    begin = np.cumsum(n) - n
    for k in range(n_bands):
        v = np.frombuffer(b"".join(group.column(f"band{k + 1}").to_pylist()), np.uint8).astype(np.int16)
        for i, g in gaps:
            v[begin[i]: begin[i] + n[i]][np.frombuffer(g, np.uint8) >> k & 1 == 1] = -1
        if often.max(initial=0) > 1:
            np.maximum.at(out[k], place, v)
        else:
            out[k][place] = v
    return (often > 0).reshape(tile, tile), out.reshape(n_bands, tile, tile)


def band_columns(there: np.ndarray, bands: np.ndarray) -> dict[str, pa.Array]:
    """The bands of a tile's pixels in row-major order, each a list."""
    return {f"band{k + 1}": listed(v[there], v[there] < 0, pa.int32()) for k, v in enumerate(bands)}


def listed(values: np.ndarray, absent: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    body = pa.array(values, kind, mask=absent if absent is not None and absent.any() else None)
    return pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), body)


def pack_pieces(cut: DataFrame, tile: int, tasks: int | None = None) -> DataFrame:
    """Pieces in their tiles (see ``cut``) to packed tiles ``(image, tile_r, tile_c, band1, band2, band3)``, one row per tile."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        there, bands = laid(group, tile, key[1].as_py(), key[2].as_py())
        own = {k: pa.array([x.as_py()], group.schema.field(k).type) for k, x in zip(TILE_KEYS, key)}
        return pa.table(own | band_columns(there, bands))

    cut = cut.repartition(*([tasks] if tasks else []), *TILE_KEYS)
    return cut.groupBy(*TILE_KEYS).applyInArrow(run, f"image {dict(cut.dtypes)['image']}, tile_r int, tile_c int, band1 array<int>, band2 array<int>, band3 array<int>")


TILE_KEYS = ("image", "tile_r", "tile_c")


def unpack(tiles: DataFrame, tile: int, value: str = "v", keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Packed tiles back to pixels (reassembles the image)."""
    out = tiles.select(*keys, "tile_r", "tile_c", F.posexplode("data").alias("pos", value))
    return out.select(*keys, (F.col("tile_r") * tile + F.floor(F.col("pos") / tile)).cast("int").alias("r"),
                      (F.col("tile_c") * tile + F.col("pos") % tile).cast("int").alias("c"), value)


def completeness(tiles: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """Expected and present tiles per image."""
    have = tiles.select("image", "tile_r", "tile_c").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("n_found"))
    return (grid_size(images, tile).select("image", F.col("n_tiles").alias("n_expected"))
            .join(have, "image", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)).cast("long"))
            .withColumn("complete", F.col("n_found") == F.col("n_expected")))


def georeference(tiles: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """Adds each tile's affine, system name and world box from its image."""
    out = attach(tiles, images.select("image", "crs", "t"), ["image"], ["tile_r", "tile_c"])
    t = P.shift_affine(F.col("t"), F.col("tile_c") * tile, F.col("tile_r") * tile)
    x0, y0 = P.to_world(F.lit(0), F.lit(0), F.col("t"))
    x1, y1 = P.to_world(F.lit(tile), F.lit(tile), F.col("t"))
    return out.withColumn("t", t).select("*", F.least(x0, x1).alias("xmin"), F.least(y0, y1).alias("ymin"),
                                         F.greatest(x0, x1).alias("xmax"), F.greatest(y0, y1).alias("ymax"))


def mosaic(pixels: DataFrame, order: str, value: str = "v", scene: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping georeferenced tiles to one grid: the first tile in ``order`` wins.
    Input ``(*scene, order, r, c, t, value)``; output cells are world pixel indices."""
    x, y = P.to_world(F.col("c") + 0.5, F.col("r") + 0.5, F.col("t"))
    size = F.abs(F.col("t.a"))
    return (pixels.groupBy(*scene, F.floor(-y / size).alias("r"), F.floor(x / size).alias("c"))
            .agg(F.min_by(value, order).alias(value)))


def natural_order(name: Column) -> list[Column]:
    """Sort keys that put ``t2`` before ``t10``."""
    from ..functions.names import trailing_number
    return [trailing_number(name), name]
