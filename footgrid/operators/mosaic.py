"""Mosaics of settlement groups: the tiles of a group on one world grid, whatever images they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import pixel as P
from ..session import cut_lineage
from ..skew import attach
from . import settlements as ST


def group_members(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(aoi, group)`` and ``(group, tile)`` from the pairs ``(tile, aoi)`` that touch: settlements sharing a tile are one group, so a tile has one."""
    pairs = cut_lineage(pairs.select("tile", "aoi"))
    grouped = cut_lineage(ST.groups(pairs))
    return grouped, ST.group_tiles(grouped, pairs)


def placed(tiles: DataFrame, grouped_tiles: DataFrame, georeferenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles with their ``place`` on their group's plane, and the planes ``(image, t, crs)``.

    ``georeferenced(tile_id, t, crs)`` holds the tiles' affines (north up). A plane is a group's pixels of one size and coordinate system; its
    first row and column are the least of its tiles, so pixel codes stay small, and each group is a plane of its own. Of overlapping
    tiles the first by image and place counts."""
    size = F.col("t.a")
    where = georeferenced.join(grouped_tiles.withColumnRenamed("tile", "tile_id").hint("merge"), "tile_id").select(
        F.col("tile_id"), F.struct("group", size.alias("size"), "crs").alias("image"), F.round(-F.col("t.f") / size).cast("long").alias("wr"), F.round(F.col("t.c") / size).cast("long").alias("wc"))
    where = cut_lineage(where)
    origins = cut_lineage(where.groupBy("image").agg(F.min("wr").alias("r0"), F.min("wc").alias("c0")))
    at = attach(where, origins, ["image"], ["tile_id"]).select("tile_id.*", F.struct(
        "image", (F.col("wr") - F.col("r0")).cast("int").alias("r"), (F.col("wc") - F.col("c0")).cast("int").alias("c"), F.col("tile_id").alias("rank")).alias("place"))
    s = F.col("image.size")
    planes = origins.select("image", P.affine(s, 0, F.col("c0") * s, 0, -s, -F.col("r0") * s).alias("t"), F.col("image.crs").alias("crs"))
    return tiles.join(at.hint("merge"), ["image", "tile_r", "tile_c"]), planes      # tiles pack to little: by that size they would be broadcast
