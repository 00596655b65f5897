"""Augmented tiles. Every random parameter is a hash of the tile key and a seed, so a
rerun on any partitioning gives the same tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixel as P
from ..skew import attach


def unit(seed: int, salt: str, *keys: str) -> Column:
    """Reproducible number in [0, 1) per key."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16 ** 12)


def flip(tiles: DataFrame, tile: int, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """Mirror pixels inside their tile (``r, c`` count from the tile corner)."""
    out = tiles
    if horizontal:
        out = out.withColumn("c", tile - 1 - F.col("c"))
    if vertical:
        out = out.withColumn("r", tile - 1 - F.col("r"))
    return out


def random_flip(tiles: DataFrame, tile: int, seed: int, *keys: str) -> DataFrame:
    h, v = unit(seed, "h", *keys) < 0.5, unit(seed, "v", *keys) < 0.5
    return tiles.withColumn("c", F.when(h, tile - 1 - F.col("c")).otherwise(F.col("c"))) \
        .withColumn("r", F.when(v, tile - 1 - F.col("r")).otherwise(F.col("r")))


def rotate_zoom(tiles: DataFrame, tile: int, seed: int, keys: tuple[str, ...], value: str = "v",
                max_rotate: float = 40.0, zoom: tuple[float, float] = (0.9, 1.6), warp: float = 0.1) -> DataFrame:
    """Random rotation, zoom and shear per tile: each output pixel looks up its source
    position (nearest); what falls outside the tile is NULL."""
    span = lambda salt, lo, hi: unit(seed, salt, *keys) * (hi - lo) + lo
    a, z, s = F.radians(span("rot", -max_rotate, max_rotate)), span("zoom", *zoom), span("warp", -warp, warp)
    mid = (tile - 1) / 2.0
    dx, dy = (F.col("c") - mid) / z, (F.col("r") - mid) / z
    sx = F.cos(a) * dx + F.sin(a) * dy + s * dy
    sy = -F.sin(a) * dx + F.cos(a) * dy
    at = tiles.select(*keys, "r", "c", F.round(sy + mid).cast("int").alias("_r"), F.round(sx + mid).cast("int").alias("_c"))
    src = tiles.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), value)
    return at.join(src, [*keys, "_r", "_c"], "left").drop("_r", "_c")


def normalize(df: DataFrame, value: str = "v", channel: str = "band", stats: DataFrame | None = None) -> DataFrame:
    """(v - mean) / std per channel; statistics come from the data when not given."""
    if stats is None:
        stats = df.groupBy(channel).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    out = attach(df, stats, [channel], [c for c in ("image", "r", "c") if c in df.columns])
    return out.withColumn(value, F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def jitter(df: DataFrame, seed: int, keys: tuple[str, ...], strength: float = 0.2) -> DataFrame:
    """Brightness, contrast, saturation and hue changes of 0..1 columns ``red, green, blue``."""
    pick = lambda salt: 1 + (unit(seed, salt, *keys) * 2 - 1) * strength
    bright, contrast, sat, hue = pick("b"), pick("c"), pick("s"), (unit(seed, "hue", *keys) * 2 - 1) * strength
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    grey = (r + g + b) / 3
    mixed = {"red": r + hue * (g - b), "green": g + hue * (b - r), "blue": b + hue * (r - g)}
    unit_clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return df.select(*[c for c in df.columns if c not in mixed], *[
        unit_clip(((grey + (v - grey) * sat) - 0.5) * contrast + 0.5 + (bright - 1)).alias(n) for n, v in mixed.items()])


def erase(df: DataFrame, tile: int, seed: int, keys: tuple[str, ...], value: str = "v", p: float = 0.5,
          size: float = 0.3, fill: float = 0.0) -> DataFrame:
    """With probability p a tile loses one random square."""
    side = F.floor(unit(seed, "side", *keys) * (tile * size)) + 1
    r0, c0 = F.floor(unit(seed, "r0", *keys) * tile), F.floor(unit(seed, "c0", *keys) * tile)
    inside = (unit(seed, "p", *keys) < p) & (F.col("r") >= r0) & (F.col("r") < r0 + side) \
        & (F.col("c") >= c0) & (F.col("c") < c0 + side)
    return df.withColumn(value, F.when(inside, F.lit(fill)).otherwise(F.col(value)))


def preview(df: DataFrame, value: str = "v", floating: bool = True) -> DataFrame:
    """Values scaled to 0..1 for display: by image range for floats, by 255 for bytes."""
    if not floating:
        return df.withColumn(value, F.col(value) / 255)
    rng = df.groupBy("image").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return attach(df, rng, ["image"], ["r", "c"]).withColumn(
        value, P.unit_range(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
