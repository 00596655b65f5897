"""Moving rasters to other grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import crs as K
from ..functions import pixel as P
from ..skew import attach


def resample(source: DataFrame, source_images: DataFrame, target: DataFrame, target_images: DataFrame,
             value: str = "v", source_crs: str = "", target_crs: str = "") -> DataFrame:
    """Nearest-neighbour values of ``source`` on the pixel grid of ``target``.

    Each target pixel centre maps back to a source pixel: both affines are looked up
    per image, then one equi-join on the source position. Pixels outside the source
    are NULL."""
    t = attach(target.select("image", "r", "c"), target_images.select("image", F.col("t").alias("_tt")), ["image"], ["r", "c"])
    t = attach(t, source_images.select("image", F.col("t").alias("_st")), ["image"], ["r", "c"])
    x, y = P.to_world(F.col("c") + 0.5, F.col("r") + 0.5, F.col("_tt"))
    x, y = K.transform_xy(x, y, target_crs, source_crs)
    sc, sr = P.to_pixel(x, y, F.col("_st"))
    at = t.select("image", "r", "c", F.floor(sr).cast("long").alias("_sr"), F.floor(sc).cast("long").alias("_sc"))
    src = source.select("image", F.col("r").cast("long").alias("_sr"), F.col("c").cast("long").alias("_sc"), value)
    return at.join(src, ["image", "_sr", "_sc"], "left").drop("_sr", "_sc")


def brovey(ms: DataFrame, pan: DataFrame, ratio: int, n_bands: int, weights: list[float] | None = None) -> DataFrame:
    """Pan-sharpened bands ``(image, band, r, c, v)``: each multispectral band times the
    panchromatic value over the (weighted) mean of the bands at the parent pixel.

    The bands of a coarse pixel fold into one array row first, so the fine grid joins
    once instead of once per band."""
    w = weights or [1.0 / n_bands] * n_bands
    coarse = ms.groupBy("image", F.col("r").alias("pr"), F.col("c").alias("pc")).agg(
        F.array_sort(F.collect_list(F.struct("band", F.col("v").cast("double").alias("v")))).alias("bands"))
    mean = sum((F.col("bands")[i].v * w[i] for i in range(n_bands)), F.lit(0.0))
    coarse = coarse.withColumn("mean", mean)
    fine = pan.select("image", "r", "c", F.col("v").alias("pan"), F.floor(F.col("r") / ratio).cast("int").alias("pr"),
                      F.floor(F.col("c") / ratio).cast("int").alias("pc"))
    joined = fine.join(coarse, ["image", "pr", "pc"])
    out = joined.select("image", "r", "c", "pan", "mean", F.explode("bands").alias("b"))
    return out.select("image", F.col("b.band").alias("band"), "r", "c",
                      F.try_divide(F.col("b.v") * F.col("pan"), F.col("mean")).alias("v"))
