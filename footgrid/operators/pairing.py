"""Matching files and tiles by name: joins on computed keys and their missing sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import names as N
from ..skew import attach


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def present(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with a partner."""
    return left.join(right.select(*on).distinct(), on, "left_semi")


def completeness(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer check of two name sets: ``(on, in_left, in_right)``."""
    l = left.select(*on).distinct().withColumn("in_left", F.lit(True))
    r = right.select(*on).distinct().withColumn("in_right", F.lit(True))
    return l.join(r, on, "full_outer").select(*on, F.coalesce("in_left", F.lit(False)).alias("in_left"),
                                              F.coalesce("in_right", F.lit(False)).alias("in_right"))


def multispectral(scenes: DataFrame) -> DataFrame:
    """TIFF files, each once, whose path names a multispectral image."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1)).isin(".tif", ".tiff")
    return scenes.where(ext & F.col("path").contains("M3DS")).distinct()


def pan_pairs(ms: DataFrame, pan: DataFrame) -> DataFrame:
    """``(name, ms_path, pan_path, out_name)``: each multispectral image with the first
    panchromatic file of its renamed key."""
    first = pan.groupBy(F.col("name").alias("pan_name")).agg(F.min("path").alias("pan_path"))
    return ms.select("name", F.col("path").alias("ms_path"), N.pan_name(F.col("name")).alias("pan_name"),
                     N.sharpened_name(F.col("name")).alias("out_name")).join(first, "pan_name").drop("pan_name")


def to_do(pairs: DataFrame, finished: DataFrame, on: str = "out_name") -> DataFrame:
    """Pairs whose output does not exist yet."""
    return missing(pairs, finished, [on])


def with_surface(images: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Images with their surface model by the last two name tokens."""
    s = surfaces.select(F.col("name").alias("surface_name"), F.col("path").alias("surface_path"))
    return images.withColumn("surface_name", N.surface_key(F.col("stem"))).join(s, "surface_name", "left")


def required(images: DataFrame, parts: DataFrame, on: list[str], what: str) -> DataFrame:
    """Inner join that fails the job at the first image without its part."""
    marked = images.join(parts.withColumn("_has", F.lit(True)), on, "left")
    fail = F.raise_error(F.concat(F.lit(f"Couldn't find corresponding {what} file for "), F.col(on[0]).cast("string")))
    return marked.withColumn("_has", F.when(F.col("_has"), True).otherwise(fail.cast("boolean"))).where("_has").drop("_has")


def polygon_images(polygon_files: DataFrame, images: DataFrame) -> DataFrame:
    """Prediction polygon files with the image they were made from."""
    return polygon_files.withColumn("name", N.image_of_prediction(F.col("file"))).join(images, "name")


def copy_once(source: DataFrame, existing: DataFrame, on: str = "rel_path") -> DataFrame:
    """Files to copy: those whose relative path is not there yet."""
    return missing(source, existing, [on])


def exclude(files: DataFrame, *patterns: str, name: str = "name") -> DataFrame:
    """Files whose name contains none of the patterns."""
    for p in patterns:
        files = files.where(~F.col(name).contains(p))
    return files


def tiles_of_names(grouped: DataFrame, tiles: DataFrame, names: str = "names") -> DataFrame:
    """Tiles of each group from its list of tile names."""
    return attach(grouped.select("group", F.explode(names).alias("name")), tiles, ["name"], ["group"])


def concat_frames(*frames: DataFrame) -> DataFrame:
    """Stack label tables whose columns differ (absent columns are NULL) without full duplicates."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates()
