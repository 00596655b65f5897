"""File-name and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def tile_name(image: Column, tile_r: Column, tile_c: Column) -> Column:
    return F.format_string("%s_r%d_c%d.TIF", image.cast("string"), tile_r, tile_c)


def upload_image_name(upload: Column) -> Column:
    """Image name of an uploaded file: what follows the first hyphen."""
    return F.regexp_replace(upload, r"^[^-]*-", "")


def pan_name(multispectral: Column) -> Column:
    return F.replace(multispectral, F.lit("M3DS"), F.lit("P3DS"))


def sharpened_name(multispectral: Column) -> Column:
    return F.replace(multispectral, F.lit("M3DS"), F.lit("PS3DS"))


def mask_path(image_path: Column) -> Column:
    return F.replace(image_path, F.lit("images"), F.lit("masks"))


def image_of_prediction(path: Column) -> Column:
    return F.regexp_replace(path, r"_predicted\.shp$", ".TIF")


def surface_key(stem_: Column) -> Column:
    """Surface-model file of an image: its last two name tokens; fewer is an error."""
    parts = F.split(stem_, "_")
    return F.when(F.size(parts) < 2, F.raise_error(F.concat(F.lit("Unexpected filename format: "), stem_))) \
            .otherwise(F.concat(F.element_at(parts, -2), F.lit("_"), F.element_at(parts, -1), F.lit("_elev.tif")))


def folder_code(path: Column) -> Column:
    """Code after the last underscore of a folder name."""
    return F.substring_index(path, "_", -1)


def trailing_number(name: Column) -> Column:
    """Last number in a name, for natural ordering."""
    return F.regexp_extract(name, r"(\d+)\D*$", 1).cast("long")


def run_stamp(ts: Column, zone: str = "Europe/Berlin") -> Column:
    """Minute stamp of a UTC time in a local zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyyMMdd-HHmm")


def seeded_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of a business key (independent of partitioning)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
