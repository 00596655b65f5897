"""File manifests: directories as tables, and copies driven by joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names as N
from ..operators.pairing import copy_once


def list_files(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``(path, name, stem, suffix, length, modificationTime)``. Only metadata columns are
    selected, so file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    p = F.col("path")
    return reader.load(folder).select("path", N.base_name(p).alias("name"), N.stem(p).alias("stem"),
                                      N.suffix(p).alias("suffix"), "length", "modificationTime")


def rasters(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """TIFF files of a folder (any letter case); a folder without any is an error."""
    found = list_files(spark, folder, recursive).where(F.col("suffix").isin(".tif", ".tiff"))
    if found.isEmpty():
        raise IOError(f"{folder} lists no .tif or .tiff file (GeoTIFF rasters are looked for by these endings).")
    return found


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """TIFF files directly in a folder; an empty result means "no content". The reader
    leaves out zero-length files, so they are never processed."""
    return list_files(spark, folder, recursive=False).where(F.col("suffix").isin(".tif", ".tiff"))


def empty_files(files: DataFrame) -> DataFrame:
    """Zero-length entries of a manifest that lists them (an inventory table)."""
    return files.where(F.col("length") == 0)


def relative(files: DataFrame, root: str) -> DataFrame:
    """Adds ``rel_path``: the path below ``root``."""
    return files.withColumn("rel_path", F.regexp_replace("path", r"^(file:/*)?" + root.strip("/").replace(".", r"\.") + "/*", ""))


def copy_files(spark: SparkSession, source: str, target: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows ``(rel_path, copied)`` after copying the files of ``source`` that are not in
    ``target``. The listing decides what to copy; names are dealt out, and each task reads and writes its own files, so no contents pass
    through a shuffle or the driver. Both must be folders all executors see; a file appears under its name only when it is
    whole, so a rerun task is safe."""
    src = relative(list_files(spark, source), source)
    todo = src if existing is None else copy_once(src, existing)

    def copy(batches):
        import os
        import shutil
        import uuid
        from pathlib import Path
        from urllib.parse import unquote, urlparse
        import pandas as pd
        for pdf in batches:
            for path, rel in zip(pdf["path"], pdf["rel_path"]):
                dest = Path(target) / rel
                dest.parent.mkdir(parents=True, exist_ok=True)
                part = dest.with_name(f".{dest.name}.{uuid.uuid4().hex}")
                shutil.copyfile(unquote(urlparse(path).path) if path.startswith("file:") else path, part)
                os.replace(part, dest)
            yield pd.DataFrame({"rel_path": pdf["rel_path"], "copied": True})

    return todo.select("path", "rel_path").repartition("path").mapInPandas(copy, "rel_path string, copied boolean")


def renamed(files: DataFrame, pattern: str, template: str) -> DataFrame:
    """New names from a pattern's groups (``$1`` style template)."""
    return files.withColumn("new_name", F.regexp_replace("name", pattern, template))
