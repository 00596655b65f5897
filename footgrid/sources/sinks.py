"""Outputs: tiles, polygons, predictions and metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.geometry import let
from ..operators.pairing import missing

POLYGON_SCHEMA = "image long, label long, ring_id long, ring array<struct<x:double,y:double>>, area double"


def write_tiles(tiles: DataFrame, path: str, overwrite: bool = True, files_per_image: int = 8) -> None:
    """Packed tiles (image, mask and weight as columns or bands of the same rows, so names
    cannot diverge). An image's tiles go to ``files_per_image`` files at most, so a hot image is
    shared out and a small one is no litter of files; a rerun replaces only the images it holds."""
    share = F.pmod(F.xxhash64("tile_r", "tile_c"), F.lit(files_per_image))
    (tiles.repartition("image", share).write.mode("overwrite" if overwrite else "ignore")
     .option("partitionOverwriteMode", "dynamic").partitionBy("image").parquet(path))


def write_tile_parts(tiled: DataFrame, path: str, tile: int, batch: int, value: str = "v") -> None:
    """What one batch of pixels adds to its tiles: values and positions of each tile it touches, in a folder
    of the batch's own. A batch that runs again replaces its own folder and nothing else."""
    pos = ((F.col("r") % tile) * tile + F.col("c") % tile).cast("int")
    parts = tiled.groupBy("image", "tile_r", "tile_c").agg(
        F.sort_array(F.collect_list(F.struct(pos.alias("pos"), F.col(value).alias("v")))).alias("s"))
    (parts.select("image", "tile_r", "tile_c", F.col("s.v").alias("data"), F.col("s.pos").alias("pos"), F.lit(batch).cast("long").alias("batch"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def stored_tiles(spark: SparkSession, path: str, tile: int, complete: bool = True) -> DataFrame:
    """``(image, tile_r, tile_c, data)`` put together from all batches' parts, whatever the batches' borders: of a pixel
    that came twice the newest batch counts. ``complete`` leaves out tiles that still lack pixels."""
    parts = spark.read.parquet(path)
    valued = F.transform(F.arrays_zip("pos", "data"), lambda x: F.struct(x["pos"].alias("pos"), x["data"].alias("v")))
    met = parts.select("image", "tile_r", "tile_c", "batch", valued.alias("px")).groupBy("image", "tile_r", "tile_c").agg(
        F.collect_list(F.struct("batch", "px")).alias("parts"))
    every = F.flatten(F.transform("parts", lambda p: F.transform(p["px"], lambda x: F.struct(
        x["pos"].alias("pos"), (-p["batch"]).alias("age"), x["v"].alias("v")))))
    newest = let(F.array_sort(every), lambda s: F.filter(s, lambda x, i: (i == 0) | (s[F.greatest(i - 1, F.lit(0))]["pos"] != x["pos"])))
    joined = F.when(F.size("parts") == 1, F.transform(F.col("parts")[0]["px"], lambda x: x["v"])).otherwise(F.transform(newest, lambda x: x["v"]))
    out = met.select("image", "tile_r", "tile_c", joined.alias("data"))
    return out.where(F.size("data") == tile * tile) if complete else out


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_intermediate(mask: DataFrame, path: str | None) -> DataFrame:
    """Optional copy of an intermediate mask; the plan goes on from the written table."""
    if path is None:
        return mask
    mask.write.mode("overwrite").parquet(path)
    return mask.sparkSession.read.parquet(path)


def write_polygons(polys: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet polygons; an empty result leaves an empty table with its schema."""
    polys.write.mode(mode).parquet(path)


def empty_polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POLYGON_SCHEMA)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append to a metrics log; a missing or empty log is simply started."""
    metrics.withColumn("eval_ts", F.current_timestamp()).write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one when it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def not_yet_predicted(manifest: DataFrame, predictions: DataFrame, key: str = "image") -> DataFrame:
    """Images still to be scored: those without a stored prediction."""
    return missing(manifest, predictions, [key])
