"""Tiles and quality figures that arrive over time. Each operator is an ordinary
DataFrame transformation, so its batch form gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import pixel_metrics


def read_pixels(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Pixel files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest_tiles(stream: DataFrame, images: DataFrame, tile: int, out: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Cut newly arrived pixels and store them once. A batch writes the parts of tiles that it holds to a folder of
    its own and overwrites only that folder when it runs again after a failure, so where batches
    end makes no difference; ``sources.sinks.stored_tiles`` puts the tiles together."""
    from ..operators.tiling import cut
    from ..sources.sinks import write_tile_parts

    def one_batch(batch: DataFrame, number: int) -> None:
        write_tile_parts(cut(batch, images, tile), out, tile, number)

    w = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _timed(df: DataFrame, delay: str) -> DataFrame:
    """Watermarked input. Watermarks need a time with zone; the batch form keeps its type."""
    if df.isStreaming:
        return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return df


def _windowed(df: DataFrame, window, by: tuple[str, ...], digits: int) -> DataFrame:
    out = pixel_metrics(df, (window.alias("w"), *by), digits)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                      *[c for c in out.columns if c != "w"])


def quality_tumbling(df: DataFrame, size: str = "1 hour", by: tuple[str, ...] = (), delay: str = "1 hour",
                     digits: int = 6) -> DataFrame:
    """Pixel metrics per fixed window; late rows count until the watermark passes."""
    return _windowed(_timed(df, delay), F.window("ts", size), by, digits)


def quality_sliding(df: DataFrame, size: str = "1 hour", slide: str = "30 minutes", by: tuple[str, ...] = (),
                    delay: str = "1 hour", digits: int = 6) -> DataFrame:
    return _windowed(_timed(df, delay), F.window("ts", size, slide), by, digits)


def quality_sessions(df: DataFrame, gap: str = "30 minutes", by: tuple[str, ...] = ("image",), delay: str = "1 hour",
                     digits: int = 6) -> DataFrame:
    """Pixel metrics per burst of arrivals of one image."""
    return _windowed(_timed(df, delay), F.session_window("ts", gap), by, digits)


def dedupe_arrivals(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First announcement per key; state is bounded by the watermark."""
    if df.isStreaming:
        return _timed(df, delay).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)
