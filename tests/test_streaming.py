"""Streams give the rows of their batch form."""

import pytest
from pyspark.sql import functions as F

from footgrid.operators import tiling as T
from footgrid.plans import inputs as I
from footgrid.sources import sinks
from footgrid.streaming import streams as ST


def arrivals_stream(spark, sf, tmp_path, late=True):
    a = I.arrivals(spark, sf)
    if late:                                    # a last event far ahead closes all earlier windows
        end = a.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"),
                                                    (F.col("ts") + F.expr("interval 30 days")).alias("ts"),
                                                    F.lit(99).cast("long").alias("image"), F.lit("end").alias("event_type"),
                                                    F.lit(0).alias("g"), F.lit(0).alias("p"))
        a.repartition(1).write.parquet(str(tmp_path / "in/1"))
        end.write.parquet(str(tmp_path / "in/2"))
    return a, spark.readStream.schema(a.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
        return df.sparkSession.table(name)
    finally:
        q.stop()


@pytest.mark.parametrize("name, fn", [("tumbling", ST.quality_tumbling), ("sliding", ST.quality_sliding),
                                      ("sessions", ST.quality_sessions)])
def test_windows(spark, sf, tmp_path, name, fn):
    batch, stream = arrivals_stream(spark, sf, tmp_path)
    got = drain(fn(stream), f"s_{name}").where(F.col("n_equal") + F.col("n_pred") + F.col("n_truth") > 0)
    cut = batch.agg(F.max("ts")).first()[0]
    want = fn(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.where(F.col("end") <= F.lit(cut)).exceptAll(want).isEmpty()
    assert got.where(F.col("end") <= F.lit(cut)).count() == want.where(F.col("end") <= F.lit(cut)).count()


def test_dedupe(spark, sf, tmp_path):
    a = I.arrivals(spark, sf)
    a.unionByName(a).repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    got = drain(ST.dedupe_arrivals(s, ["event_id"], "400 days"), "s_dedupe")
    assert got.count() == a.count() == got.select("event_id").distinct().count()


def test_ingest_is_exactly_once(spark, sf, tmp_path):
    px = I.pixels(spark, sf)
    images = px.select("image").distinct().select("image", F.lit(128).alias("width"), F.lit(128).alias("height"))
    px.write.parquet(str(tmp_path / "in/a"))
    def read():
        return spark.readStream.schema(px.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run():
        ST.ingest_tiles(read(), images, 32, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    px.withColumn("image", F.col("image") + 100).write.parquet(str(tmp_path / "in/b"))
    more = images.unionByName(images.withColumn("image", F.col("image") + 100))
    ST.ingest_tiles(read(), more, 32, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    n = px.select("image").distinct().count()
    assert out.count() == 2 * n * 16 == out.select("image", "tile_r", "tile_c").distinct().count()
    assert sinks.stored_tiles(spark, str(tmp_path / "out"), 32).count() == 2 * n * 16
    back = T.unpack(out.where("image < 100").withColumn("image", F.col("image").cast("long")), 32)
    assert back.exceptAll(px.select(back.columns)).isEmpty()


def test_ingest_does_not_depend_on_where_batches_end(spark, sf, tmp_path):
    px = I.pixels(spark, sf).where("image < 2")
    images = px.select("image").distinct().select("image", F.lit(128).alias("width"), F.lit(128).alias("height"))
    part = F.pmod(F.xxhash64("r", "c"), F.lit(3))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for k in (2, 0, 1):
        if k == 1:
            assert sinks.stored_tiles(spark, out, 32).isEmpty()
        px.where(part == k).repartition(2).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(px.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ST.ingest_tiles(stream, images, 32, out, cp).awaitTermination()
    back = T.unpack(sinks.stored_tiles(spark, out, 32), 32)
    assert back.count() == px.count() and back.select(px.columns).exceptAll(px).isEmpty()


def test_newest_batch_wins(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch, value in ((3, 5), (7, 9), (4, 6)):
        rows = [(0, r, c, value, 0, 0) for r in range(2) for c in range(2) if batch != 7 or r == 0]
        sinks.write_tile_parts(spark.createDataFrame(rows, "image long, r int, c int, v int, tile_r int, tile_c int"), out, 2, batch)
    assert sinks.stored_tiles(spark, out, 2).first().data == [9, 9, 6, 6]
