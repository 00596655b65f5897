"""Files in and out."""

import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from footgrid.functions import geometry as G, names as N
from footgrid.sources import labels as LB, manifest as MF, sinks, tasks as TK


def test_raster_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n, text in (("a_1.tif", "x"), ("b.TIFF", "y"), ("empty.tif", ""), ("sub/c.TIF", "yy"), ("d.png", "z")):
        (tmp_path / n).write_text(text)
    assert sorted(r.name for r in MF.rasters(spark, str(tmp_path)).collect()) == ["a_1.tif", "b.TIFF", "c.TIF"]
    assert sorted(r.stem for r in MF.listing(spark, str(tmp_path)).collect()) == ["a_1", "b"]
    inventory = spark.createDataFrame([("a.tif", 0), ("b.tif", 5)], "name string, length long")
    assert [r.name for r in MF.empty_files(inventory).collect()] == ["a.tif"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("1")
    with pytest.raises(IOError, match="GeoTIFF"):
        MF.rasters(spark, str(tmp_path / "none"))


def test_copy_never_overwrites(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    (src / "deep").mkdir(parents=True)
    dst.mkdir()
    (src / "one.txt").write_text("new")
    (src / "deep/two.txt").write_text("two")
    (dst / "one.txt").write_text("old")
    there = MF.relative(MF.list_files(spark, str(dst)), str(dst)).select("rel_path")
    assert [r.rel_path for r in MF.copy_files(spark, str(src), str(dst), there).collect()] == ["deep/two.txt"]
    assert (dst / "one.txt").read_text() == "old" and (dst / "deep/two.txt").read_text() == "two"


WKT = '"POLYGON((0 0, 2 0, 2 3, 0 3, 0 0), (1 1, 1.5 1, 1.5 1.5, 1 1))",0.7,x'


def test_csv_labels_plain_and_gzipped(spark, tmp_path):
    text = "geometry,confidence,plus\n" + WKT + "\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        row = LB.polygons_of_wkt(LB.label_csv(spark, str(tmp_path / name))).select(
            G.area(F.col("ring")).alias("a"), "confidence", "part").first()
        assert (row.a, row.confidence, row.part) == (6.0, 0.7, 0)
    both = LB.read_vectors(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz"))
    assert both.count() == 1


def test_other_geometry_is_an_error(spark):
    df = spark.createDataFrame([("POINT(1 2)",)], "geometry string")
    with pytest.raises(PySparkException, match="Invalid geometry type"):
        LB.polygons_of_wkt(df).collect()
    assert LB.polygons_of_wkt(spark.createDataFrame([("POLYGON EMPTY",)], "geometry string")).count() == 0


def test_geojson_round_trip(spark, tmp_path):
    folder = tmp_path / "AOI_2_Vegas"
    folder.mkdir()
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "7"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"id": "8"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (folder / "x.geojson").write_text(json.dumps(doc, indent=1))
    got = LB.read_geojson(spark, str(folder)).select("code", F.col("properties.id").alias("id"), "part", G.area(F.col("ring")).alias("a"))
    assert sorted(map(tuple, got.collect())) == [("Vegas", "7", 0, 1.0), ("Vegas", "8", 0, 1.0), ("Vegas", "8", 1, 1.0)]
    polys = LB.read_geojson(spark, str(folder)).select("code", "part", "ring")
    LB.write_geojson_lines(polys, str(tmp_path / "lines"))
    line = json.loads(spark.read.text(str(tmp_path / "lines")).first()[0])
    assert line["geometry"]["coordinates"] == [ring] and line["properties"]["code"] == "Vegas"


def test_task_files_keep_bad_documents_aside(spark, tmp_path):
    result = {"original_width": 200, "value": {"points": [[0, 0], [50, 0], [50, 50]], "polygonlabels": ["roof", "other"]}}
    good = [{"id": 1, "file_upload": "ab12-tile-4.TIF", "annotations": [{"result": [result]}, {"result": []}]}]
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text('[{"id": 2, "file_')
    tasks = TK.read_tasks(spark, str(tmp_path))
    assert {r.json_name: r.corrupt is None for r in tasks.select("json_name", "corrupt").collect()} == \
        {"good.json": True, "bad.json": False}
    row = TK.task_polygons(tasks.where("corrupt is null")).select("*", G.area(F.col("ring")).alias("a")).first()
    assert (row.id, row.image_name, row.label, row.a, row.json_name) == (1, "tile-4.TIF", "roof", 5000.0, "good.json")


def test_metric_log_and_tile_reruns(spark, tmp_path):
    log = str(tmp_path / "log")
    one = spark.createDataFrame([(0.5,)], "iou double")
    assert sinks.read_or_empty(spark, log, "iou double").count() == 0
    for _ in range(2):
        sinks.append_metrics(one, log)
    assert sinks.read_or_empty(spark, log, "iou double, eval_ts timestamp").count() == 2
    out = str(tmp_path / "tiles")
    t = lambda image, v: spark.createDataFrame([(image, 0, 0, [v])], "image int, tile_r int, tile_c int, data array<int>")
    sinks.write_tiles(t(1, 5).union(t(2, 6)), out)
    sinks.write_tiles(t(2, 7), out)
    assert sorted((r.image, r.data[0]) for r in sinks.read_tiles(spark, out).collect()) == [(1, 5), (2, 7)]


def test_surface_name_needs_two_tokens(spark):
    df = spark.createDataFrame([("nounderscore",)], "stem string")
    with pytest.raises(PySparkException, match="Unexpected filename"):
        df.select(N.surface_key(F.col("stem"))).collect()


def test_missing_part_is_an_error(spark):
    from footgrid.operators.pairing import required
    im, parts = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", 1)], "name string, m int")
    with pytest.raises(PySparkException, match="corresponding mask"):
        required(im, parts, ["name"], "mask").collect()


def test_bad_tasks_do_not_spoil_their_file(spark, tmp_path):
    result = {"original_width": 200, "value": {"points": [[0, 0], [50, 0], [50, 50]], "polygonlabels": ["roof"]}}
    good = lambda i: {"id": i, "file_upload": f"ab12-tile-{i}.TIF", "annotations": [{"result": [result]}]}
    (tmp_path / "mixed.json").write_text(json.dumps([good(1), {"id": 2, "annotations": []}, good(3), "nothing", None, {"id": "x", "file_upload": 5, "annotations": 7}]))
    (tmp_path / "empty.json").write_text("[]")
    rows = TK.read_tasks(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in rows if r.corrupt is None) == [1, 3]
    assert sum(r.json_name == "mixed.json" and r.corrupt is not None for r in rows) >= 3
