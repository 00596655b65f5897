"""Labelling-tool exports: task JSON in, prediction JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions import names as N
from ..functions import pixel as P
from ..session import cut_lineage
from ..skew import attach
from . import documents as D

TASK_SCHEMA = """id bigint, file_upload string, annotations array<struct<result: array<struct<
    original_width: double, value: struct<points: array<array<double>>, polygonlabels: array<string>>>>>>"""


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Exported task files (JSON arrays) with ``json_name``. Each task is read on its own: one that cannot be read or has
    no id or upload is kept with its text in ``corrupt`` and no task fields, and the others of its file are unaffected.
    Files of any size are read in pieces (see ``documents``). One that is no valid array of at least one element is read line by
    line, each line a document of its own (see ``tasks_of``); their names come to the driver."""
    read = D.segments(D.pieces(spark, path, F.col("_metadata.file_path")), 1, _elements, below=True)
    bad = [r.doc for r in read.where("texts is null").select("doc").distinct().collect()]
    good = read.where(~F.col("doc").isin(bad)) if bad else read
    out = _read_each(good.select(N.base_name(F.col("doc")).alias("json_name"), F.explode("texts").alias("_text"), F.lit(None).cast("string").alias("_doc")), ["json_name"])
    if not bad:
        return out
    lines = spark.read.text(path).where(F.col("_metadata.file_path").isin(bad))   # other files are not opened
    return out.unionByName(tasks_of(lines.select(N.base_name(F.input_file_name()).alias("json_name"), "value"), "value"))


def _elements(parts: DataFrame) -> DataFrame:
    """``(doc, texts)`` of segments of an array; NULL where one does not fit. It is completed to an array between two marks; only
    one whole array leaves what follows readable."""
    first, last = F.col("first"), F.col("last")
    text = F.concat(F.lit('{"a":'), F.when(first, "").otherwise('["> cut"'), "text", F.when(last, "").otherwise(',"cut <"]'), F.lit(',"e":"end"}'))
    read = G.materialize(parts, "_p", F.from_json(text, "a array<string>, e string", {"mode": "PERMISSIVE"}))
    n = F.size("_p.a")
    fits = (F.col("_p.e") == "end") & (n > 0) & (first | (F.element_at("_p.a", 1) == "> cut")) & (last | (F.element_at("_p.a", -1) == "cut <"))
    mine = F.slice("_p.a", F.when(first, 1).otherwise(2), n - (~first).cast("int") - (~last).cast("int"))
    return read.select("doc", F.when(fits, _texts(mine)).alias("texts"))


def tasks_of(docs: DataFrame, column: str) -> DataFrame:
    """Tasks of export documents (a JSON array of tasks per row), see ``read_tasks``. A document that is no array, or an empty one, is one
    row with its text in ``corrupt``."""
    others = [c for c in docs.columns if c != column]
    # elements as their own text first: a damaged one then spoils nothing but itself
    split = F.from_json(column, "array<string>", {"mode": "PERMISSIVE"})
    whole = F.when(F.trim(column).startswith("[") & F.trim(column).endswith("]"), split)
    # only a document that cannot be split goes on as a whole
    none = F.lit(None).cast("string")
    each = docs.select(*others, F.explode(F.when(F.size(whole) > 0, F.transform(_texts(whole), lambda t: F.struct(t.alias("t"), none.alias("d"))))
                                          .otherwise(F.array(F.struct(none.alias("t"), F.col(column).alias("d"))))).alias("_e"))
    return _read_each(each.select(*others, F.col("_e.t").alias("_text"), F.col("_e.d").alias("_doc")), others)


def _texts(elements) -> Column:
    """Texts of array elements; that of a JSON null is ``null``."""
    return F.transform(elements, lambda t: F.coalesce(t, F.lit("null")))


def _read_each(each: DataFrame, others: list[str]) -> DataFrame:
    each = G.materialize(each, "_t", F.from_json("_text", TASK_SCHEMA, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("_t.file_upload").isNotNull() & F.col("_t.id").isNotNull(), F.lit(False))
    fields = [F.when(good, F.col(f"_t.{f}")).alias(f) for f in StructType.fromDDL(TASK_SCHEMA).names]
    return each.select(*fields, *others, F.when(~good, F.coalesce("_text", "_doc")).alias("corrupt"))


def parse_tasks(df: DataFrame, column: str = "json") -> DataFrame:
    """Tasks from a JSON text column, parsed once per row."""
    return G.materialize(df.select(column), "t", F.from_json(column, TASK_SCHEMA)).select("t.*")


def task_polygons(tasks: DataFrame) -> DataFrame:
    """``(id, image_name, label, ring)`` with pixel rings: one row per labelled result,
    points from percent of the tile, first label only. Empty results drop out."""
    extra = [c for c in ("json_name",) if c in tasks.columns]
    flat = tasks.select("id", *extra, N.upload_image_name(F.col("file_upload")).alias("image_name"),
                        F.explode("annotations").alias("a"))
    r = flat.select("id", *extra, "image_name", F.explode("a.result").alias("r")).where("r.value.points is not null")
    k = F.col("r.original_width") / 100
    ring = F.transform("r.value.points", lambda p: F.struct((k * p[0]).alias("x"), (k * p[1]).alias("y")))
    return r.select("id", *extra, "image_name", F.element_at("r.value.polygonlabels", 1).alias("label"),
                    G.close(ring).alias("ring"))


def to_world(polys: DataFrame, images: DataFrame) -> DataFrame:
    """Pixel rings to world rings with the affine of their image; polygons on images that
    are not there drop out (see ``pairing.missing``)."""
    out = attach(polys, images.select("image_name", "t"), ["image_name"], ["id"])
    ring = G.map_points(F.col("ring"), lambda x, y: P.to_world(x, y, F.col("t"))[0],
                        lambda x, y: P.to_world(x, y, F.col("t"))[1])
    return out.withColumn("ring", ring).drop("t")


def prediction_json(polys: DataFrame, tile_size: int = 512, version: str = "model") -> DataFrame:
    """``(image, place, prediction)``: polygons of each image (pixel rings) in the export layout. One document holds one image's
    polygons, as the layout demands; it comes in pieces (what stands before the polygons, one polygon each, what follows them) that by
    ``place`` put together are the document. No task holds one whole."""
    to_pct = lambda v: F.lit(100.0) * v.cast("int") / tile_size
    item = F.struct(
        F.lit("polygon").alias("type"), F.lit("polygon").alias("from_name"), F.lit("image").alias("to_name"),
        F.lit(tile_size).alias("original_width"), F.lit(tile_size).alias("original_height"), F.col("part").alias("id"),
        F.struct(F.col("points")).alias("value"))
    items = (polys.select("image", "pid", "part", F.transform("ring", lambda p: F.array(to_pct(p.x), to_pct(p.y))).alias("points"))
             .repartitionByRange("image", "pid", "part").sortWithinPartitions("image", "pid", "part", "points")
             .select("image", F.monotonically_increasing_id().alias("place"), F.to_json(item).alias("item")))
    items = cut_lineage(items.withColumn("_key", _key(F.col("image"))))
    start = items.groupBy("_key").agg(F.first("image").alias("image"), F.min("place").alias("_start"))
    doc = F.struct(
        F.struct(F.concat(F.lit("/data/upload/2/"), F.col("image").cast("string")).alias("image")).alias("data"),
        F.array(F.struct(F.lit(version).alias("model_version"), F.array().cast("array<string>").alias("result"))).alias("predictions"))
    around = start.withColumn("_d", F.to_json(doc))   # no polygons yet: they go before its last brackets
    head = around.select("image", F.lit(-1).cast("long").alias("place"), F.expr(f"left(_d, length(_d) - {len(_END)})").alias("prediction"))
    tail = around.select("image", F.lit((1 << 63) - 1).alias("place"), F.expr(f"right(_d, {len(_END)})").alias("prediction"))
    body = attach(items, start.select("_key", "_start"), ["_key"], ["place"]).select("image", "place", F.concat(
        F.when(F.col("place") > F.col("_start"), ",").otherwise(""), "item").alias("prediction"))
    return body.unionByName(head).unionByName(tail)


_END = "]}]}"
_ITEMS = "array<struct<type string, from_name string, to_name string, original_width int, original_height int, id string, value struct<points array<array<double>>>>>"


def _key(image: Column) -> Column:
    """Folder name of an image's document."""
    return F.coalesce(F.concat(F.lit("of-"), image.cast("string")), F.lit("none"))


def write_predictions(pieces: DataFrame, path: str) -> None:
    """Documents of ``prediction_json``, a folder per image: its files, by name, put together are the document (a line break
    follows each piece), so that many tasks write a long one."""
    (pieces.withColumn("doc", _key(F.col("image"))).repartitionByRange("doc", "place").sortWithinPartitions("doc", "place")
     .select("doc", F.col("prediction").alias("value")).write.partitionBy("doc").text(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``(image, result)``: polygons of the documents that ``write_predictions`` wrote, a row each, ``image`` as text. Anything
    else than one prediction per document is an error."""
    return D.segments(D.pieces(spark, path, F.col("doc")), 4, _results)   # {"predictions": [{"result": [


def _results(parts: DataFrame) -> DataFrame:
    text = F.concat(F.when(F.col("first"), "").otherwise('{"predictions":[{"result":[{}'), "text", F.when(F.col("last"), "").otherwise(_END))
    read = G.materialize(parts, "_p", F.from_json(text, f"predictions array<struct<result {_ITEMS}>>", {"mode": "FAILFAST"}).predictions)
    bad = F.raise_error(F.concat(F.lit("Not one prediction: "), "doc")).cast(_ITEMS)
    items = F.when((F.size("_p") == 1) & F.col("_p")[0].result.isNotNull(), F.col("_p")[0].result).otherwise(bad)
    mine = F.slice(items, F.when(F.col("first"), 1).otherwise(2), F.size(items))
    return read.select(F.when(F.col("doc") != "none", F.substring("doc", 4, (1 << 31) - 1)).alias("image"), F.explode(mine).alias("result"))
