"""Building labels and settlement boundaries: CSV with WKT, GeoJSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import geometry as G
from ..operators.pairing import concat_frames

LABEL_SCHEMA = "latitude double, longitude double, area_in_meters double, confidence double, geometry string, full_plus_code string"


def label_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV labels with a WKT ``geometry`` column. Without a schema the header names the
    columns (all text but ``confidence``). A gzipped file is one task on reading, so its
    rows are spread right after."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if "confidence" in df.columns:
        df = df.withColumn("confidence", F.col("confidence").cast("double"))
    return df.repartition(F.col("geometry")) if path.endswith(".gz") else df


def polygons_of_wkt(df: DataFrame, wkt: str = "geometry", keep_bad: bool = False) -> DataFrame:
    """One row per polygon part with ``part`` and ``ring``; other geometry types are an
    error, or come back with a NULL ring when ``keep_bad`` is set."""
    kind = G.wkt_type(F.col(wkt))
    good = kind.isin("POLYGON", "MULTIPOLYGON")
    if keep_bad:
        rings = F.when(good, G.wkt_rings(F.col(wkt))).otherwise(F.array(F.lit(None).cast(G.RING_TYPE)))
    else:
        fail = F.raise_error(F.concat(F.lit("Invalid geometry type: "), kind)).cast(f"array<{G.RING_TYPE}>")
        rings = F.when(good, G.wkt_rings(F.col(wkt))).otherwise(fail)
    return df.select("*", F.posexplode(rings).alias("part", "ring"))


_POINTS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
GEOJSON_SCHEMA = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])


def geojson_features(df: DataFrame, features: str = "features") -> DataFrame:
    """``(…, properties, geom_type, part, ring)`` of a GeoJSON feature array. Coordinates
    stay text until the geometry type says how deep they are nested."""
    f = df.withColumn("_f", F.explode(features))
    coords = F.col("_f.geometry.coordinates")
    one = F.array(F.from_json(coords, _POINTS)[0])
    many = F.transform(F.from_json(coords, T.ArrayType(_POINTS)), lambda p: p[0])
    kind = F.col("_f.geometry.type")
    raw = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one)
    parts = F.transform(raw, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select(*[c for c in df.columns if c != features], F.col("_f.properties").alias("properties"),
                    kind.alias("geom_type"), F.posexplode(parts).alias("part", "ring"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON files (one document per file) as polygon rows with their folder code."""
    from ..functions.names import folder_code
    raw = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path)
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return geojson_features(raw.withColumn("code", folder_code(folder)))


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """Label or boundary tables in Parquet, CSV-WKT or GeoJSON, stacked by name; full
    duplicates collapse."""
    frames = []
    for p in paths:
        if p.endswith((".csv", ".csv.gz")):
            frames.append(label_csv(spark, p))
        elif p.endswith((".json", ".geojson")):
            frames.append(read_geojson(spark, p).withColumn("properties", F.to_json("properties")))
        else:
            frames.append(spark.read.parquet(p))
    return concat_frames(*frames)


def write_geojson_lines(df: DataFrame, path: str, ring: str = "ring", mode: str = "overwrite") -> None:
    """One GeoJSON feature per line; all other columns become properties."""
    coords = F.array(F.transform(ring, lambda p: F.array(p.x, p.y)))
    props = F.struct(*[c for c in df.columns if c != ring])
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(
        F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))).alias("value")) \
        .write.mode(mode).text(path)
