"""Model registry: which stored model a run uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def resolve(registry: DataFrame, version: str | None = None, finetune: bool = False) -> DataFrame:
    """The single model row of ``registry(kind, version, file)``.

    A known version wins; otherwise the only version of its kind is used. Several
    versions without a valid name, or several files in one version, are an error that
    surfaces when the plan runs."""
    kind = "base" if finetune else "model"
    pool = registry.where(F.col("kind") == kind)
    named = pool.agg(F.max((F.col("version") == F.lit(version)).cast("int"))).scalar() == 1
    n = pool.agg(F.count_distinct("version")).scalar()
    hit = F.when(named, F.col("version") == F.lit(version)).otherwise(
        F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit(
            f"Couldn't resolve model directory: expected a single version or a valid name (got {version}).")).cast("boolean")))
    picked = pool.where(F.coalesce(hit, F.lit(False)))
    files = picked.groupBy("kind", "version").agg(F.count(F.lit(1)).alias("_n"), F.min("file").alias("file"))
    one = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(
        F.lit("Expected one model file in "), F.col("version"), F.lit(", found "), F.col("_n").cast("string"))).cast("boolean"))
    return files.where(one).drop("_n")


def resolve_all(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch form: the model of each ``requests(request, version)``, NULL where it cannot
    be told: the named version, else the only version there is."""
    one_file = registry.groupBy("version").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n_files")) \
        .where("n_files = 1").select("version", "file")
    only = registry.agg(F.when(F.count_distinct("version") == 1, F.min("version"))).scalar()
    known = requests.join(one_file, "version", "left")
    found = F.when(F.col("file").isNotNull(), F.col("version")).otherwise(only)
    return known.select("request", found.alias("resolved"))
