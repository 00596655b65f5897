"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "footgrid", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; a cluster's own settings win
    when ``master`` is left out."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only where it is unset
    and everything runs on one machine (tests) a temporary one, remembered in the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.footgrid.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        folder = tempfile.mkdtemp(prefix="footgrid-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.footgrid.scratch", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of its own in the shared folder."""
    return f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration step as a table in the shared folder and go on from it.

    Unlike a checkpointed plan, whose size estimate multiplies with every self-join
    until planning takes longer than the work, the table has its real size: join
    choices stay right and plans stay short. It also survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, "step")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def spent(*steps: DataFrame) -> None:
    """Delete the tables of steps that no later plan reads; frames that are no steps are left alone."""
    for df in steps:
        path = getattr(df, "_step", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
