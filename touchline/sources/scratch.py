"""Tables written in the middle of a job, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all is one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        where = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """`df` as a written table: its lineage is cut, lost executors cost nothing, and what reads it twice computes it once."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go from the disks: Spark drops them once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()
