"""Runs a stream over what is there now and gives the last version of each row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from touchline.sources.scratch import shared_dir


def latest(stream: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a streaming frame in update mode, run until its sources have no more files: each micro-batch is written
    with its number, and of rows with one key the one of the last batch counts. State, offsets and rows are kept in the
    shared folder, so that a stream that is stopped goes on where it was, and a batch that is run again writes its rows once."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    columns = stream.columns
    try:
        rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{where}/rows")
    except Exception as e:  # no batch: no file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*key, "_r.*").select(*columns)
