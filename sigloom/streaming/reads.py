"""Reads as a stream. Every operator on reads is map-side, so it works on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_reads(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, a bounded number of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Append to Parquet; without an interval, all that is there now. The checkpoint makes it exactly-once."""
    out = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
