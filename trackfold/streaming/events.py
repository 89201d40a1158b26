"""Event streams: reading, and windowed counts with watermarks; ``state`` has what keeps state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jsonl import STREAM


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event stream of a folder of JSON-lines files, with ``ts`` made from its milliseconds."""
    return spark.readStream.schema(STREAM).json(path).withColumn("ts", F.timestamp_millis("t_ms"))


def counts(stream: DataFrame, size: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Events by kind and time window; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count("*").alias("n")).select("w.start", "w.end", "kind", "n")
