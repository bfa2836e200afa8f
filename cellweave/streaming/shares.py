"""Incremental composition of arriving cells. An addition: batch operators stay the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """Files of a folder as a stream, at most ``files`` a trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def windowed_shares(cells: DataFrame, time: str, category: str, width: str, late: str) -> DataFrame:
    """``start, category, n`` in event-time windows; rows later than ``late`` are left out once their window is closed."""
    counts = cells.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), category).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), category, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Closed windows appended to Parquet; exactly once, as the checkpoint lies in a shared folder."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
