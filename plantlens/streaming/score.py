"""Fitted row transforms on a stream of readings.

Everything learned (fences, medians, means, models) is frozen at fit time, so the table
transforms run on a streaming table as they are; no state or watermark is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Transform = Callable[[DataFrame], DataFrame]


def read_readings(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_scored(stream: DataFrame, transforms: list[Transform], folder: str, checkpoint: str) -> StreamingQuery:
    """Apply frozen transforms in order and append the rows to a parquet folder, once each."""
    for transform in transforms:
        stream = transform(stream)
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
