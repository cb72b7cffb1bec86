"""Row operators on a stream. Filters, column operations, cleaning, conversion and validation work on one row at a time,
so they run unchanged on a Structured Streaming frame; operators that need an order, a group or a count do not."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_rows(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, file_format: str = "parquet",
             available_now: bool = True) -> StreamingQuery:
    """Apply a row-local step to a stream and append the rows to files, exactly once."""
    writer = step(source).writeStream.format(file_format).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
