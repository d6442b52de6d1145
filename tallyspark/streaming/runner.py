"""File source in, checkpointed append sink out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream; the schema is given, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", timeout: int | None = None) -> None:
    """Process what has arrived, append it exactly once, and stop.

    The checkpoint remembers which files are done, so a second run continues there. A backlog takes the time it takes;
    ``timeout`` in seconds is for callers that want a limit.
    """
    query = (
        stream.writeStream.format(fmt).outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")
