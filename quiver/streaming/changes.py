"""An extension: the change log as a stream.

Reads a folder of change-log Parquet files as they come and counts changes in
event-time windows, with a watermark that bounds the state and drops what comes
too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators.history import SCHEMA


def change_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_changes(changes: DataFrame, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window, op, n: changes by operation and window."""
    span = F.window("recorded_at", window, slide) if slide else F.window("recorded_at", window)
    return changes.withWatermark("recorded_at", late).groupBy(span.alias("window"), "op").agg(F.count("*").alias("n"))


def sessions(changes: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of changes of each entity, parted by a gap."""
    return changes.withWatermark("recorded_at", late).groupBy(F.session_window("recorded_at", gap).alias("window"), "entity_id").agg(F.count("*").alias("n"))


def write(counts: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start the query, with a checkpoint that lets it go on after a failure."""
    return counts.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
