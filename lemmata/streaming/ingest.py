"""Loads JSON lines as they arrive: each batch replaces rows by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def on_arrival(spark: SparkSession, folder: str, checkpoint: str, load: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands the lines of new files in `folder` to load(batch, number), all that is there and then stops."""
    lines = spark.readStream.text(folder)
    return lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
