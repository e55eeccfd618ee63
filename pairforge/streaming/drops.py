"""Dropped files as a stream: the stateless operators unchanged, written once for each batch.

Spark's checkpoint remembers which files are done, so nothing has to look for
the last row of an earlier run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


def read_drops(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int | None = None) -> DataFrame:
    """New files of a folder, JSON lines or CSV with header."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(kind).load(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, *steps: Step, once: bool = True) -> StreamingQuery:
    """Apply the steps and write each batch to its own folder, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        for step in steps:
            batch = step(batch)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(lambda b, n: sink(b, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by window and key with a watermark; state of closed windows is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).count()
