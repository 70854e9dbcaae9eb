"""Frames that arrive one by one: a stream is cut into frame sets and appended.

A frame's set follows from its number, so no state is kept and a gap in the numbers needs none. Micro-batches append to a table, a folder for
each; a task's file has its frames by set, so files are as many as tasks, not as sets, and a read of some sets leaves out files and row groups by
their bounds. A set that several batches fill is whole once the stream has passed it, or is closed by the last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FRAMES_PER_SET


def with_sets(frames: DataFrame, frames_per_set: int = FRAMES_PER_SET, first_open: int | None = None) -> DataFrame:
    """frames with frame_set. Frames before first_open are late: their sets are closed, so they are left out."""
    rows = frames.withColumn("frame_set", F.expr(f"frame div {frames_per_set}"))
    return rows if first_open is None else rows.where(F.col("frame") >= first_open)


def append(frames: DataFrame, path: str, checkpoint: str, frames_per_set: int = FRAMES_PER_SET):
    """Starts a query that appends what has come so far, and ends. A batch that is run again replaces its own files only."""

    def put(batch: DataFrame, number: int) -> None:
        ordered = batch.withColumn("batch", F.lit(number)).sortWithinPartitions("batch", "frame_set", "frame")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return with_sets(frames, frames_per_set).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def set_sizes(frames: DataFrame, frames_per_set: int = FRAMES_PER_SET) -> DataFrame:
    """frame_set, first_frame, n_frames of a stream, by a running aggregation. One row of state for each set that was met."""
    return with_sets(frames, frames_per_set).groupBy("frame_set").agg(F.min("frame").alias("first_frame"), F.count("*").alias("n_frames"))


def follow(spark, path: str, table: str = "particle_values") -> DataFrame:
    """New frame sets of a growing trajectory file, as a stream."""
    from ..sources import datasource

    datasource.register(spark)
    return spark.readStream.format(datasource.NAME).option("table", table).load(path)
