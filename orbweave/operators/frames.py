"""Frames and frame sets: directory, lookups, ranges, counts, time.

Frame sets of equal size are found by division, so a frame finds its set by an equi-join or by partition pruning. Sets of uneven
size are found by locate(), which compares with intervals only inside equal-width buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAMES_PER_SET, LONG_STRIDE, MEDIUM_STRIDE

#: Rows of intervals up to which they are broadcast with a range condition; their size is checked.
SMALL = 1000


def frame_sets(rows: DataFrame, frame: str = "frame", n: int = FRAMES_PER_SET) -> DataFrame:
    """frame_set, first_frame, n_frames of the frames that occur."""
    return rows.groupBy(F.expr(f"{frame} div {n}").alias("frame_set")).agg(F.min(frame).alias("first_frame"), F.count("*").alias("n_frames"))


def directory(sets: DataFrame, medium: int = MEDIUM_STRIDE, long: int = LONG_STRIDE) -> DataFrame:
    """Adds what the pointers of a file tell: sets before and after at distance 1, medium and long (null: none).
    One row per frame set, so the single ordered window is over metadata only."""
    if not 0 < medium < long:
        raise ValueError("strides must be positive, the medium one less than the long one")
    order = Window.orderBy("frame_set")
    steps = {"": 1, "medium_": medium, "long_": long}
    return sets.select("*", *(f(F.col("frame_set"), n).over(order).alias(f"{name}{to}") for name, n in steps.items() for to, f in (("prev", F.lag), ("next", F.lead))))


def nth_set(sets: DataFrame, n: int) -> DataFrame:
    return sets.where(F.col("frame_set") == n)


def locate(rows: DataFrame, spans: DataFrame, at: str, low: str, size: str, keep: list) -> DataFrame:
    """rows with columns keep of the span (low inclusive, of size) that holds at; null if none does. Spans don't overlap.

    A few spans (at most SMALL, checked) are broadcast. Many are cut at buckets as wide as the mean span, so that an equi-join by
    bucket with the interval as a further condition finds them."""
    spans = spans.where(F.col(size) > 0).select(F.col(low).alias("_low"), (F.col(low) + F.col(size)).alias("_high"), *keep)
    inside = (F.col(at) >= F.col("_low")) & (F.col(at) < F.col("_high"))
    n, total = spans.agg(F.count("*"), F.sum(F.col("_high") - F.col("_low"))).first()
    if n <= SMALL:
        return rows.join(F.broadcast(spans), inside, "left").drop("_low", "_high")
    width = max(1, total // n)
    cut = spans.withColumn("_bucket", F.explode(F.sequence(F.expr(f"_low div {width}"), F.expr(f"(_high - 1) div {width}"))))
    return rows.withColumn("_bucket", F.expr(f"{at} div {width}")).join(cut, (rows[at] >= F.col("_low")) & (rows[at] < F.col("_high")) & (F.expr(f"{at} div {width}") == cut["_bucket"]), "left").drop("_low", "_high", "_bucket")


def in_range(rows: DataFrame, first: int, last: int, frame: str = "frame") -> DataFrame:
    """Frames from first to last, both included. The predicate reaches the scan."""
    if first > last:
        raise ValueError("a range ends before it starts")
    return rows.where(F.col(frame).between(first, last))


def in_range_strided(rows: DataFrame, first: int, last: int, stride: int, first_with_data: int = 0, frame: str = "frame") -> DataFrame:
    """Frames of the range that hold data. A range that can hold none is an error, as for the files' readers: one that starts
    after the first data and is shorter than the rest of its stride."""
    stride = max(1, stride)
    if first > first_with_data and last - first_with_data + 1 < stride:
        raise ValueError("no data in this range")
    return in_range(rows, first, last, frame).where((F.col(frame) - first_with_data) % stride == 0)


def num_frames(sets: DataFrame) -> DataFrame:
    """End of the last set."""
    return sets.agg(F.max_by(F.col("first_frame") + F.col("n_frames"), "first_frame").alias("num_frames"))


def num_sets(sets: DataFrame) -> DataFrame:
    return sets.agg(F.count("*").alias("num_sets"))


def frames_with_block(blocks: DataFrame) -> DataFrame:
    """blocks: block_id, first_frame (of the set), n_frames, first_with_data, stride. Frames with data by block."""
    each = F.expr("(n_frames - (first_frame - first_with_data)) div greatest(stride, 1)")
    return blocks.groupBy("block_id").agg(F.sum(each).alias("n_with_data"))


def stored_rows(n_frames: Column, stride: Column) -> Column:
    """Rows that a sparse block stores."""
    return F.floor((n_frames - 1) / F.greatest(stride, F.lit(1))) + 1


def next_with_data(rows: DataFrame, frame: str = "frame", n: int = FRAMES_PER_SET) -> DataFrame:
    """next_frame: the next frame that has data; null at the end. The window runs inside frame sets; a set's last frame takes
    the first of the next set that has any, from the sets' minima, so frames are never sorted in one place."""
    own = Window.partitionBy("_set").orderBy(frame)
    rows = rows.withColumn("_set", F.expr(f"{frame} div {n}"))
    following = rows.groupBy("_set").agg(F.min(frame).alias("_first")).select("_set", F.lead("_first").over(Window.orderBy("_set")).alias("_following"))
    return rows.withColumn("_next", F.lead(frame).over(own)).join(following, "_set").withColumn("next_frame", F.coalesce("_next", "_following")).drop("_set", "_next", "_following")


def time_of_frame(frame: Column, first_frame: Column, first_time: Column, time_per_frame: Column) -> Column:
    """Seconds. A time per frame that isn't positive is an error."""
    return F.when(time_per_frame > 0, first_time + time_per_frame * (frame - first_frame)).otherwise(F.raise_error(F.lit("no time per frame")).cast("double"))


def scoped(of_set: DataFrame, of_file: DataFrame, key: str, value: str) -> DataFrame:
    """A set's own value, else the file's."""
    return of_set.join(of_file.select(key, F.col(value).alias("_file")), key, "left").withColumn(value, F.coalesce(value, "_file")).drop("_file")


def dense(rows: DataFrame, first: int, last: int, frame: str = "frame", value: str = "value", fill: float = 0.0) -> DataFrame:
    """A row for each frame of the range; those without data get fill."""
    every = rows.sparkSession.range(first, last + 1).withColumnRenamed("id", frame)
    return every.join(in_range(rows, first, last, frame), frame, "left").withColumn(value, F.coalesce(value, F.lit(fill)))
