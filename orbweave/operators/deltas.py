"""Quantised frames and their differences.

A frame is one row with an array of its values, so differences inside a frame need no shuffle, and those between frames move a
row for each frame. Windows run inside frame sets: each set starts anew, as it does in files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dequantise, quantise


def quantised(rows: DataFrame, precision: float, values: str = "values", to: str = "q") -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != values), F.transform(values, lambda x: quantise(x, precision)).alias(to))


def dequantised(rows: DataFrame, precision: float, q: str = "q", to: str = "values") -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != q), F.transform(q, lambda x: dequantise(x, precision)).alias(to))


def inter(rows: DataFrame, q: str = "q", to: str = "delta") -> DataFrame:
    """Differences from the frame before; a set's first frame is absolute."""
    before = F.lag(q).over(Window.partitionBy("frame_set").orderBy("frame"))
    return rows.withColumn(to, before).withColumn(to, F.when(F.col(to).isNull(), F.col(q)).otherwise(F.zip_with(q, to, lambda a, b: a - b)))


def intra(rows: DataFrame, q: str = "q", to: str = "delta", dims: int = 3) -> DataFrame:
    """Differences from the particle before, dimension by dimension; the first particle is absolute."""
    return rows.withColumn(to, F.transform(q, lambda v, i: F.when(i < dims, v).otherwise(v - F.element_at(q, i - (dims - 1)))))


def undo_intra(rows: DataFrame, delta: str = "delta", to: str = "q", dims: int = 3) -> DataFrame:
    """Running sums by dimension, in two levels: inside pieces of about the root of the array's length, and over the pieces'
    last sums. A list that grows by one is copied in each step, so only short ones grow."""
    none, nothing = F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # a row for each row: what is exploded is computed once, not in each place that uses it
    rows = rows.withColumn("_all", once(F.struct(F.col(delta).alias("d"), (F.ceil(F.sqrt(F.size(delta) / dims)) * dims).cast("int").alias("piece"))))
    every, piece = F.col("_all.d"), F.col("_all.piece")
    step = lambda out, d: F.array_append(out, F.when(F.size(out) < dims, d).otherwise(d + F.coalesce(F.get(out, F.size(out) - dims), F.lit(0))))
    add = lambda a, b: F.transform(a, lambda x, i: x + F.get(b, i))
    starts = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / piece).cast("int"))
    sums = F.transform(starts, lambda i: F.aggregate(F.slice(every, i * piece + 1, piece), none, step))
    done = rows.withColumn("_sums", once(F.when(F.size(every) > 0, sums).when(every.isNotNull(), nothing)))
    last = lambda x: F.slice(x, -dims, dims)
    before = F.aggregate(F.slice("_sums", 1, F.size("_sums") - 1), F.array(F.array_repeat(F.lit(0).cast("long"), dims)), lambda out, x: F.array_append(out, add(last(x), F.element_at(out, -1))))
    whole = F.flatten(F.zip_with("_sums", "_before", lambda x, b: F.transform(x, lambda v, i: v + F.get(b, i % dims))))
    return done.withColumn("_before", once(F.when(F.size("_sums") > 0, before).when(F.col("_sums").isNotNull(), nothing))).withColumn(to, whole).drop("_all", "_sums", "_before")


def undo_inter(rows: DataFrame, delta: str = "delta") -> DataFrame:
    """rows: frame_set, frame, particle, dim, delta, in long form. q: running sums of each particle and dimension in its set."""
    order = Window.partitionBy("frame_set", "particle", "dim").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q", F.sum(delta).over(order))


def bounding_box(rows: DataFrame, q: str = "q", dims: int = 3) -> DataFrame:
    """dim, low, high of all frames. Each frame gives its own extremes first, so the aggregation has a few rows a frame."""
    every = lambda d: F.filter(q, lambda v, i: i % dims == d)
    each = F.array(*(F.struct(F.lit(d).cast("long").alias("dim"), every(d).alias("v")) for d in range(dims)))
    own = rows.select(F.explode(each).alias("x")).select("x.dim", F.array_min("x.v").alias("low"), F.array_max("x.v").alias("high"))
    return own.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def max_error(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_error"))
