"""Run lengths, dictionaries and histograms of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: str = "frame_set", at: str = "frame", sym: str = "sym") -> DataFrame:
    """by, start, sym, n: runs of equal symbols inside each group of by (a frame set, so no order spans all rows)."""
    order = Window.partitionBy(by).orderBy(at)
    island = rows.select(by, at, sym, (F.row_number().over(order) - F.row_number().over(Window.partitionBy(by, sym).orderBy(at))).alias("_g"))
    return island.groupBy(by, sym, "_g").agg(F.min(at).alias("start"), F.count("*").alias("n")).select(by, "start", sym, "n")


def joined_runs(parts: DataFrame, by: str = "frame_set", sym: str = "sym") -> DataFrame:
    """Runs of runs(), with those that go on in the next group joined. Only a group's first and last runs can: the window over
    all groups has two rows for each at most."""
    ends = parts.groupBy(by).agg(F.min("start").alias("_low"), F.max("start").alias("_high"))
    marked = parts.select(by, "start", sym, "n").join(ends, by).withColumn("_end", F.col("start").isin(F.col("_low"), F.col("_high")))
    order = Window.orderBy("start")
    goes_on = (F.lag(sym).over(order) == F.col(sym)) & (F.lag(by).over(order) != F.col(by))
    ids = marked.where("_end").withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("long")).withColumn("_id", F.sum("_new").over(order))
    joined = ids.groupBy("_id").agg(F.min("start").alias("start"), F.first(sym).alias(sym), F.sum("n").alias("n")).drop("_id")
    return marked.where("not _end").select("start", sym, "n").unionByName(joined)


def unrolled(rows: DataFrame, start: str = "start", sym: str = "sym", n: str = "n", to: str = "frame") -> DataFrame:
    """A row for each symbol of the runs. Symbols of a run stand at consecutive places from its start."""
    return rows.select(F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).alias(to), sym)


def run_digits(value: Column, n: Column, least: int = 1) -> Column:
    """A run as codes: the bits of n below its highest, lowest first, then value + 2; runs of least or fewer are written out."""
    bits = F.reverse(F.split(F.substring(F.bin(n), 2, 64), ""))
    digits = F.transform(F.filter(bits, lambda b: b != ""), lambda b: b.cast("long"))
    return F.when(n > least, F.array_append(digits, value + 2)).otherwise(F.array_repeat(value + 2, n.cast("int")))


def histogram(rows: DataFrame, sym: str = "sym") -> DataFrame:
    """sym, count, code: the dictionary's code of each symbol, in ascending order. The window is over distinct symbols only."""
    counts = rows.groupBy(sym).agg(F.count("*").alias("count"))
    return counts.withColumn("code", F.row_number().over(Window.orderBy(sym)).cast("long") - 1)


def canonical_dictionary(spark, size: int = 0x20004) -> DataFrame:
    return spark.range(size).withColumnRenamed("id", "sym")


def move_to_front(rows: DataFrame, by: str, at: str = "frame", sym: str = "sym") -> DataFrame:
    """mtf: how many different symbols came since this one last did, in its group; null at its first.

    Each occurrence lives until the next of its symbol; those that live where another starts are counted."""
    order = Window.partitionBy(by, sym).orderBy(at)
    seen = rows.select(by, at, sym, F.lag(at).over(order).alias("_last"), F.lead(at).over(order).alias("_next"))
    other = seen.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.col("_next").alias("_until"))
    pairs = seen.join(other, (F.col(by) == F.col("_by")) & (F.col("_at") > F.col("_last")) & (F.col("_at") < F.col(at)) & (F.col("_until").isNull() | (F.col("_until") > F.col(at))), "left")
    return pairs.groupBy(by, at, sym).agg(F.when(F.max("_last").isNotNull(), F.count("_at")).alias("mtf"))


def few_large(rows: DataFrame, value: str, limit: int = 16384) -> DataFrame:
    """few: whether a tenth of the values at most reach limit."""
    return rows.agg((F.count_if(F.col(value) >= limit) <= F.floor(F.count("*") / 10)).alias("few"))
