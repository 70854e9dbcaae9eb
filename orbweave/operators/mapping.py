"""Particle mappings: the real numbers of a frame set's local particles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(blocks: DataFrame) -> DataFrame:
    """blocks: frame_set, first, numbers (array). frame_set, local_particle, real_particle."""
    return blocks.select("frame_set", "first", F.posexplode("numbers").alias("_i", "real_particle")).select("frame_set", (F.col("first") + F.col("_i")).alias("local_particle"), "real_particle")


def applied(rows: DataFrame, mappings: DataFrame, local: str = "particle") -> DataFrame:
    """rows with real_particle. A set without mappings keeps its numbers; in one that has some, uncovered particles get null.

    An equi-join on (frame_set, local particle); Spark broadcasts the mappings only below its own threshold."""
    mapped = mappings.select("frame_set").distinct().withColumn("_mapped", F.lit(True))
    found = rows.join(mappings.select("frame_set", F.col("local_particle").alias(local), F.col("real_particle").alias("_real")), ["frame_set", local], "left")
    return found.join(mapped, "frame_set", "left").withColumn("real_particle", F.when(F.col("_mapped"), F.col("_real")).otherwise(F.col(local))).drop("_real", "_mapped")


def overlaps(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set's mapping blocks that can't both be: blocks: frame_set, block, first, n. a was there before b.

    As in files' writers, ends count as inside: a block may not end where an earlier one starts."""
    a = blocks.select("frame_set", F.col("block").alias("a"), F.col("first").alias("a0"), (F.col("first") + F.col("n")).alias("a1"))
    b = blocks.select("frame_set", F.col("block").alias("b"), F.col("first").alias("b0"), (F.col("first") + F.col("n")).alias("b1"))
    inside = "(b0 >= a0 and b0 < a1) or (b1 >= a0 and b1 < a1) or (a0 >= b0 and a0 < b1) or (a1 > b0 and a1 < b1)"
    return a.join(b, "frame_set").where("a < b").where(inside).select("frame_set", "a", "b")
