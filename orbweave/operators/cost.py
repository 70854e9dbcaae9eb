"""What codecs would cost, without encoding: sums of a table of bit widths, and the cheapest of all candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bit_length, zigzag

PARAMETERS = range(1, 20)
WIDTHS = range(0, 33)


def stop_bit_bits(width: int, parameter: int) -> int:
    """Bits of a number of so many bits: chunks of parameter bits and one that says whether another follows, each chunk half as wide."""
    total, chunk = 0, parameter
    while True:
        total += chunk + 1
        if width <= chunk:
            return total
        width -= chunk
        chunk = max(1, chunk // 2)


def triplet_bits(width: int, parameter: int, most: int) -> int:
    """Bits of a triplet whose largest number has so many bits. most: bits of the largest of all."""
    return 2 + 3 * next((parameter + k for k in range(3) if width <= parameter + k), max(parameter, most))


def _widths(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(bit_length(zigzag(F.col(value))).alias("w")).agg(F.count("*").alias("n"))


def stop_bit_costs(rows: DataFrame, value: str = "delta") -> DataFrame:
    """parameter, bytes. Values are first counted by width (33 rows at most); the table of costs joins these."""
    table = rows.sparkSession.createDataFrame([(w, p, stop_bit_bits(w, p)) for w in WIDTHS for p in PARAMETERS], "w long, parameter int, bits long")
    return _widths(rows, value).join(F.broadcast(table), "w").groupBy("parameter").agg(F.ceil(F.sum(F.col("n") * F.col("bits")) / 8).alias("bytes"))


def triplet_costs(rows: DataFrame, values: str = "delta") -> DataFrame:
    """parameter, bytes. rows hold arrays of triplets."""
    starts = F.sequence(F.lit(0), F.floor(F.size(values) / 3).cast("int") - 1)
    tops = F.transform(starts, lambda i: F.greatest(*(zigzag(F.get(values, i * 3 + k)) for k in range(3))))
    widths = rows.where(F.size(values) >= 3).select(F.explode(tops).alias("top")).groupBy(bit_length(F.col("top")).alias("w")).agg(F.count("*").alias("n"))
    table = rows.sparkSession.createDataFrame([(w, m, p, triplet_bits(w, p, m)) for m in WIDTHS for w in range(m + 1) for p in PARAMETERS], "w long, m long, parameter int, bits long")
    most = widths.agg(F.max("w").alias("m"))  # one row
    return widths.crossJoin(F.broadcast(most)).join(F.broadcast(table), ["w", "m"]).groupBy("parameter").agg(F.ceil((32 + F.sum(F.col("n") * F.col("bits"))) / 8).alias("bytes"))


def cheapest(costs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The candidate of the least size; the first of equals. costs: priority, codec, parameter, bytes."""
    best = F.min_by(F.struct("codec", "parameter", "bytes"), F.struct("bytes", "priority", "parameter"))
    return costs.groupBy(*(by or [])).agg(best.alias("b")).select(*(by or []), "b.codec", "b.parameter", "b.bytes")
