"""Data blocks: projection, metadata, integrity, sizes, authoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BOX_SHAPE, DEPENDS_ON_FRAME, DEPENDS_ON_PARTICLE, FORCES, POSITIONS, VELOCITIES


def project(values: DataFrame, block_id: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of one block; block_id and frame predicates prune partitions of a stored table. An absent block gives no rows."""
    rows = values.where(F.col("block_id") == block_id)
    return rows if first is None else rows.where(F.col("frame").between(first, last))


def positions(values: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    return project(values, POSITIONS, first, last)


def velocities(values: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    return project(values, VELOCITIES, first, last)


def forces(values: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    return project(values, FORCES, first, last)


def box_shape(values: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Nine values a frame; other sizes are an error."""
    checked = F.when(F.size("values") == 9, F.col("values")).otherwise(F.raise_error(F.lit("a box has nine values")).cast("array<double>"))
    return project(values, BOX_SHAPE, first, last).withColumn("values", checked)


def described(blocks: DataFrame, block_id: int) -> DataFrame:
    """Metadata of a block: of the file's own scope first, else of the earliest set that has it."""
    order = Window.orderBy(F.col("frame_set").isNotNull(), "frame_set")
    return blocks.where(F.col("block_id") == block_id).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def flags(blocks: DataFrame) -> DataFrame:
    dependency = F.col("dependency")
    return blocks.withColumn("by_frame", dependency.bitwiseAND(F.lit(DEPENDS_ON_FRAME)) != 0).withColumn("by_particle", dependency.bitwiseAND(F.lit(DEPENDS_ON_PARTICLE)) != 0)


def digests(rows: DataFrame, content: str = "content") -> DataFrame:
    """md5 and length of each block's content."""
    raw = F.col(content).cast("binary")
    return rows.withColumn("md5", F.md5(raw)).withColumn("length", F.octet_length(raw).cast("long"))


def verified(rows: DataFrame, content: str = "content", md5: str = "md5") -> DataFrame:
    """hash_ok: null where the stored hash is all zeros, that is, unchecked. It never fails a read."""
    return rows.withColumn("hash_ok", F.when(F.col(md5) != "0" * 32, F.md5(F.col(content).cast("binary")) == F.col(md5)))


def replaced(blocks: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("block_id", "frame_set")) -> DataFrame:
    """blocks with those of new in place of those with the same keys."""
    same = [blocks[k].eqNullSafe(new[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return blocks.join(new, condition, "left_anti").unionByName(new)


def authored(rows: DataFrame, block_id: int, n_values: int, frames_per_set: int, values: str = "values", stride: int = 1) -> DataFrame:
    """Rows of a new block: frame, particle (may be absent), values. Wrong sizes are an error; frame sets follow from frames."""
    if n_values <= 0:
        raise ValueError("a block has one value at least")
    stride = max(1, stride)
    checked = F.when(F.size(values) == n_values, F.col(values)).otherwise(F.raise_error(F.lit("wrong number of values")).cast("array<double>"))
    keep = [c for c in ("frame", "particle") if c in rows.columns]
    return rows.where(F.col("frame") % stride == 0).select(F.lit(block_id).cast("long").alias("block_id"), F.expr(f"frame div {frames_per_set}").alias("frame_set"), *keep, checked.alias("values"))
