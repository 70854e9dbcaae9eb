"""The driver's tables seen as parts of a trajectory. All lazy, all pruned to the columns that are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FRAMES_PER_SET

#: Values of a frame of the grid: 21 particles in three dimensions.
GRID_VALUES = 63


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_set_of(frame: str = "frame", n: int = FRAMES_PER_SET):
    return F.expr(f"{frame} div {n}")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, frame_set, values (63 doubles: particle by particle, three dimensions): embeddings as positions."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.slice(F.col("embedding").cast("array<double>"), 1, GRID_VALUES).alias("values"))
    return rows.select("frame", frame_set_of().alias("frame_set"), "values")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, particle, dim, value."""
    return long_form(frames(spark, sf_dir).select("frame", "values"))


def long_form(rows: DataFrame, values: str = "values", value: str = "value") -> DataFrame:
    """An array of a frame's values as rows: particle, dim, value. Other columns stay."""
    rest = [c for c in rows.columns if c != values]
    return rows.select(*rest, F.posexplode(values).alias("_i", value)).select(*rest, F.expr("cast(_i div 3 as bigint)").alias("particle"), F.expr("cast(_i % 3 as bigint)").alias("dim"), value)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, value: events as a value for each frame."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), "value")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, frame_set, sym: kinds of events in their order."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), F.expr(f"event_id div {FRAMES_PER_SET}").alias("frame_set"), F.col("event_type").alias("sym"))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule type for each nation: its suppliers are atoms, its customers are instances."""
    n_atoms = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_atoms"))
    count = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("cnt"))
    rows = table(spark, sf_dir, "nation").join(n_atoms, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(count, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    idx = F.col("n_nationkey").cast("long")
    atoms = F.coalesce("n_atoms", F.lit(0)).cast("long")
    return rows.select(idx.alias("mol_idx"), (idx + 1).alias("mol_id"), F.col("n_name").alias("name"), atoms.alias("n_atoms"), F.expr("(coalesce(n_atoms, 0) + 2) div 3").alias("n_residues"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by key; three make a residue."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("mol_idx"), (F.row_number().over(order) - 1).cast("long").alias("atom_idx"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "N").otherwise("P").alias("atom_type"))
    return rows.select("mol_idx", "atom_idx", F.col("atom_idx").alias("atom_id"), F.expr("atom_idx div 3").alias("res_idx"), "name", "atom_type")


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two make a chain; the ids of a chain's residues start at 0."""
    rows = atoms(spark, sf_dir).select("mol_idx", "res_idx").distinct()
    return rows.select("mol_idx", "res_idx", F.expr("res_idx % 2").alias("res_id"), F.expr("res_idx div 2").alias("chain_idx"), F.concat(F.lit("R"), F.col("res_idx")).alias("name"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residues(spark, sf_dir).select("mol_idx", "chain_idx").distinct()
    return rows.select("mol_idx", "chain_idx", (F.col("chain_idx") + 1).alias("chain_id"), F.concat(F.lit("C"), F.col("chain_idx")).alias("name"))


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a residue."""
    rows = atoms(spark, sf_dir).where("atom_idx % 3 > 0")
    return rows.select("mol_idx", (F.col("atom_idx") - 1).alias("from_atom"), F.col("atom_idx").alias("to_atom"))
