"""A trajectory as one object: files or tables in, lazy DataFrames out.

It holds no cursor. What a reader of files does by moving from frame set to frame set is a predicate on frame or frame_set here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import blocks, frames, mapping, storage, topology
from .sources import blockfile, datasource


class Trajectory:
    """Opened by open_trajectory()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        datasource.register(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format(datasource.NAME).option("table", name).load(self.path)

    # Header.

    @cached_property
    def info(self) -> dict:
        """General information of the file."""
        row = self.table("general_info").first()
        return row.asDict() if row else {}

    def name(self, which: str, most: int = schema.MAX_STRING) -> str:
        """program_first, user_last, forcefield and so on. A name that doesn't fit into most bytes with its end is an error."""
        found = self.info.get(which) or ""
        if most <= 0 or len(found.encode()) > most - 1:
            raise ValueError(f"{which} has {len(found.encode())} bytes, and its end")
        return found

    @property
    def frames_per_set(self) -> int:
        return self.info.get("frames_per_set") or schema.FRAMES_PER_SET

    # Topology.

    @cached_property
    def molecules(self) -> DataFrame:
        """Molecule types with their counts."""
        counts = self.table("molecule_counts").where("frame_set is null").select("mol_idx", "cnt")
        return self.table("molecules").join(counts, "mol_idx", "left")

    def bonds(self) -> DataFrame:
        """All bonds of all instances, by particle numbers."""
        return topology.bonds_expanded(self.molecules, self.table("bonds"))

    def particles(self, numbers: DataFrame, corrected: bool = False) -> DataFrame:
        """numbers (particle) with names and ids of atom, residue, chain and molecule."""
        return topology.particle_to_atom(numbers, self.molecules, self.table("atoms"), self.table("residues"), self.table("chains"), corrected=corrected)

    def num_molecules(self) -> int:
        return topology.totals(self.molecules).first()["n_molecules"] or 0

    def num_particles(self) -> int:
        return topology.totals(self.molecules).first()["n_particles"] or 0

    def find_molecule(self, name: str = "", mol_id: int = -1) -> DataFrame:
        return topology.find(self.molecules, "mol_idx", name, mol_id, "mol_id")

    def find_chain(self, mol_idx: int, name: str = "", chain_id: int = -1) -> DataFrame:
        return topology.find(self.table("chains").where(F.col("mol_idx") == mol_idx), "chain_idx", name, chain_id, "chain_id")

    def find_residue(self, mol_idx: int, name: str = "", res_id: int = -1, chain_idx: int | None = None) -> DataFrame:
        rows = self.table("residues").where(F.col("mol_idx") == mol_idx)
        return topology.find(rows if chain_idx is None else rows.where(F.col("chain_idx") == chain_idx), "res_idx", name, res_id, "res_id")

    def find_atom(self, mol_idx: int, name: str = "", atom_id: int = -1) -> DataFrame:
        return topology.find(self.table("atoms").where(F.col("mol_idx") == mol_idx), "atom_idx", name, atom_id, "atom_id")

    # Frame sets.

    @cached_property
    def frame_sets(self) -> DataFrame:
        return self.table("frame_sets")

    def directory(self) -> DataFrame:
        return frames.directory(self.frame_sets, self.info.get("medium_stride") or schema.MEDIUM_STRIDE, self.info.get("long_stride") or schema.LONG_STRIDE)

    def num_frames(self) -> int:
        return frames.num_frames(self.frame_sets).first()[0] or 0

    def num_frame_sets(self) -> int:
        return self.frame_sets.count()

    def frame_set_of(self, frame: int) -> DataFrame:
        """The frame set that holds a frame; no row if none does."""
        return storage.read_files(self.spark, self.path, "frame_sets", frames=(frame, frame))

    def frame_set(self, number: int) -> DataFrame:
        return storage.read_files(self.spark, self.path, "frame_sets", sets=(number, number))

    def times(self, numbers: DataFrame, frame: str = "frame") -> DataFrame:
        """numbers with seconds."""
        placed = frames.locate(numbers, self.frame_sets.select("first_frame", "n_frames", "first_time", "time_per_frame"), frame, "first_frame", "n_frames", ["first_time", "time_per_frame", F.col("first_frame").alias("_first")])
        return placed.withColumn("seconds", frames.time_of_frame(F.col(frame), F.col("_first"), F.col("first_time"), F.col("time_per_frame"))).drop("_first", "first_time", "time_per_frame")

    def next_frames(self, block_id: int) -> DataFrame:
        """frame, next_frame of the frames that hold a block."""
        table = self.values(block_id).select("frame").distinct()
        return frames.next_with_data(table, n=self.frames_per_set)

    def frames_with(self, block_id: int) -> int:
        """How many frames hold a block."""
        sets = self.frame_sets.select("frame_set", "first_frame", F.col("n_frames").alias("of_set"))
        rows = self.table("data_blocks").where((F.col("block_id") == block_id) & F.col("frame_set").isNotNull()).join(sets, "frame_set")
        found = rows.select("block_id", "first_frame", F.col("of_set").alias("n_frames"), F.col("first_frame_with_data").alias("first_with_data"), "stride")
        row = frames.frames_with_block(found).first()
        return row["n_with_data"] if row else 0

    # Blocks.

    def values(self, block_id: int, first: int | None = None, last: int | None = None) -> DataFrame:
        """Values of a block that depends on particles: block_id, frame_set, frame, particle (its real number), values."""
        return storage.read_files(self.spark, self.path, "particle_values", (block_id,), None if first is None else (first, last))

    def frame_values(self, block_id: int, first: int | None = None, last: int | None = None) -> DataFrame:
        """Values of a block that doesn't depend on particles; a file's own if no frame set has it."""
        rows = storage.read_files(self.spark, self.path, "frame_values", (block_id,), None if first is None else (first, last))
        return rows if not rows.isEmpty() else self.table("static_values").where((F.col("block_id") == block_id) & F.col("values").isNotNull()).select("block_id", F.lit(None).cast("long").alias("frame_set"), F.lit(None).cast("long").alias("frame"), "values")

    def positions(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.values(schema.POSITIONS, first, last)

    def velocities(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.values(schema.VELOCITIES, first, last)

    def forces(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.values(schema.FORCES, first, last)

    def strided(self, block_id: int, first: int, last: int) -> DataFrame:
        """A range of a block by its own stride; a range that can hold no data is an error."""
        meta = self.block(block_id).first()
        if meta is None:
            raise KeyError(f"no block {block_id:#x}")
        return frames.in_range_strided(self.values(block_id, first, last), first, last, meta["stride"] or 1, meta["first_frame_with_data"] or 0)

    def box_shape(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return blocks.box_shape(self.frame_values(schema.BOX_SHAPE, first, last))

    def block(self, block_id: int) -> DataFrame:
        """Name, type, dependency, stride, codec and so on of a block: the file's own, else of the first set that has it."""
        return blocks.described(self.table("data_blocks"), block_id)

    def damaged(self) -> DataFrame:
        """Headers of blocks whose contents don't match their MD5."""
        return self.table("blocks").where("hash_ok = false")

    def mapped(self, rows: DataFrame) -> DataFrame:
        """rows (frame_set, particle: local numbers) with real numbers."""
        return mapping.applied(rows, self.table("mappings"))

    # Out.

    def copy(self, path: str, **options) -> Trajectory:
        storage.copy_files(self.spark, self.path, path, **options)
        return Trajectory(self.spark, path)

    def to_tables(self, path: str) -> None:
        storage.write_tables(self.table("particle_values"), path)

    def follow(self, table: str = "particle_values") -> DataFrame:
        """New frame sets, as a stream."""
        return self.spark.readStream.format(datasource.NAME).option("table", table).load(self.path)


def open_trajectory(spark: SparkSession, path: str, mode: str = "r") -> Trajectory:
    """mode r reads, w empties the path first, a leaves what is there to be added to. Others are an error."""
    if mode not in ("r", "w", "a"):
        raise ValueError(f"mode {mode!r}: r, w or a")
    if mode == "r":
        blockfile.listed(path)  # must be there
    if mode == "w":
        datasource.emptied(path)
    return Trajectory(spark, path)


def write_trajectory(values: DataFrame, path: str, general: dict | None = None, builder: topology.Builder | None = None, mode: str = "overwrite", **encoding) -> Trajectory:
    """Writes values (block_id, frame, particle or null, values) set by set, and opens the result. general: header fields; builder:
    topology. encoding: options of storage.encoded()."""
    general = dict(general or {})
    general.setdefault("frames_per_set", encoding.get("frames_per_set", schema.FRAMES_PER_SET))
    encoding["frames_per_set"] = general["frames_per_set"]
    if not 0 < general.get("medium_stride", schema.MEDIUM_STRIDE) < general.get("long_stride", schema.LONG_STRIDE):
        raise ValueError("strides must be positive, the medium one less than the long one")
    molecules = [{**m, "residues": list(m["residues"])} for m in builder.molecules] if builder else []
    storage.write_files(storage.encoded(values, **encoding), path, general, molecules, mode=mode)
    return Trajectory(values.sparkSession, path)
