"""Trajectories in storage: files of the binary format, and partitioned Parquet tables.

Encoding works on one frame set at a time (a bounded group, by the number of frames in a set), so it scales with the number of sets.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.codecs import container
from ..sources import blockfile as bf
from ..sources import datasource

ENCODED = "frame_set long, meta string, body binary"
NAMES = dict(schema.STANDARD_BLOCKS)


def _block(rows: pd.DataFrame, block_id: int, by_particle: bool, codec: int) -> bf.Block:
    """Rows of one block in one frame set; frames are evenly spaced."""
    frames = np.unique(rows["frame"].to_numpy())
    stride = int(np.diff(frames).min()) if len(frames) > 1 else 1
    if len(frames) > 1 and (np.diff(frames) != stride).any():
        raise ValueError(f"block {block_id:#x}: frames aren't evenly spaced")
    values = np.stack(rows["values"].to_numpy()).astype(float)
    n = len(rows) // len(frames)
    if n * len(frames) != len(rows):
        raise ValueError(f"block {block_id:#x}: frames have different numbers of particles")
    first = int(rows["particle"].min()) if by_particle else 0
    return bf.Block(block_id, NAMES.get(block_id, ""), values.reshape(len(frames), n, -1), True, by_particle, int(frames[0]), stride, first, bf.DOUBLE, codec)


def encoded(values: DataFrame, frames_per_set: int = schema.FRAMES_PER_SET, codec: int = bf.QUANTISED, precision: float = 0.001, speed: int = container.SPEED, first_time: float = 0.0, time_per_frame: float | None = None) -> DataFrame:
    """A row for each frame set: its fields and encoded blocks. values: particle_values, or frame_values (particle is then null)."""
    rows = values.select(F.col("block_id"), F.expr(f"frame div {frames_per_set}").alias("frame_set"), "frame", F.col("particle") if "particle" in values.columns else F.lit(None).cast("long").alias("particle"), "values")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        frame_set = int(key[0])
        s = {"first_frame": frame_set * frames_per_set, "n_frames": int(own["frame"].max()) - frame_set * frames_per_set + 1, "first_time": first_time + (time_per_frame or 0) * frame_set * frames_per_set, "time_per_frame": time_per_frame}
        blocks = []
        for block_id, part in own.sort_values(["frame", "particle"], kind="stable").groupby("block_id", sort=True):
            blocks.append(_block(part, int(block_id), bool(part["particle"].notna().all()), codec))
        return pd.DataFrame({"frame_set": [frame_set], "meta": [json.dumps(s)], "body": [bf.set_body(s, [], blocks, True, precision, speed)]})

    return rows.groupBy("frame_set").applyInPandas(run, ENCODED)


def decoded(sets: DataFrame) -> DataFrame:
    """particle_values of what encoded() gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for frame_set, meta, body in zip(batch["frame_set"], batch["meta"], batch["body"], strict=True):
                s, file = json.loads(meta), bf.File(io.BytesIO(body))
                for h in file.headers():
                    b = bf.read_block(file, h, s)
                    n, count = b.values.shape[1], len(b.values)
                    yield pd.DataFrame({"block_id": b.block_id, "frame_set": frame_set, "frame": np.repeat(b.first_frame + b.stride * np.arange(count), n), "particle": np.tile(b.first_particle + np.arange(n), count), "values": list(b.values.reshape(count * n, -1))})

    return sets.mapInPandas(run, schema.PARTICLE_VALUES)


def write_files(sets: DataFrame, path: str, general: dict | None = None, molecules: list[dict] | None = None, static: list[bf.Block] | None = None, mode: str = "overwrite") -> None:
    """Writes encoded sets under path, a file for each partition; consecutive sets stand together."""
    datasource.register(sets.sparkSession)
    header = base64.b64encode(pickle.dumps((general or {}, molecules or [], static or []))).decode()
    sets.repartitionByRange("frame_set").write.format(datasource.NAME).option("header", header).mode(mode).save(path)


def read_files(spark: SparkSession, path: str, table: str = "particle_values", block_ids: tuple[int, ...] | None = None, frames: tuple[int, int] | None = None, sets: tuple[int, int] | None = None) -> DataFrame:
    """A table of a trajectory. block_ids, frames and sets (first and last, both included) are left out where they aren't wanted before
    any block is read."""
    datasource.register(spark)
    source = spark.read.format(datasource.NAME).option("table", table)
    columns = {x.split()[0] for x in datasource.TABLES[table].split(", ")} if table in datasource.TABLES else set()
    wanted = F.lit(True)
    if block_ids is not None:
        source, wanted = source.option("block_ids", ",".join(map(str, block_ids))), wanted & F.col("block_id").isin(list(block_ids))
    for name, bounds in (("frame", frames), ("set", sets)):
        if bounds is not None:
            source = source.option(f"first_{name}", bounds[0]).option(f"last_{name}", bounds[1])
            column = "frame_set" if name == "set" else "frame"
            wanted = wanted & F.col(column).between(*bounds) if column in columns else wanted
    found = source.load(path)
    return found if block_ids is frames is sets is None else found.where(wanted)


def write_tables(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned by block and frame set, so that reads of a block and a range of sets open nothing else."""
    values.repartition("block_id", "frame_set").sortWithinPartitions("block_id", "frame_set", "frame").write.partitionBy("block_id", "frame_set").mode(mode).parquet(path)


def read_tables(spark: SparkSession, path: str, kind: str = schema.PARTICLE_VALUES) -> DataFrame:
    names = [x.split()[0] for x in kind.split(", ")]
    found = spark.read.parquet(path)
    return found.select(*(F.col(n).cast("long").alias(n) if n in ("block_id", "frame_set") else F.col(n) for n in names))


def copy_files(spark: SparkSession, source: str, target: str, **options) -> None:
    """Reads a trajectory and writes it anew, set by set."""
    info = read_files(spark, source, "general_info").first()
    write_files(encoded(read_files(spark, source), frames_per_set=info["frames_per_set"], **options), target, info.asDict())


def compressed(rows: DataFrame, n_atoms: int, coder: str, parameter: int = 4, q: str = "q") -> DataFrame:
    """frame_set, frames, data: quantised frames of each set through one coder. q: arrays of n_atoms triplets."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("frame", kind="stable")
        frames = np.stack(own[q].to_numpy())
        return pd.DataFrame({"frame_set": [int(key[0])], "frames": [own["frame"].tolist()], "data": [container.pack(frames, coder, parameter, n_atoms)]})

    return rows.select("frame_set", "frame", q).groupBy("frame_set").applyInPandas(run, "frame_set long, frames array<long>, data binary")


def uncompressed(sets: DataFrame, n_atoms: int, coder: str, parameter: int = 4) -> DataFrame:
    """frame_set, frame, q of what compressed() gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame_set, frames, data in zip(batch["frame_set"], batch["frames"], batch["data"], strict=True):
                found = container.unpack(bytes(data), coder, parameter, len(frames) * n_atoms * 3, n_atoms).reshape(len(frames), -1)
                yield pd.DataFrame({"frame_set": frame_set, "frame": np.asarray(frames, np.int64), "q": list(found)})

    return sets.mapInPandas(run, "frame_set long, frame long, q array<long>")
