"""The trajectory format as a Python data source: spark.read.format("trajectory").option("table", ...).load(path).

Tables: the canonical ones of schema.py. A partition is a run of frame sets of one file, found by reading headers only. The options
block_ids, first_frame, last_frame, first_set and last_set leave out sets and blocks before they are read; read_files() sets them. (Spark 4.1
keeps a Python source's pushed predicates with the table, so that a second query on one DataFrame would get the first one's;
predicates are therefore not pushed.) As a stream, offsets are ordinals of frame sets. The
writer makes one self-contained file for each task, in a folder; files of failed tasks are deleted.
"""

from __future__ import annotations

import base64
import json
import pickle
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import schema
from . import blockfile as bf

NAME = "trajectory"
TABLES = {
    "general_info": schema.GENERAL_INFO, "molecules": schema.MOLECULES, "molecule_counts": schema.MOLECULE_COUNTS, "chains": schema.CHAINS, "residues": schema.RESIDUES, "atoms": schema.ATOMS, "bonds": schema.BONDS,
    "frame_sets": schema.FRAME_SETS, "mappings": schema.MAPPINGS, "data_blocks": schema.DATA_BLOCKS, "particle_values": schema.PARTICLE_VALUES, "frame_values": schema.FRAME_VALUES,
    "static_particle_values": "block_id long, particle long, values array<double>", "static_values": "block_id long, values array<double>, strings array<string>",
    "blocks": "path string, at long, header_size long, size long, block_id long, name string, version long, hash_ok boolean",
}
#: Tables whose rows belong to frame sets.
OF_SETS = ("frame_sets", "mappings", "data_blocks", "particle_values", "frame_values", "molecule_counts")
#: Frame sets of a partition, at most, and their bytes, about.
SETS, BYTES = 1000, 64 << 20


class Sets(InputPartition):
    def __init__(self, path: str, sets: list[tuple[int, int]], top: bool):
        self.path, self.sets, self.top = path, sets, top  # sets: (ordinal, place); top: with what precedes them


class Bounds(NamedTuple):
    """What is to be read: block ids, and first and last frame and frame set."""

    ids: frozenset[int] | None = None
    frames: tuple[float, float] = (-np.inf, np.inf)
    sets: tuple[float, float] = (-np.inf, np.inf)


class Layout:
    """Places of all frame sets of a path's files, by headers alone. Ordinals go on from file to file."""

    def __init__(self, path: str, bounds: Bounds = Bounds()):
        self.files: list[tuple[str, list[tuple[int, int, int]]]] = []
        ordinal = 0
        for name in bf.listed(path):
            with bf.open_read(name) as source:
                file = bf.File(source)
                general, molecules, _ = file.top()
                own = []
                for h, s in file.frame_sets(len(molecules), bool(general.get("var_num_atoms"))):
                    last = s["first_frame"] + s["n_frames"] - 1
                    if bounds.frames[0] <= last and s["first_frame"] <= bounds.frames[1] and bounds.sets[0] <= ordinal <= bounds.sets[1]:
                        own.append((ordinal, h.at, s["next"]))
                    ordinal += 1
                self.files.append((name, own))
        self.n = ordinal

    def partitions(self, first: int = 0, last: int | None = None, top: bool = False) -> list[Sets]:
        out = []
        for name, own in self.files:
            part: list[tuple[int, int]] = []
            start = 0
            for ordinal, at, _ in own:
                if first <= ordinal and (last is None or ordinal < last):
                    if part and (len(part) >= SETS or at - start > BYTES):
                        out.append(Sets(name, part, False))
                        part = []
                    start = start if part else at
                    part.append((ordinal, at))
            if part:
                out.append(Sets(name, part, False))
            if top:
                out.append(Sets(name, [], True))
        return out


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    names, kinds = zip(*(x.split(" ", 1) for x in TABLES[kind].split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _value_batch(names: list[str], scalars: list[np.ndarray], values: np.ndarray) -> pa.RecordBatch:
    """values: a row of numbers for each row of the batch."""
    n, width = values.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values, float).ravel()))
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x, np.int64)) for x in scalars), lists], names=names)


def read_top(table: str, file: bf.File, path: str) -> Iterator[pa.RecordBatch]:
    """Rows of tables that belong to a whole file."""
    general, molecules, static = file.top()
    rows: list[tuple] = []
    if table == "general_info":
        rows = [tuple(general.get(x.split()[0]) for x in schema.GENERAL_INFO.split(", "))]
    elif table == "molecules":
        rows = [(i, m["id"], m["name"], m["quaternary"], len(m["chains"]), len(m["residues"]), len(m["atoms"]), len(m["bonds"])) for i, m in enumerate(molecules)]
    elif table == "molecule_counts" and not general.get("var_num_atoms"):
        rows = [(None, i, m["cnt"]) for i, m in enumerate(molecules)]
    elif table == "chains":
        rows = [(i, k, *x) for i, m in enumerate(molecules) for k, x in enumerate(m["chains"])]
    elif table == "residues":
        rows = [(i, k, r, c, n) for i, m in enumerate(molecules) for k, (c, r, n) in enumerate(m["residues"])]
    elif table == "atoms":
        rows = [(i, k, a, r, n, t) for i, m in enumerate(molecules) for k, (r, a, n, t) in enumerate(m["atoms"])]
    elif table == "bonds":
        rows = [(i, k, *x) for i, m in enumerate(molecules) for k, x in enumerate(m["bonds"])]
    elif table == "blocks":
        rows = [(path, h.at, h.header_size, h.size, h.block_id, h.name, h.version, file.verified(h, file.content(h))) for h in file.headers()]
    elif table in ("static_values", "static_particle_values", "data_blocks"):
        for h in static:
            if not schema.is_data_block(h.block_id):
                continue
            b = bf.read_block(file, h, None)
            if table == "data_blocks":
                rows.append((b.block_id, None, b.name, bf.TYPE_NAMES[b.dtype], b.meta["dependency"], None, None, None, b.meta["n_values"], b.codec, b.multiplier, b.hash_ok))
            elif table == "static_values" and not b.by_particle:
                flat = b.values.ravel().tolist()
                rows.append((b.block_id, None, flat) if b.dtype == bf.CHAR else (b.block_id, flat, None))
            elif table == "static_particle_values" and b.by_particle and b.dtype != bf.CHAR:
                rows += [(b.block_id, b.first_particle + i, v.tolist()) for i, v in enumerate(b.values[0])]
    if rows:
        yield _batch(table, rows)


def read_set(table: str, file: bf.File, ordinal: int, at: int, general: dict, molecules: list[dict], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Rows of one frame set."""
    h = file.header(at)
    s = bf.read_frame_set(file.cursor(h), len(molecules) if general.get("var_num_atoms") else 0, h.version)
    if table == "frame_sets":
        counts = s["counts"] or [m["cnt"] for m in molecules]
        yield _batch(table, [(ordinal, s["first_frame"], s["n_frames"], s["first_time"], s["time_per_frame"], sum(len(m["atoms"]) * c for m, c in zip(molecules, counts, strict=True)))])
        return
    if table == "molecule_counts":
        if s["counts"]:
            yield _batch(table, [(ordinal, i, c) for i, c in enumerate(s["counts"])])
        return
    wanted = [b for b in file.blocks_of(h) if b.block_id == schema.MAPPING_BLOCK or bounds.ids is None or b.block_id in bounds.ids]
    mappings = [bf.read_mapping(file.cursor(b)) for b in wanted if b.block_id == schema.MAPPING_BLOCK]
    if table == "mappings":
        if rows := [(ordinal, first + i, int(x)) for first, numbers in mappings for i, x in enumerate(numbers)]:
            yield _batch(table, rows)
        return
    for b in wanted:
        if not schema.is_data_block(b.block_id):
            continue
        if table == "data_blocks":
            m = bf.read_meta(file.cursor(b), s)
            yield _batch(table, [(b.block_id, ordinal, b.name, bf.TYPE_NAMES[m["dtype"]], m["dependency"], m["first_frame"], m["n_frames"], m["stride"], m["n_values"], m["codec"], m["multiplier"], file.verified(b, file.content(b)))])
            continue
        block = bf.read_block(file, b, s)
        if block.dtype == bf.CHAR or block.by_particle != (table == "particle_values"):
            continue
        frames = block.first_frame + block.stride * np.arange(len(block.values)) if block.by_frame else np.array([s["first_frame"]])
        on = (frames >= bounds.frames[0]) & (frames <= bounds.frames[1])
        frames, values = frames[on], block.values[on]
        if table == "frame_values":
            yield _value_batch(["block_id", "frame_set", "frame", "values"], [np.full(len(frames), block.block_id), np.full(len(frames), ordinal), frames], values[:, 0])
            continue
        n = values.shape[1]
        particles = bf.real_numbers(block.first_particle + n, mappings)[block.first_particle :]
        for k in range(0, len(frames), max(1, 65536 // max(n, 1))):
            part = slice(k, k + max(1, 65536 // max(n, 1)))
            count = len(frames[part])
            keep = np.tile(particles >= 0, count)
            scalars = [np.full(count * n, block.block_id), np.full(count * n, ordinal), np.repeat(frames[part], n), np.tile(particles, count)]
            yield _value_batch(["block_id", "frame_set", "frame", "particle", "values"], [x[keep] for x in scalars], values[part].reshape(count * n, -1)[keep])


def read_partition(table: str, partition: Sets | None, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    if not isinstance(partition, Sets):  # Spark asks for one partition where there is none
        return
    with bf.open_read(partition.path) as source:
        file = bf.File(source)
        if partition.top:
            yield from read_top(table, file, partition.path)
            return
        general, molecules, _ = file.top()
        for ordinal, at in partition.sets:
            yield from read_set(table, file, ordinal, at, general, molecules, bounds)


def bounds_of(options: dict) -> Bounds:
    number = lambda name, other: float(options[name]) if options.get(name) not in (None, "") else other
    ids = frozenset(int(x) for x in options["block_ids"].split(",")) if options.get("block_ids") else None
    return Bounds(ids, (number("first_frame", -np.inf), number("last_frame", np.inf)), (number("first_set", -np.inf), number("last_set", np.inf)))


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, bounds: Bounds = Bounds()):
        self.path, self.table, self.bounds = path, table, bounds

    def partitions(self):
        if self.table not in OF_SETS:
            files = bf.listed(self.path)
            return [Sets(f, [], True) for f in (files if self.table == "blocks" else files[:1])]
        whole_file_rows = self.table in ("data_blocks", "molecule_counts")
        found = Layout(self.path, self.bounds).partitions()
        return found + [Sets(f, [], True) for f in bf.listed(self.path)[: int(whole_file_rows)]]

    def read(self, partition):
        yield from read_partition(self.table, partition, self.bounds)


class StreamReader(DataSourceStreamReader):
    """New frame sets of a growing path. A set counts once it is written as a whole, with its links."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def initialOffset(self) -> dict:
        return {"set": 0}

    def latestOffset(self) -> dict:
        return {"set": Layout(self.path).n}

    def partitions(self, start: dict, end: dict):
        return Layout(self.path).partitions(start["set"], end["set"])

    def read(self, partition):
        yield from read_partition(self.table, partition, Bounds())

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter):
    """Rows: frame_set, meta (its own fields as JSON), body (bytes), as operators.storage.encoded() makes them. Files become visible
    by their names only when all tasks are done."""

    def __init__(self, path: str, header: bytes):
        self.path, self.header = path.rstrip("/"), header

    def write(self, iterator):
        general, molecules, static = pickle.loads(self.header)
        sets = sorted(((r["frame_set"], json.loads(r["meta"]), bytes(r["body"])) for r in iterator), key=lambda x: x[0])
        if not sets:
            return Written([])
        name = f"sets-{sets[0][0]:012d}-{uuid.uuid4().hex}"
        with bf.open_write(f"{self.path}/_{name}") as out:
            for part in bf.file_bytes(general, molecules, static, [(m, body) for _, m, body in sets]):
                out.write(part)
        return Written([name])

    def commit(self, messages):
        for m in messages:
            for name in m.names if m else ():
                _rename(f"{self.path}/_{name}", f"{self.path}/{name}")

    def abort(self, messages):
        for m in messages:
            for name in m.names if m else ():
                _delete(f"{self.path}/_{name}")


def _store(path: str):
    return bf.fs.FileSystem.from_uri(path) if "://" in path else (bf.fs.LocalFileSystem(), path.removeprefix("file:"))


def _rename(a: str, b: str) -> None:
    store, inner = _store(a)
    store.move(inner, _store(b)[1])


def _delete(path: str) -> None:
    store, inner = _store(path)
    store.delete_file(inner)


def emptied(path: str) -> None:
    """Deletes the files of a path, if there are any."""
    try:
        old = bf.listed(path)
    except FileNotFoundError:
        return
    for name in old:
        _delete(name)


class TrajectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "particle_values")
        if table not in TABLES:
            raise ValueError(f"no such table: {table}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema):
        return Reader(self.options["path"], self._table(), bounds_of(self.options))

    def streamReader(self, schema):
        table = self._table()
        if table not in OF_SETS:
            raise ValueError(f"{table} can't be read as a stream")
        return StreamReader(self.options["path"], table)

    def writer(self, schema, overwrite: bool):
        if overwrite:
            emptied(self.options["path"])
        return Writer(self.options["path"], base64.b64decode(self.options["header"]))


def register(spark) -> None:
    spark.dataSource.register(TrajectorySource)
