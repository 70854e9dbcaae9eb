"""The binary trajectory format: a file of blocks. Bytes in, arrays out; nothing here knows of Spark.

A block has a header (sizes, id, MD5, name, version) and contents. First come general information, molecules and static data blocks, then
frame sets, each followed by its mappings and data blocks, and linked to the sets before and after at three distances. Either byte order
is read; files are written little-endian. Paths may be of any store that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
from pyarrow import fs

from .. import schema
from ..functions.codecs import container

VERSION = 8
CHAR, INT, FLOAT, DOUBLE = range(4)
TYPES = {INT: "i8", FLOAT: "f4", DOUBLE: "f8"}
TYPE_NAMES = {CHAR: "char", INT: "int", FLOAT: "float", DOUBLE: "double"}
RAW, OLD, QUANTISED, ZLIB = range(4)
NO_HASH = b"\0" * 16
GENERAL_STRINGS = "program_first program_last user_first user_last computer_first computer_last pgp_first pgp_last forcefield".split()
#: Bytes read at once to find a header; headers are shorter unless a name is long.
HEADER_READ = 4096


def open_read(path: str) -> BinaryIO:
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def open_write(path: str) -> BinaryIO:
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    store.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    return store.open_output_stream(inner)


def listed(path: str) -> list[str]:
    """The files of a path: itself, or those of a folder in their names' order."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found = store.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type != fs.FileType.Directory:
        return [path]
    prefix = path.rstrip("/")
    return sorted(f"{prefix}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name[0] not in "._")


@dataclass
class Header:
    at: int
    header_size: int
    size: int
    block_id: int
    md5: bytes
    name: str
    version: int

    @property
    def content_at(self) -> int:
        return self.at + self.header_size

    @property
    def end(self) -> int:
        return self.content_at + self.size


class Cursor:
    """Fields of one block's contents."""

    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.order, self.at = data, order, 0

    def take(self, form: str):
        found = struct.unpack_from(self.order + form, self.data, self.at)
        self.at += struct.calcsize(self.order + form)
        return found[0] if len(found) == 1 else found

    def string(self) -> str:
        end = self.data.index(b"\0", self.at)
        raw = self.data[self.at : end]
        self.at = end + 1
        return raw[: schema.MAX_STRING - 1].decode("utf-8", "replace")


def cut(text: str) -> bytes:
    """A string as it is stored: its end included, cut at the start of a character."""
    return text.encode()[: schema.MAX_STRING - 1].decode("utf-8", "ignore").encode() + b"\0"


class File:
    """A file's headers and blocks. Contents are read only when they are asked for."""

    def __init__(self, source: BinaryIO):
        self.source, self.order = source, "<"
        source.seek(0)
        first = source.read(8)
        if len(first) == 8:
            # Header sizes are small: a little-endian one has its bytes in front.
            self.order = "<" if first[0] != 0 and first[7] == 0 else ">"

    def header(self, at: int) -> Header | None:
        self.source.seek(at)
        raw = self.source.read(HEADER_READ)
        if len(raw) < 48:
            return None
        header_size, size, block_id = struct.unpack_from(self.order + "QQQ", raw)
        if header_size == 0:
            return None
        if header_size > len(raw):
            self.source.seek(at)
            raw = self.source.read(header_size)
        end = raw.index(b"\0", 40)
        (version,) = struct.unpack_from(self.order + "Q", raw, end + 1)
        return Header(at, header_size, size, block_id, raw[24:40], raw[40:end].decode("utf-8", "replace"), version)

    def headers(self, at: int = 0) -> Iterator[Header]:
        while (found := self.header(at)) is not None:
            yield found
            at = found.end

    def content(self, header: Header) -> bytes:
        self.source.seek(header.content_at)
        return self.source.read(header.size)

    def verified(self, header: Header, content: bytes) -> bool | None:
        """None: there is no hash."""
        return None if header.md5 == NO_HASH else hashlib.md5(content).digest() == header.md5

    def cursor(self, header: Header) -> Cursor:
        return Cursor(self.content(header), self.order)

    def top(self) -> tuple[dict, list[dict], list[Header]]:
        """General information, molecules, and headers of static blocks: all before the first frame set."""
        general: dict = {}
        molecules: list[dict] = []
        static: list[Header] = []
        for h in self.headers():
            if h.block_id == schema.FRAME_SET_BLOCK:
                break
            if h.block_id == schema.GENERAL_INFO_BLOCK:
                general = read_general(self.cursor(h), h.version)
            elif h.block_id == schema.MOLECULES_BLOCK:
                molecules = read_molecules(self.cursor(h), bool(general.get("var_num_atoms")))
            else:
                static.append(h)  # known or not: its id tells
        return general, molecules, static

    def frame_sets(self, n_molecules: int, variable: bool) -> Iterator[tuple[Header, dict]]:
        """Frame sets by their pointers to the next."""
        at = next((h.at for h in self.headers() if h.block_id == schema.FRAME_SET_BLOCK), -1)
        while at >= 0 and (h := self.header(at)) is not None:
            found = read_frame_set(self.cursor(h), n_molecules if variable else 0, h.version)
            yield h, found
            at = found["next"]

    def blocks_of(self, frame_set: Header) -> Iterator[Header]:
        """Headers of a frame set's mappings and data blocks."""
        for h in self.headers(frame_set.end):
            if h.block_id == schema.FRAME_SET_BLOCK:
                return
            yield h


def read_general(c: Cursor, version: int) -> dict:
    out = {n: c.string() for n in GENERAL_STRINGS}
    out |= {"created": c.take("Q"), "var_num_atoms": bool(c.take("B")), "frames_per_set": c.take("q"), "first_set": c.take("q"), "last_set": c.take("q"), "medium_stride": c.take("q"), "long_stride": c.take("q")}
    out["distance_unit_exp"] = c.take("q") if version >= 3 and c.at + 8 <= len(c.data) else None
    return out


def general_bytes(g: dict, first_set: int, last_set: int) -> bytes:
    strings = b"".join(cut(g.get(n) or "") for n in GENERAL_STRINGS)
    exponent = g.get("distance_unit_exp")
    return strings + struct.pack("<QBqqqqqq", g.get("created") or 0, bool(g.get("var_num_atoms")), g.get("frames_per_set") or schema.FRAMES_PER_SET, first_set, last_set, g.get("medium_stride") or schema.MEDIUM_STRIDE, g.get("long_stride") or schema.LONG_STRIDE, -9 if exponent is None else exponent)


def read_molecules(c: Cursor, variable: bool) -> list[dict]:
    """Molecules with chains, residues, atoms and bonds. Files may leave out chains, or chains and residues."""
    out = []
    for _ in range(c.take("q")):
        m = {"id": c.take("q"), "name": c.string(), "quaternary": c.take("q"), "cnt": None if variable else c.take("q"), "chains": [], "residues": [], "atoms": [], "bonds": []}
        n_chains, n_residues, n_atoms = c.take("q"), c.take("q"), c.take("q")

        def atoms(n: int, residue: int | None, m=m) -> None:
            for _ in range(n):
                m["atoms"].append((residue, c.take("q"), c.string(), c.string()))

        def residues(n: int, chain: int | None, m=m, atoms=atoms) -> None:
            for _ in range(n):
                found = c.take("q"), c.string()
                m["residues"].append((chain, *found))
                atoms(c.take("q"), len(m["residues"]) - 1)

        if n_chains > 0:
            for k in range(n_chains):
                m["chains"].append((c.take("q"), c.string()))
                residues(c.take("q"), k)
        elif n_residues > 0:
            residues(n_residues, None)
        else:
            atoms(n_atoms, None)
        m["bonds"] = [(c.take("q"), c.take("q")) for _ in range(c.take("q"))]
        out.append(m)
    return out


def molecules_bytes(molecules: list[dict], variable: bool) -> bytes:
    """molecules: as read_molecules() gives them; residues of a chain, and atoms of a residue, follow each other."""
    q = lambda *x: struct.pack(f"<{len(x)}q", *x)
    out = [q(len(molecules))]
    for m in molecules:
        out += [q(m["id"]), cut(m["name"]), q(m.get("quaternary") or 0), b"" if variable else q(m["cnt"] or 0), q(len(m["chains"]), len(m["residues"]), len(m["atoms"]))]
        atoms = lambda r, m=m: [x for x in m["atoms"] if x[0] == r]

        def put_atoms(own: list) -> None:
            for _, atom_id, name, kind in own:
                out.extend((q(atom_id), cut(name), cut(kind)))

        def put_residues(chain: int | None, m=m, atoms=atoms, put_atoms=put_atoms) -> None:
            for i, (of, res_id, name) in enumerate(m["residues"]):
                if of == chain:
                    own = atoms(i)
                    out.extend((q(res_id), cut(name), q(len(own))))
                    put_atoms(own)

        if m["chains"]:
            for k, (chain_id, name) in enumerate(m["chains"]):
                out.extend((q(chain_id), cut(name), q(sum(r[0] == k for r in m["residues"]))))
                put_residues(k)
        elif m["residues"]:
            put_residues(None)
        else:
            put_atoms(m["atoms"])
        out.append(q(len(m["bonds"])))
        out += [q(a, b) for a, b in m["bonds"]]
    return b"".join(out)


POINTERS = "next prev medium_next medium_prev long_next long_prev".split()


def read_frame_set(c: Cursor, n_counts: int, version: int) -> dict:
    out = {"first_frame": c.take("q"), "n_frames": c.take("q"), "counts": [c.take("q") for _ in range(n_counts)]}
    out |= {n: c.take("q") for n in POINTERS}
    out["first_time"], out["time_per_frame"] = c.take("dd") if version >= 3 and c.at + 16 <= len(c.data) else (None, None)
    return {n: None if n in ("first_time", "time_per_frame") and x is not None and x < 0 else x for n, x in out.items()}


def frame_set_bytes(s: dict, pointers: tuple[int, ...] = (-1,) * 6) -> bytes:
    counts = s.get("counts") or []
    times = (-1.0 if s.get(n) is None else s[n] for n in ("first_time", "time_per_frame"))
    return struct.pack(f"<qq{len(counts)}q6qdd", s["first_frame"], s["n_frames"], *counts, *pointers, *times)


def read_mapping(c: Cursor) -> tuple[int, np.ndarray]:
    first, n = c.take("q"), c.take("q")
    return first, np.frombuffer(c.data, c.order + "i8", n, c.at).astype(np.int64)


def mapping_bytes(first: int, numbers: np.ndarray) -> bytes:
    return struct.pack("<qq", first, len(numbers)) + np.asarray(numbers, "<i8").tobytes()


@dataclass
class Block:
    """A data block. values: rows of frames, particles and values (frames or particles are 1 where it doesn't depend on them)."""

    block_id: int
    name: str
    values: np.ndarray
    by_frame: bool = True
    by_particle: bool = True
    first_frame: int = 0
    stride: int = 1
    first_particle: int = 0
    dtype: int = DOUBLE
    codec: int = RAW
    multiplier: float = 1.0
    n_frames: int = 1
    hash_ok: bool | None = None
    meta: dict = field(default_factory=dict)


def read_meta(c: Cursor, frame_set: dict | None) -> dict:
    dtype, dependency = c.take("B"), c.take("B")
    by_frame, by_particle = bool(dependency & schema.DEPENDS_ON_FRAME), bool(dependency & schema.DEPENDS_ON_PARTICLE)
    sparse = bool(c.take("B")) if by_frame else False
    n_values, codec = c.take("q"), c.take("q")
    multiplier = c.take("d") if codec != RAW else 1.0
    first, stride = c.take("qq") if sparse else (frame_set["first_frame"] if frame_set else 0, 1)
    first_particle, n_particles = c.take("qq") if by_particle else (0, 1)
    n_frames = 1
    if by_frame and frame_set:
        n_frames = frame_set["n_frames"] - (first - frame_set["first_frame"])
    return {"dtype": dtype, "dependency": dependency, "by_frame": by_frame, "by_particle": by_particle, "sparse": sparse, "n_values": n_values, "codec": codec if codec in (OLD, QUANTISED, ZLIB) else RAW, "multiplier": multiplier, "first_frame": first, "stride": max(1, stride), "first_particle": first_particle, "n_particles": n_particles, "n_frames": n_frames}


def stored_frames(meta: dict) -> int:
    return (meta["n_frames"] - 1) // meta["stride"] + 1 if meta["by_frame"] and meta["n_frames"] > 0 else 1


def read_block(file: File, h: Header, frame_set: dict | None) -> Block:
    content = file.content(h)
    c = Cursor(content, file.order)
    m = read_meta(c, frame_set)
    rows, payload = stored_frames(m), content[c.at :]
    n = rows * m["n_particles"] * m["n_values"]
    if m["codec"] == OLD:
        raise NotImplementedError("the first version of the coordinate codec isn't supported")
    if m["codec"] == QUANTISED:
        values = container.uncompress(payload).ravel()
    elif m["dtype"] == CHAR:
        if m["codec"] == ZLIB:
            payload = zlib.decompress(payload)
        strings = payload.split(b"\0")[:n]
        values = np.array([s.decode("utf-8", "replace") for s in strings], object)
    else:
        kind = np.dtype(file.order + TYPES[m["dtype"]])
        if m["codec"] == ZLIB:
            payload = zlib.decompress(payload)
            if len(payload) != n * kind.itemsize:
                raise ValueError(f"block {h.block_id:#x}: {len(payload)} bytes where {n * kind.itemsize} were stored")
        values = np.frombuffer(payload, kind, n).astype(float)
    values = values.reshape(rows, m["n_particles"], m["n_values"])
    return Block(h.block_id, h.name, values, m["by_frame"], m["by_particle"], m["first_frame"], m["stride"], m["first_particle"], m["dtype"], m["codec"], m["multiplier"], m["n_frames"], file.verified(h, content), m)


def block_content(b: Block, frame_set: dict | None, precision: float = 0.001, speed: int = container.SPEED) -> bytes:
    """Contents of a data block. The quantising codec holds positions and velocities of real types; what it can't is stored raw."""
    values, codec = b.values, b.codec
    n_particles, n_values = (values.shape[1], values.shape[2]) if values.ndim == 3 else (1, values.shape[-1])
    if n_values <= 0:
        raise ValueError("a block has one value at least")
    payload, multiplier = None, b.multiplier
    if codec == QUANTISED:
        mark = {schema.POSITIONS: container.POSITIONS, schema.VELOCITIES: container.VELOCITIES}.get(b.block_id)
        if mark is not None and b.dtype in (FLOAT, DOUBLE) and n_values == 3 and b.by_frame and b.by_particle:
            try:
                payload, multiplier = container.compress(values, n_particles, precision, mark, speed), 1 / precision
            except OverflowError:
                payload = None
        codec = QUANTISED if payload is not None else RAW
    if payload is None:
        payload = b"".join(cut(str(s)) for s in values.ravel()) if b.dtype == CHAR else np.ascontiguousarray(values).astype("<" + TYPES[b.dtype]).tobytes()
        if codec == ZLIB:
            payload = zlib.compress(payload)
    first_of_set = frame_set["first_frame"] if frame_set else 0
    sparse = b.by_frame and (b.stride != 1 or b.first_frame != first_of_set)
    out = struct.pack("<BB", b.dtype, b.by_frame * schema.DEPENDS_ON_FRAME | b.by_particle * schema.DEPENDS_ON_PARTICLE)
    out += struct.pack("<B", sparse) if b.by_frame else b""
    out += struct.pack("<qq", n_values, codec) + (struct.pack("<d", multiplier) if codec != RAW else b"")
    out += struct.pack("<qq", b.first_frame, b.stride) if sparse else b""
    out += struct.pack("<qq", b.first_particle, n_particles) if b.by_particle else b""
    return out + payload


def block_bytes(block_id: int, name: str, content: bytes, hashed: bool = True) -> bytes:
    raw = cut(name)
    digest = hashlib.md5(content).digest() if hashed else NO_HASH
    return struct.pack("<QQQ", 40 + len(raw) + 8, len(content), block_id) + digest + raw + struct.pack("<Q", VERSION) + content


def content_length(block_id: int, name: str, content_size: int) -> int:
    """Bytes of a whole block."""
    return 48 + len(cut(name)) + content_size


FRAME_SET_NAME, MAPPING_NAME = schema.STANDARD_BLOCKS[schema.FRAME_SET_BLOCK], schema.STANDARD_BLOCKS[schema.MAPPING_BLOCK]


def set_body(frame_set: dict, mappings: list[tuple[int, np.ndarray]], blocks: list[Block], hashed: bool = True, precision: float = 0.001, speed: int = container.SPEED) -> bytes:
    """What follows a frame set's own block: blocks without particles, then mappings, then blocks of particles. Blocks whose data
    come before the set are left out."""
    kept = [b for b in blocks if not b.by_frame or b.first_frame >= frame_set["first_frame"]]
    put = lambda b: block_bytes(b.block_id, b.name, block_content(b, frame_set, precision, speed), hashed)
    out = [put(b) for b in kept if not b.by_particle]
    out += [block_bytes(schema.MAPPING_BLOCK, MAPPING_NAME, mapping_bytes(first, numbers), hashed) for first, numbers in mappings]
    return b"".join(out + [put(b) for b in kept if b.by_particle])


def file_bytes(general: dict, molecules: list[dict], static: list[Block], sets: list[tuple[dict, bytes]], hashed: bool = True) -> Iterator[bytes]:
    """A whole file: sets are frame sets with their bodies, as set_body() makes them. All lengths are known beforehand, so pointers need
    no second pass."""
    top = [block_bytes(schema.MOLECULES_BLOCK, schema.STANDARD_BLOCKS[schema.MOLECULES_BLOCK], molecules_bytes(molecules, bool(general.get("var_num_atoms"))), hashed)]
    top += [block_bytes(b.block_id, b.name, block_content(b, None), hashed) for b in static]
    name = schema.STANDARD_BLOCKS[schema.GENERAL_INFO_BLOCK]
    at = len(block_bytes(schema.GENERAL_INFO_BLOCK, name, general_bytes(general, -1, -1))) + sum(map(len, top))
    starts = []
    for s, body in sets:
        starts.append(at)
        at += content_length(schema.FRAME_SET_BLOCK, FRAME_SET_NAME, len(frame_set_bytes(s))) + len(body)
    yield block_bytes(schema.GENERAL_INFO_BLOCK, name, general_bytes(general, starts[0] if starts else -1, starts[-1] if starts else -1), hashed)
    yield from top
    strides = (1, general.get("medium_stride") or schema.MEDIUM_STRIDE, general.get("long_stride") or schema.LONG_STRIDE)
    place = lambda i: starts[i] if 0 <= i < len(starts) else -1
    for i, (s, body) in enumerate(sets):
        yield block_bytes(schema.FRAME_SET_BLOCK, FRAME_SET_NAME, frame_set_bytes(s, tuple(place(j) for n in strides for j in (i + n, i - n))), hashed)
        yield body


def real_numbers(n: int, mappings: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Real numbers of local particles 0 to n - 1; -1 for those that no mapping covers, themselves if there are no mappings."""
    if not mappings:
        return np.arange(n)
    out = np.full(n, -1, np.int64)
    for first, numbers in mappings:
        out[first : first + len(numbers)] = numbers[: max(0, n - first)]
    return out
