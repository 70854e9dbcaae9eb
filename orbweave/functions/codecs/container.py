"""The codec container of a frame set's positions or velocities, and the choice of codecs.

A container: a mark that tells positions from velocities, atoms, frames, codec and parameter of the first frame and of the others, the precision as
two words, and the coded parts with their lengths. The first frame is coded by itself (1:1 or as differences inside it), the others 1:1,
as differences inside frames or from the frame before.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from ..numeric import precision_of_record
from . import entropy, instructions, simple
from .bits import zigzag

#: Marks, and codecs' ids for positions and for velocities.
POSITIONS, VELOCITIES = 0x544E4750, 0x544E4756
STOP_INTER, TRIPLET_INTER, TRIPLET_INTRA, BIT_FORM, TRIPLET, CHAIN_INTER, CHAIN_INTRA, STREAM_FORM = 1, 2, 3, 5, 7, 8, 9, 10
V_STOP, V_TRIPLET_INTER, V_TRIPLET, V_STOP_INTER, V_CHAIN_INTER, V_CHAIN = 1, 2, 3, 6, 8, 9
AUTO, NO_CODEC = -1, 0
SPEED, LEAST_SPEED, MOST_SPEED = 2, 1, 6
PARAMETERS = range(1, 20)
#: Codecs are chosen on so many frames.
SAMPLE_FRAMES = 5


class Way(NamedTuple):
    coder: str  # stop, triplet, bits, streams or chain
    view: str  # plain, inter or intra


WAYS = {
    POSITIONS: {STOP_INTER: Way("stop", "inter"), TRIPLET_INTER: Way("triplet", "inter"), TRIPLET_INTRA: Way("triplet", "intra"), BIT_FORM: Way("bits", "plain"), TRIPLET: Way("triplet", "plain"), CHAIN_INTER: Way("chain", "inter"), CHAIN_INTRA: Way("chain", "intra"), STREAM_FORM: Way("streams", "plain")},
    VELOCITIES: {V_STOP: Way("stop", "plain"), V_TRIPLET_INTER: Way("triplet", "inter"), V_TRIPLET: Way("triplet", "plain"), V_STOP_INTER: Way("stop", "inter"), V_CHAIN_INTER: Way("chain", "inter"), V_CHAIN: Way("chain", "plain")},
}
#: Candidates in their order, each from a speed on. Of equal sizes the first stays.
FIRST = {POSITIONS: ((BIT_FORM, 1), (TRIPLET_INTRA, 1), (TRIPLET, 1), (STREAM_FORM, 2), (CHAIN_INTRA, 6)), VELOCITIES: ((V_STOP, 1), (V_TRIPLET, 1), (V_CHAIN, 4))}
REST = {
    POSITIONS: ((BIT_FORM, 1), (STOP_INTER, 1), (TRIPLET_INTER, 1), (TRIPLET_INTRA, 1), (TRIPLET, 1), (CHAIN_INTER, 4), (CHAIN_INTRA, 6)),
    VELOCITIES: ((V_STOP, 1), (V_TRIPLET_INTER, 1), (V_TRIPLET, 1), (V_STOP_INTER, 1), (V_CHAIN_INTER, 4), (V_CHAIN, 4)),
}


def quantised(x: np.ndarray, precision: float) -> np.ndarray:
    """Half goes up. Values beyond 32 bits are an error."""
    scaled = np.asarray(x, float) / precision + 0.5
    if not (np.abs(scaled) < 2147483647).all():
        raise OverflowError("value out of range at this precision")
    return np.floor(scaled).astype(np.int64)


def views(q: np.ndarray, n_atoms: int) -> dict[str, np.ndarray]:
    frames = np.asarray(q, np.int64).reshape(-1, n_atoms, 3)
    return {"plain": frames, "inter": np.diff(frames, axis=0, prepend=np.zeros((1, n_atoms, 3), np.int64)), "intra": np.diff(frames, axis=1, prepend=np.zeros((len(frames), 1, 3), np.int64))}


def undone(d: np.ndarray, view: str, n_atoms: int, first: np.ndarray | None = None) -> np.ndarray:
    frames = np.asarray(d, np.int64).reshape(-1, n_atoms, 3)
    if view == "inter":
        return np.cumsum(frames, 0) + (0 if first is None else first)
    return np.cumsum(frames, 1) if view == "intra" else frames


def pack(q: np.ndarray, coder: str, parameter: int, n_atoms: int, speed: int = SPEED) -> bytes:
    q = np.asarray(q, np.int64).ravel()
    if coder == "stop":
        return simple.stop_bits_encode(q, parameter)
    if coder == "triplet":
        return simple.triplets_encode(q, parameter)
    if coder == "bits":
        return instructions.bits_encode(q)
    if coder == "streams":
        return instructions.streams_encode(q, n_atoms, speed)
    return entropy.frames_chain_encode(q, n_atoms, speed >= 5)


def unpack(data: bytes, coder: str, parameter: int, n: int, n_atoms: int) -> np.ndarray:
    if coder == "stop":
        return simple.stop_bits_decode(data, n, parameter)
    if coder == "triplet":
        return simple.triplets_decode(data, n, parameter)
    if coder == "bits":
        return instructions.bits_decode(data, n)
    if coder == "streams":
        return instructions.streams_decode(data, n, n_atoms)
    return entropy.frames_chain_decode(data, n, n_atoms)


def _widths(z: np.ndarray) -> np.ndarray:
    """Numbers by their bits."""
    bits = np.frexp(z.astype(float))[1]
    return np.bincount(np.where(z > 0, bits, 0), minlength=33)


def _stop_cost(width: int, parameter: int) -> int:
    total = 0
    while True:
        total += parameter + 1
        if width <= parameter:
            return total
        width -= parameter
        parameter = max(1, parameter // 2)


def best_parameter(q: np.ndarray, coder: str) -> tuple[int, int]:
    """The parameter of the least estimated size (the first of equals), and the size."""
    z = zigzag(q).ravel()
    if coder == "stop":
        n = _widths(z)
        sizes = [-(-int(sum(n[w] * _stop_cost(w, p) for w in np.flatnonzero(n))) // 8) for p in PARAMETERS]
    else:
        n = _widths(z[: len(z) // 3 * 3].reshape(-1, 3).max(1, initial=0))
        most = int(z.max(initial=0)).bit_length()
        size = lambda w, p: 2 + 3 * next((p + k for k in range(3) if w <= p + k), max(p, most))
        sizes = [-(-(32 + int(sum(n[w] * size(w, p) for w in np.flatnonzero(n)))) // 8) for p in PARAMETERS]
    return PARAMETERS[int(np.argmin(sizes))], min(sizes)


def choose(q: np.ndarray, n_atoms: int, mark: int, first: bool, speed: int = SPEED) -> tuple[int, int]:
    """Codec and parameter of the least size for the first frame, or for the others of q."""
    speed = min(max(speed, LEAST_SPEED), MOST_SPEED)
    seen, best = views(q, n_atoms), None
    for codec, from_speed in (FIRST if first else REST)[mark]:
        if speed < from_speed:
            continue
        way = WAYS[mark][codec]
        part = seen[way.view][:1] if first else seen[way.view][1:]
        if not first and way.coder == "chain" and speed < 6 and int((zigzag(part) >= 16384).sum()) > part.size // 10:
            continue
        parameter, size = best_parameter(part, way.coder) if way.coder in ("stop", "triplet") else (0, len(pack(part, way.coder, 0, n_atoms, speed)))
        if best is None or size < best[0]:
            best = size, codec, parameter
    return best[1:]


def compress_quantised(q: np.ndarray, n_atoms: int, precision: float, mark: int = POSITIONS, speed: int = SPEED, algorithms: tuple[int, int, int, int] | None = None) -> bytes:
    """q: frames of n_atoms triplets. algorithms: codec and parameter of the first frame and of the others, AUTO to choose. A parameter of
    AUTO is chosen for the codec given."""
    seen = views(q, n_atoms)
    n_frames = len(seen["plain"])
    ways, wanted = WAYS[mark], list(algorithms or (AUTO,) * 4)
    for k, first in ((0, True), (2, False)):
        if not first and n_frames < 2:
            wanted[2:] = NO_CODEC, 0
        elif wanted[k] == AUTO:
            wanted[k : k + 2] = choose(seen["plain"][: SAMPLE_FRAMES + 1], n_atoms, mark, first, speed)
        elif wanted[k + 1] == AUTO:
            way = ways[wanted[k]]
            wanted[k + 1] = best_parameter(seen[way.view][:1] if first else seen[way.view][1:], way.coder)[0] if way.coder in ("stop", "triplet") else 0
    whole = abs(precision)
    high, low = min(int(whole), 0x7FFFFFFF) | (0x80000000 if precision < 0 else 0), int((whole - int(whole)) * 0xFFFFFFFF)
    out = [struct.pack("<9I", mark, n_atoms, n_frames, *wanted, low, high)]
    for codec, parameter, part in ((*wanted[:2], slice(0, 1)), (*wanted[2:], slice(1, None))):
        if codec == NO_CODEC:
            continue
        way = ways[codec]
        coded = pack(seen[way.view][part], way.coder, parameter, n_atoms, speed)
        out.append(struct.pack("<I", len(coded)) + coded)
    return b"".join(out)


def uncompress_quantised(data: bytes) -> tuple[np.ndarray, float, int]:
    """Quantised frames (frames, atoms, 3), the precision, and the mark."""
    mark, n_atoms, n_frames, c1, p1, c2, p2, low, high = struct.unpack_from("<9I", data)
    if mark not in WAYS:
        raise ValueError("not a codec container")
    precision = (high & 0x7FFFFFFF) + low * (1.0 / 0xFFFFFFFF)
    at, parts, first = 36, [], None
    for codec, parameter, frames in ((c1, p1, min(n_frames, 1)), (c2, p2, n_frames - 1)):
        if frames <= 0:
            continue
        (size,) = struct.unpack_from("<I", data, at)
        way = WAYS[mark][codec]
        found = unpack(data[at + 4 : at + 4 + size], way.coder, parameter, frames * n_atoms * 3, n_atoms)
        at += 4 + size
        parts.append(undone(found, way.view, n_atoms, first))
        first = parts[0][0]
    q = np.concatenate(parts) if parts else np.zeros((0, n_atoms, 3), np.int64)
    return q, -precision if high & 0x80000000 else precision, mark


def compress(x: np.ndarray, n_atoms: int, precision: float, mark: int = POSITIONS, speed: int = SPEED, algorithms: tuple[int, int, int, int] | None = None) -> bytes:
    """x: values of whole frames. The precision is the one that the container can store."""
    return compress_quantised(quantised(x, precision_of_record(precision)), n_atoms, precision, mark, speed, algorithms)


def uncompress(data: bytes) -> np.ndarray:
    q, precision, _ = uncompress_quantised(data)
    return q * precision
