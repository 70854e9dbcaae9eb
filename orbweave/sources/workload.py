"""The made-up trajectories that published codec sizes are for, a frame at a time in numpy.

A frame is a row of chains of atoms in an integer box. Chains grow by an atom each up to 30, then start anew; each winds along sines of its own
steps, or, if it starts at a multiple of ten atoms, strides across the box. All frames have the same layout, so it is computed once, and
a chunk of frames is one array expression. Values that leave the box come back at its other side.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: A sine's steps and height, the longest chain, the number of scales.
STEPS, HEIGHT, LONGEST, SCALES = 128, 65535, 30, 5


class Case(NamedTuple):
    """A published size: bytes of a file of containers, with the settings it was made with."""

    test: int
    atoms: int
    frames: int
    chunk: int  # frames of a container
    scale: float
    box: int  # largest integer coordinate
    positions: tuple[int, int, int, int]
    velocities: tuple[int, int, int, int]
    published: int


def sine(i: np.ndarray) -> np.ndarray:
    return np.trunc(HEIGHT * np.sin(2 * np.pi / STEPS * (np.asarray(i, np.int64) % STEPS))).astype(np.int64)


def cosine(i: np.ndarray) -> np.ndarray:
    return sine(np.asarray(i, np.int64) + STEPS // 4)


def _part(v: np.ndarray, by: int) -> np.ndarray:
    """A quotient cut towards zero."""
    return np.sign(v) * (np.abs(v) // by)


def _chains(atoms: int):
    """Of each chain: start, length, and the steps of its sines; of each atom: its chain and its place there."""
    lengths = []
    while (left := atoms - sum(lengths)) > 0:
        lengths.append(min(len(lengths) % LONGEST + 1, left))
    steps = [np.array([1, 1, 1])]
    flips = [False]
    ends = np.cumsum(lengths)
    for end in ends[:-1]:
        steps.append((steps[-1] + 1) % np.array([7, 3, 6]) + 1)
        flips.append(flips[-1] != bool(end % 9))
    chain = np.repeat(np.arange(len(lengths)), lengths)
    starts = ends - lengths
    return starts, ends, np.array(lengths), np.array(steps), np.array(flips), chain, np.arange(atoms) - starts[chain]


def positions(first: int, n: int, atoms: int, box: int) -> np.ndarray:
    """Integer positions (frames, atoms, 3) of n frames from first on."""
    starts, ends, lengths, steps, flips, chain, place = _chains(atoms)
    size, t = box + 1, np.arange(first, first + n)
    origin = np.stack([_part(sine(t), 32), 1 + _part(cosine(t), 32), 2 + _part(sine(t), 16)], 1) % size
    drift = np.where(sine(ends[:, None] * np.array([3, 5, 7])) < 0, -1, 1) * (size // 20)
    drift = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(drift, 0)[:-1]])
    base = (origin[:, None] + drift)[:, chain] % size
    swapped = flips[chain] & (lengths[chain] > 1) & (place < 2)
    own = np.where(swapped, 1 - place, place)
    angles = (own + t[:, None])[..., None] * steps[chain]
    wound = np.concatenate([sine(angles[..., :1]), cosine(angles[..., 1:])], 2) * (chain % SCALES + 1)[:, None]
    strides = (place * (size // 5))[:, None]
    return (base + np.where((starts % 10 == 0)[chain][:, None], strides, _part(wound, 256))) % size


def velocities(first: int, n: int, atoms: int) -> np.ndarray:
    at = np.arange(first, first + n)[:, None] + np.arange(atoms)
    return np.stack([_part(sine(at * 3), 10), 1 + _part(cosine(at * 5), 10), 2 + _part(sine(at * 7) + cosine(at * 9), 20)], 2)
