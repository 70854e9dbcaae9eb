"""Bit streams, most significant bit first, written and read as whole arrays."""

from __future__ import annotations

import numpy as np


def packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """The low widths[i] bits (64 at most) of each of values, one after the other, filled up with zeros to a byte."""
    values, widths = np.asarray(values, np.uint64), np.asarray(widths, np.int64)
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    which = np.repeat(np.arange(len(values)), widths)
    left = ends[which] - 1 - np.arange(total)  # bits of the value after this one
    return np.packbits(((values[which] >> left.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()


def bits_of(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))


def windows(bits: np.ndarray, width: int) -> np.ndarray:
    """The number in the width bits (32 at most) from each place on; zeros follow the end."""
    padded = np.concatenate((bits, np.zeros(width, np.uint8))).astype(np.uint64)
    out = np.zeros(len(bits), np.uint64)
    for i in range(width):
        out = (out << np.uint64(1)) | padded[i : i + len(bits)]
    return out


def fields(bits: np.ndarray, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Numbers of given widths at given places."""
    starts = np.asarray(starts, np.int64)
    widths = np.broadcast_to(np.asarray(widths, np.int64), starts.shape)
    out = np.zeros(len(starts), np.uint64)
    for i in range(int(widths.max(initial=0))):
        on = i < widths
        out[on] = (out[on] << np.uint64(1)) | bits[starts[on] + i].astype(np.uint64)
    return out


def chain(following: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """start, following[start], and so on: n places. It tells where each of n codes begins, if following says where the next
    begins for a code at any place."""
    steps, at = following.tolist(), start
    out = [0] * n
    for i in range(n):
        out[i] = at
        at = steps[at]
    return np.array(out, np.int64)


class Reader:
    """One field after another, for streams whose fields tell what follows."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, width: int) -> int:
        first, last = self.at // 8, (self.at + width + 7) // 8
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - width)
        self.at += width
        return value & ((1 << width) - 1)


class Writer:
    """Fields of any width; joined at the end."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.widths: list[int] = []

    def write(self, value: int, width: int) -> None:
        while width > 64:
            width -= 64
            self.values.append((value >> width) & 0xFFFFFFFFFFFFFFFF)
            self.widths.append(64)
        self.values.append(value & ((1 << width) - 1))
        self.widths.append(width)

    def done(self) -> bytes:
        return packed(np.array(self.values, np.uint64), np.array(self.widths, np.int64))


def zigzag(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, np.int64)
    return np.where(q > 0, 2 * q - 1, -2 * q)


def unzigzag(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    half = (v + 1) // 2
    return np.where(v % 2 == 0, -half, half)
