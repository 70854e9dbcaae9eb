"""Stop-bit and triplet coders, and the byte codecs. Arrays are coded as wholes; a decoder first finds where codes begin.

Stop bits: a number's low bits in chunks, each with a bit that says whether another follows; the first chunk has parameter bits,
each further one half as many. Triplets: 32 bits of the largest number, then for each three numbers a 2-bit selector of their
width (parameter, 1 or 2 bits more, or the largest's) and the numbers.
"""

from __future__ import annotations

import zlib

import numpy as np

from .bits import bits_of, chain, fields, packed, unzigzag, windows, zigzag


def chunk_widths(parameter: int, bits: int = 34) -> list[int]:
    widths, left = [], bits
    while left > 0:
        widths.append(parameter)
        left -= parameter
        parameter = max(1, parameter // 2)
    return widths


def stop_bits_encode(q: np.ndarray, parameter: int) -> bytes:
    rest, at = zigzag(q).astype(np.uint64), np.arange(len(q))
    order, codes, widths = [], [], []
    for round_, c in enumerate(chunk_widths(parameter)):
        c = np.uint64(c)
        low, rest = rest & ((np.uint64(1) << c) - np.uint64(1)), rest >> c
        more = rest > 0
        order.append(at * 64 + round_)
        codes.append((low << np.uint64(1)) | more)
        widths.append(np.full(len(at), int(c) + 1))
        at, rest = at[more], rest[more]
        if not len(at):
            break
    if not order:
        return b""
    place = np.argsort(np.concatenate(order), kind="stable")
    return packed(np.concatenate(codes)[place], np.concatenate(widths)[place])


def stop_bits_decode(data: bytes, n: int, parameter: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    bits = bits_of(data)
    chunks, size = chunk_widths(parameter), len(bits)
    place = np.arange(size + 1)
    end = np.minimum(place + chunks[-1] + 1, size)
    for c in reversed(chunks[:-1]):  # where a number ends whose chunk of this round starts here
        after = np.minimum(place + c + 1, size)
        more = np.zeros(size + 1, bool)
        more[: max(0, size - c)] = bits[c:] == 1
        end = np.where(more, end[after], after)
    starts = chain(end, n)
    values, shift, live = np.zeros(n, np.int64), 0, np.arange(n)
    for c in chunks:
        at = starts[live]
        values[live] |= fields(bits, at, c).astype(np.int64) << shift
        more = bits[at + c] == 1
        starts[live] += c + 1
        live, shift = live[more], shift + c
        if not len(live):
            break
    return unzigzag(values)


def _most_bits(largest: int, parameter: int) -> int:
    return max(parameter, largest.bit_length())


def triplets_encode(q: np.ndarray, parameter: int) -> bytes:
    z = zigzag(q).astype(np.uint64)
    largest = int(z.max(initial=0))
    most = _most_bits(largest, parameter)
    threes = z[: len(z) // 3 * 3].reshape(-1, 3)
    top = threes.max(1, initial=0)
    selector = np.minimum(sum((top >> np.uint64(parameter + k) > 0).astype(np.int64) for k in range(3)), 3)
    width = np.where(selector == 3, most, parameter + selector)
    values = np.concatenate((np.array([largest], np.uint64), np.column_stack((selector.astype(np.uint64), threes)).ravel()))
    widths = np.concatenate(([32], np.column_stack((np.full(len(threes), 2), width, width, width)).ravel()))
    return packed(values, widths)


def triplets_decode(data: bytes, n: int, parameter: int) -> np.ndarray:
    count = n // 3
    if not count:
        return np.zeros(0, np.int64)
    most = _most_bits(int.from_bytes(data[:4], "big"), parameter)
    bits = bits_of(data[4:])
    selector = windows(bits, 2).astype(np.int64)
    width = np.where(selector == 3, most, parameter + selector)
    starts = chain(np.minimum(np.arange(len(bits)) + 2 + 3 * width, len(bits)), count)
    own = width[starts]
    found = [fields(bits, starts + 2 + k * own, own) for k in range(3)]
    return unzigzag(np.column_stack(found).ravel())


def raw_encode(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def zlib_encode(data: bytes) -> bytes:
    return zlib.compress(data)


def zlib_decode(data: bytes, length: int) -> bytes:
    out = zlib.decompress(data)
    if len(out) != length:
        raise ValueError(f"{len(out)} bytes where {length} were stored")
    return out
