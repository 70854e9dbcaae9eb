"""Run lengths, move-to-front, match coding, block sorting, Huffman codes, and the chain of all of them.

The chain: numbers become 15-bit digits, are block-sorted, split into byte planes, moved to front, shortened by matches or run
lengths, and Huffman-coded, in blocks of BLOCK numbers.
"""

from __future__ import annotations

import heapq
import struct
from itertools import groupby

import numpy as np

from .bits import bits_of, chain, packed, windows

BLOCK = 200_000
#: Matches: the furthest, the longest, remembered places of a symbol, and the least gain of one that overlaps.
FURTHEST, LONGEST, REMEMBERED = 0xFFFF, 0xFFFF, 4
CODE_BITS = 31


def to_digits(v: np.ndarray) -> np.ndarray:
    """15-bit digits, lowest first; bit 15 says that another follows."""
    v = np.asarray(v, np.int64)
    n = np.where(v <= 0x7FFF, 1, np.where(v >> 15 <= 0x7FFF, 2, 3))
    ends = np.cumsum(n)
    which = np.repeat(np.arange(len(v)), n)
    nth = np.arange(len(which)) - (ends - n)[which]
    digit = (v[which] >> (15 * nth)) & np.where(nth == 2, 0x3, 0x7FFF)
    return digit | np.where(nth < n[which] - 1, 0x8000, 0)


def from_digits(d: np.ndarray) -> np.ndarray:
    d = np.asarray(d, np.int64)
    if not len(d):
        return d
    first = np.concatenate(([True], d[:-1] <= 0x7FFF))
    group = np.cumsum(first) - 1
    nth = np.arange(len(d)) - np.flatnonzero(first)[group]
    out = np.zeros(group[-1] + 1, np.int64)
    np.add.at(out, group, (d & 0x7FFF) << (15 * nth))
    return out


def runs_encode(v: np.ndarray, least: int = 1) -> np.ndarray:
    """A run of n > least: the bits of n below its highest, lowest first, then the value + 2. Others: the value + 2, n times."""
    out: list[int] = []
    for value, own in groupby(np.asarray(v).tolist()):
        n = sum(1 for _ in own)
        if n > least:
            while n > 1:
                out.append(n & 1)
                n >>= 1
        out.extend([value + 2] * n)
    return np.array(out, np.int64)


def runs_decode(codes: np.ndarray, n: int) -> np.ndarray:
    values, counts, count, bit, digits = [], [], 0, 1, False
    for c in np.asarray(codes).tolist():
        if c < 2:
            count |= c * bit
            bit <<= 1
            digits = True
            continue
        values.append(c - 2)
        counts.append(count | bit if digits else 1)
        count, bit, digits = 0, 1, False
    return np.repeat(np.array(values, np.int64), counts)[:n]


def front_encode(v: np.ndarray, alphabet: list[int] | None = None) -> np.ndarray:
    """Places in a list (0 to 255, or alphabet) that moves each symbol met to its front."""
    order, out = list(range(256)) if alphabet is None else list(alphabet), []
    for symbol in np.asarray(v).tolist():
        at = order.index(symbol)
        if at:
            del order[at]
            order.insert(0, symbol)
        out.append(at)
    return np.array(out, np.int64)


def front_decode(places: np.ndarray, alphabet: list[int] | None = None) -> np.ndarray:
    order, out = list(range(256)) if alphabet is None else list(alphabet), []
    for at in np.asarray(places).tolist():
        symbol = order[at]
        if at:
            del order[at]
            order.insert(0, symbol)
        out.append(symbol)
    return np.array(out, np.int64)


def planes(v: np.ndarray) -> list[np.ndarray]:
    """The three low bytes of each number, byte by byte."""
    return [(np.asarray(v, np.int64) >> (8 * i)) & 0xFF for i in range(3)]


def front_planes_encode(v: np.ndarray) -> list[np.ndarray]:
    return [front_encode(p) for p in planes(v)]


def front_planes_decode(parts: list[np.ndarray]) -> np.ndarray:
    return sum(front_decode(p) << (8 * i) for i, p in enumerate(parts))


def front_packed_encode(v: np.ndarray) -> np.ndarray:
    return sum(p << (8 * i) for i, p in enumerate(front_planes_encode(v)))


def front_packed_decode(v: np.ndarray) -> np.ndarray:
    return front_planes_decode(planes(v))


def sort_encode(v: np.ndarray) -> tuple[np.ndarray, int]:
    """Last column of the sorted rotations, and the row of v itself. Rotations are ranked by doubled prefixes."""
    v = np.asarray(v, np.int64)
    n = len(v)
    if n == 0:
        return v, 0
    rank = np.unique(v, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * n + np.roll(rank, -width) if rank.max() < n else rank
        order = np.argsort(key, kind="stable")
        steps = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        width *= 2
        if steps[-1] == n - 1 or width >= n:
            break
    return v[order - 1], int(np.flatnonzero(order == 0)[0])


def sort_decode(last: np.ndarray, row: int) -> np.ndarray:
    last = np.asarray(last, np.int64)
    if not len(last):
        return last
    return last[chain(np.argsort(last, kind="stable"), len(last) + 1, row)[1:]]


def matches_encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, lengths, distances. A code is a value + 2, 0 (a match with what is just before) or 1 (at the next distance)."""
    v = np.asarray(v, np.int64)
    n, values = len(v), np.asarray(v).tolist()
    codes, lengths, distances = [], [], []
    places: dict[int, list[int]] = {}
    same = np.flatnonzero(np.concatenate((v[1:] != v[:-1], [True])))  # where runs end
    run_end = same[np.searchsorted(same, np.arange(n))] if n else same
    i = 0
    while i < n:
        symbol, best, at = values[i], 0, 0
        for j in reversed(places.get(symbol, ())):
            if i - j > FURTHEST:
                break
            # Starts inside j's run are as good as j; the last that is still before i is the nearest.
            for k in {j, min(i - 1, int(run_end[j]))}:
                most, size = min(n - i, LONGEST), 0
                while size < most:
                    step = min(most - size, max(16, size))
                    differ = np.flatnonzero(v[k + size : k + size + step] != v[i + size : i + size + step])
                    if len(differ):
                        size += int(differ[0])
                        break
                    size += step
                if size > best and (size >= i - k + 16 or size > 4 and i - k == 1):
                    best, at = size, k
        step = max(best, 1)
        if best:
            codes.append(0 if i - at == 1 else 1)
            lengths.append(best)
            if i - at > 1:
                distances.append(i - at)
        else:
            codes.append(symbol + 2)
        for p in range(max(i, i + step - 64), i + step):  # what a long match repeats needs no more than its end
            own = places.setdefault(values[p], [])
            own.append(p)
            if len(own) > REMEMBERED:
                del own[0]
        i += step
    return tuple(np.array(x, np.int64) for x in (codes, lengths, distances))


def matches_decode(codes: np.ndarray, lengths: np.ndarray, distances: np.ndarray, n: int) -> np.ndarray:
    out: list[int] = []
    next_length, next_distance = iter(np.asarray(lengths).tolist()), iter(np.asarray(distances).tolist())
    for c in np.asarray(codes).tolist():
        if c >= 2:
            out.append(c - 2)
            continue
        size, back = next(next_length), next(next_distance) if c else 1
        part = out[-back:]
        out.extend((part * (size // back + 1))[:size])
    return np.array(out[:n], np.int64)


def dictionary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order, and their counts."""
    return np.unique(np.asarray(v, np.int64), return_counts=True)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code: at least 1, at most CODE_BITS (else all counts are halved, and so on)."""
    weights = np.maximum(np.asarray(counts, np.int64), 1)
    if len(weights) == 1:
        return np.ones(1, np.int64)
    while True:
        n = len(weights)
        heap = [(int(w), -i) for i, w in enumerate(weights)]  # of equal weights, later nodes come first
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[-i] = parent[-j] = new
            heapq.heappush(heap, (a + b, -new))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        lengths = np.array(depth[:n])
        if lengths.max() <= CODE_BITS:
            return lengths
        weights = np.maximum(weights >> 1, 1)


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (length, symbol), and their codes in that order."""
    order = np.argsort(lengths, kind="stable")
    codes, code = [], 0
    own = np.asarray(lengths)[order].tolist()
    for i, n in enumerate(own):
        codes.append(code)
        if i + 1 < len(own):
            code = (code + 1) << (own[i + 1] - n)
    return order, np.array(codes, np.uint64)


def huffman_encode(v: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Codes, and the dictionary: symbols and their codes' lengths."""
    symbols, counts = dictionary(v)
    lengths = code_lengths(counts)
    order, codes = canonical(lengths)
    by_symbol = np.zeros(len(symbols), np.uint64)
    by_symbol[order] = codes
    at = np.searchsorted(symbols, v)
    return packed(by_symbol[at], lengths[at]), symbols, lengths


def huffman_decode(data: bytes, n: int, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    order, codes = canonical(lengths)
    own, sorted_symbols = np.asarray(lengths)[order], np.asarray(symbols)[order]
    bits, most = bits_of(data), int(own.max())
    # Codes filled up to the greatest length ascend, so a window's code is the last that isn't above it.
    filled = codes << (np.uint64(most) - own.astype(np.uint64))
    which = np.searchsorted(filled, windows(bits, most), "right") - 1
    starts = chain(np.minimum(np.arange(len(bits)) + own[which], len(bits) - 1), n)
    return sorted_symbols[which[starts]]


def _u24(x: int) -> bytes:
    return int(x).to_bytes(3, "little")


def _dictionary_pack(symbols: np.ndarray, lengths: np.ndarray) -> bytes:
    """Largest symbol; a bit for each number up to it, and 5 bits of length if it's a symbol."""
    most = int(symbols[-1])
    there = np.zeros(most + 1, np.int64)
    there[symbols] = lengths
    values, widths = np.where(there > 0, 32 | there, 0), np.where(there > 0, 6, 1)
    return _u24(most) + packed(values.astype(np.uint64), widths)


def _dictionary_unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    most, bits = int.from_bytes(data[:3], "little"), bits_of(data[3:])
    starts = chain(np.minimum(np.arange(len(bits)) + np.where(bits == 1, 6, 1), len(bits) - 1), most + 1)
    symbols = np.flatnonzero(bits[starts] == 1)
    width = windows(bits, 6)[starts[symbols]].astype(np.int64) & 31
    return symbols, width


def _dictionary_list(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The dictionary as numbers, to be coded in turn: the largest symbol's bytes, then a length (or 0) for each number."""
    there = np.zeros(int(symbols[-1]) + 1, np.int64)
    there[symbols] = lengths
    return np.concatenate((np.frombuffer(_u24(int(symbols[-1])), np.uint8).astype(np.int64), there))


def _dictionary_unlist(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols = np.flatnonzero(v[3:])
    return symbols, v[3:][symbols]


def _container_parts(v: np.ndarray) -> tuple[bytes, list[bytes]]:
    data, symbols, lengths = huffman_encode(v)
    ours = _dictionary_pack(symbols, lengths)
    plain = _u24(len(ours)) + _u24(len(symbols)) + ours
    listed = _dictionary_list(symbols, lengths)
    coded, s1, l1 = huffman_encode(listed)
    d1 = _dictionary_pack(s1, l1)
    once = _u24(len(listed)) + _u24(len(symbols)) + _u24(len(coded)) + _u24(len(d1)) + _u24(len(s1)) + coded + d1
    short = runs_encode(listed)
    coded, s2, l2 = huffman_encode(short)
    d2 = _dictionary_pack(s2, l2)
    twice = _u24(len(listed)) + _u24(len(symbols)) + _u24(len(short)) + _u24(len(coded)) + _u24(len(d2)) + _u24(len(s2)) + coded + d2
    return data, [plain, once, twice]


def container_encode(v: np.ndarray, digits: bool = True, how: int | None = None) -> bytes:
    """Huffman codes with the smallest form of their dictionary: as it is, coded, or shortened by runs and coded. digits: whether v
    are digits already."""
    own = np.asarray(v, np.int64) if digits else to_digits(v)
    data, parts = _container_parts(own)
    sizes = [len(p) for p in parts]
    if how is None:
        how = 0 if sizes[0] < min(sizes[1:]) else 1 if sizes[1] < sizes[2] else 2
    return struct.pack("<BBIII", int(digits), how, len(own), len(v), len(data)) + data + parts[how]


def container_decode(data: bytes) -> np.ndarray:
    digits, how, n, _, size = struct.unpack_from("<BBIII", data)
    codes, at = data[14 : 14 + size], 14 + size
    u24 = lambda i: int.from_bytes(data[at + 3 * i : at + 3 * i + 3], "little")
    if how == 0:
        symbols, lengths = _dictionary_unpack(data[at + 6 :])
    else:
        extra = how - 1
        count, bytes_ = u24(1 + how), u24(2 + extra)
        start = at + 15 + 3 * extra
        n_listed = u24(0) if how == 1 else u24(2)
        listed = huffman_decode(data[start : start + bytes_], n_listed, *_dictionary_unpack(data[start + bytes_ :]))
        symbols, lengths = _dictionary_unlist(listed if how == 1 else runs_decode(listed, u24(0)))
    out = huffman_decode(codes, n, symbols, lengths)
    return out if digits else from_digits(out)


CONTAINER_NAMES = ("Huffman", "Huffman, coded dictionary", "Huffman, coded dictionary of runs")


def chain_encode(v: np.ndarray, matches: bool = True) -> bytes:
    """The whole chain over unsigned numbers."""
    v = np.asarray(v, np.int64)
    out = [struct.pack("<I", len(v))]
    for start in range(0, len(v), BLOCK):
        part = v[start : start + BLOCK]
        digits = to_digits(part)
        last, row = sort_encode(digits)
        out.append(struct.pack("<III", len(part), len(digits), row))
        use_matches = matches
        for plane in front_planes_encode(last):
            if use_matches:
                codes, lengths, distances = matches_encode(plane)
                use_matches = len(lengths) >= 2  # once a plane has too few, the block's others do without
            if not use_matches:
                codes = runs_encode(plane)
            coded = container_encode(codes)
            out.append(struct.pack("<BII", int(use_matches), len(codes), len(coded)) + coded)
            if use_matches:
                out.append(struct.pack("<I", len(distances)))
                if len(distances):
                    coded = container_encode(distances)
                    if len(coded) < 2 * len(distances):
                        out.append(struct.pack("<BI", 0, len(coded)) + coded)
                    else:
                        out.append(b"\1" + distances.astype("<u2").tobytes())
                coded = container_encode(lengths)
                out.append(struct.pack("<II", len(lengths), len(coded)) + coded)
    return b"".join(out)


def chain_decode(data: bytes) -> np.ndarray:
    return chain_decode_from(data, 0)[0]


def chain_decode_from(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers, and where their stream ends."""

    def take(form: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return found

    def coded(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return container_decode(data[at - size : at])

    (left,) = take("<I")
    out = []
    while left > 0:
        n, n_digits, row = take("<III")
        left -= n
        parts = []
        for _ in range(3):
            use_matches, _, size = take("<BII")
            codes = coded(size)
            if use_matches:
                (n_distances,) = take("<I")
                distances = np.zeros(0, np.int64)
                if n_distances:
                    (as_is,) = take("<B")
                    if as_is:
                        distances = np.frombuffer(data, "<u2", n_distances, at).astype(np.int64)
                        at += 2 * n_distances
                    else:
                        distances = coded(*take("<I"))
                _, size = take("<II")
                parts.append(matches_decode(codes, coded(size), distances, n_digits))
            else:
                parts.append(runs_decode(codes, n_digits))
        out.append(from_digits(sort_decode(front_planes_decode(parts), row)))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


def frames_chain_encode(q: np.ndarray, n_atoms: int, matches: bool = True) -> bytes:
    """Frames of n_atoms triplets: lifted to be unsigned, value by value over time, through the chain."""
    q = np.asarray(q, np.int64)
    lift = -int(q.min(initial=0)) if len(q) else 0
    turned = q.reshape(-1, n_atoms * 3).T.ravel() if len(q) else q
    return struct.pack("<i", lift) + chain_encode(turned + lift, matches)


def frames_chain_decode(data: bytes, n: int, n_atoms: int) -> np.ndarray:
    (lift,) = struct.unpack_from("<i", data)
    v = chain_decode(data[4:]) - lift
    return v.reshape(n_atoms * 3, -1).T.ravel() if n else v
