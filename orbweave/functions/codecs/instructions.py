"""Instruction coders: triplets as large values, or as runs of small differences from the one before.

The bit form (id 5) is one stream of prefix-coded instructions and mixed-radix numbers. The stream form (id 10) keeps instructions, run
lengths, large values (direct, or as differences inside or between frames) and small differences apart, each packed in a base or
by the entropy chain. The encoders here choose one base for small differences, by estimated cost over all bases, and take the
longest runs that fit it; decoders read whatever base changes, swaps and kinds a stream has.
"""

from __future__ import annotations

import struct

import numpy as np

from .bits import Reader, Writer, unzigzag, zigzag
from .entropy import chain_decode_from, chain_encode

#: The bases, about powers of the cube root of 2.
BASES = (
    2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5160, 6501,
    8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524288, 660561, 832255,
    1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388608, 10568983, 13316085, 16777216, 21137967, 26632170, 33554432, 42275935,
    53264340, 67108864, 84551870, 106528681, 134217728, 169103740, 213057362, 268435456, 338207481, 426114725, 536870912, 676414963, 852229450, 1073741824,
    1352829926, 1704458900, 2147483648, 2705659852, 3408917801,
)
#: Longest run of small differences in the bit form and in the stream form, and most large values in a run.
RUN, STREAM_RUN, LARGE_RUN, STREAM_LARGE_RUN = 6, 12, 18, 1024
#: Instructions of the stream form.
BOTH, SET_RUN, LARGE, SMALL, FLIP, LARGES, DIRECT, INSIDE, BETWEEN = range(9)
#: How many digits share a packed number, and how many of these share a base.
DIGITS, SHARE = 24, 8


def base_index(most: int) -> int:
    """The first base above most. A spread beyond all bases is an error: it would come back as other numbers."""
    if most >= BASES[-1]:
        raise OverflowError("spread of values out of range of the bases")
    return int(np.searchsorted(BASES, most, "right"))


def _joined(digits: list[int], bases: list[int]) -> int:
    number = 0
    for d, b in zip(digits, bases, strict=True):
        number = number * b + d
    return number


def _parted(number: int, bases: list[int]) -> list[int]:
    out = []
    for b in reversed(bases):
        number, d = divmod(number, b)
        out.append(d)
    return out[::-1]


def _bits(bases: list[int]) -> int:
    product = 1
    for b in bases:
        product *= b
    return (product - 1).bit_length()


def _write_number(to: Writer, number: int, width: int) -> None:
    """Lowest byte first, the rest of the bits last."""
    while width >= 8:
        to.write(number & 0xFF, 8)
        number >>= 8
        width -= 8
    if width:
        to.write(number, width)


def _read_number(source: Reader, width: int) -> int:
    number = int.from_bytes(source.read(width // 8 * 8).to_bytes(width // 8, "big"), "little")
    return number | source.read(width % 8) << (width // 8 * 8) if width % 8 else number


def _best_base(steps: np.ndarray, large_bits: float, run: int, overhead: float) -> int:
    """steps: the largest zigzag difference of each triplet. The base of the least estimated cost."""
    tops = np.searchsorted(BASES, steps, "right")  # a triplet fits bases from here on
    counts = np.bincount(np.minimum(tops, len(BASES) - 1), minlength=len(BASES))
    fits = np.cumsum(counts)
    small = 3 * np.log2(np.array(BASES, float)) + overhead / run
    return int(np.argmin(fits * small + (len(steps) - fits + 1) * (large_bits + overhead)))


def _segments(fits: list[bool], swapped: list[bool] | None, most: int):
    """(kind, start, run): a large triplet at start and run small ones; start is -1 where only small ones go on."""
    n, i = len(fits), 0
    while i < n:
        run = 0
        if swapped is None:
            while i + 1 + run < n and run < most and fits[i + 1 + run]:
                run += 1
        elif swapped[i]:  # the first two small ones
            run = 2
            while i + 1 + run < n and run < most and fits[i + 1 + run]:
                run += 1
        yield BOTH if run else LARGE, i, run
        i += 1 + run
        while run and i < n and fits[i]:
            run = 0
            while i + run < n and run < most and fits[i + run]:
                run += 1
            yield SMALL, i, run
            i += run


def bits_encode(q: np.ndarray) -> bytes:
    """The bit form: with and without swaps of each run's first two triplets, whichever is shorter."""
    v = np.asarray(q, np.int64).reshape(-1, 3)
    least = v.min(0) if len(v) else np.zeros(3, np.int64)
    above = v - least
    large = [base_index(int(m)) for m in (above.max(0) if len(v) else np.zeros(3))]
    bases = [BASES[i] for i in large]
    width = _bits(bases)
    steps = zigzag(np.diff(v, axis=0, prepend=v[:1]))
    small = _best_base(steps.max(1)[1:], width, RUN, 7) if len(v) > 1 else 0
    fits = (steps.max(1) < BASES[small]).tolist()
    # Swapped: the second triplet comes first, then the first and the third, which differ from it and from the first.
    two, three = np.roll(v, -1, 0), np.roll(v, -2, 0)
    back, over = zigzag(v - two), zigzag(three - v)
    swapped = ((back.max(1, initial=0) < BASES[small]) & (over.max(1, initial=0) < BASES[small]) & (np.arange(len(v)) < len(v) - 2)).tolist()
    done = [_bits_written(above, steps, least, large, bases, width, small, fits, None, back, over)]
    if len(v) >= 3:
        done.append(_bits_written(above, steps, least, large, bases, width, small, fits, swapped, back, over))
    return min(done, key=len)


def _bits_written(above, steps, least, large, bases, width, small, fits, swapped, back, over) -> bytes:
    out = Writer()
    for z in zigzag(least).tolist():
        out.write(z, 32)
    for i in (*large, small):
        out.write(i, 8)
    base, current, waiting = BASES[small], 0, []
    numbers, differences, run_bits = above.tolist(), steps.tolist(), [0, *(_bits([base] * 3 * r) for r in range(1, RUN + 1))]

    def put_large(i: int) -> None:
        _write_number(out, _joined(numbers[i], bases), width)

    def flush() -> None:
        while waiting:
            part = waiting[:LARGE_RUN]
            del waiting[:LARGE_RUN]
            if len(part) < 3:
                for i in part:
                    out.write(0b0100, 4)
                    put_large(i)
            else:
                out.write(0b01111, 5)
                out.write(len(part) - 3, 4)
                for i in part:
                    put_large(i)

    if swapped is not None:
        out.write(0b01110, 5)
    for kind, i, run in _segments(fits, swapped, RUN):
        if kind == LARGE:
            waiting.append(i)
            continue
        flush()
        if run != current:
            out.write(0b00, 2)
            out.write(15 if run == RUN else (run - 1) * 3 + 1, 4)  # the base stays
            current = run
        if kind == SMALL:
            out.write(0b0101, 4)
            digits = [d for x in differences[i : i + run] for d in x]
        else:
            out.write(1, 1)
            if swapped is None:
                put_large(i)
                digits = [d for x in differences[i + 1 : i + 1 + run] for d in x]
            else:
                put_large(i + 1)
                digits = [*back[i].tolist(), *over[i].tolist(), *(d for x in differences[i + 3 : i + 1 + run] for d in x)]
        _write_number(out, _joined(digits, [base] * len(digits)), run_bits[run])
    flush()
    return out.done()


def bits_decode(data: bytes, n: int) -> np.ndarray:
    source = Reader(data)
    least = [int(unzigzag(np.array(source.read(32)))) for _ in range(3)]
    bases = [BASES[source.read(8)] for _ in range(3)]
    small, width = source.read(8), _bits(bases)
    out: list[list[int]] = []
    before, run, flipped, widths = [0, 0, 0], 0, False, {}

    def read_large() -> list[int]:
        return _parted(_read_number(source, width), bases)

    def read_small() -> list[list[int]]:
        base = BASES[small]
        if (small, run) not in widths:
            widths[small, run] = _bits([base] * 3 * run)
        digits = _parted(_read_number(source, widths[small, run]), [base] * 3 * run)
        signed = [-(d >> 1) if d % 2 == 0 else (d + 1) >> 1 for d in digits]
        return [signed[k : k + 3] for k in range(0, len(signed), 3)]

    def go_on(parts: list[list[int]]) -> None:
        nonlocal before
        for d in parts:
            before = [a + b for a, b in zip(before, d, strict=True)]
            out.append(before)

    while len(out) < n // 3:
        if source.read(1):
            before, parts = read_large(), read_small()
            if flipped:
                a, b, c = before, parts[0], parts[1]
                before = [x + y for x, y in zip(a, b, strict=True)]
                parts[0], parts[1] = [-y for y in b], [y + z for y, z in zip(b, c, strict=True)]
            out.append(before)
            go_on(parts)
        elif not source.read(1):
            code = source.read(4)
            run, small = (RUN, small) if code == 15 else (code // 3 + 1, small + code % 3 - 1)
        elif (kind := source.read(2)) == 0:
            before = read_large()
            out.append(before)
        elif kind == 1:
            go_on(read_small())
        elif kind == 2:
            code = source.read(2)
            small += -(1 + (code & 1)) if code & 2 else 1 + (code & 1)
        elif source.read(1):
            for _ in range(source.read(4) + 3):
                before = read_large()
                out.append(before)
        else:
            flipped = not flipped
    return (np.array(out, np.int64).reshape(-1, 3) + np.array(least, np.int64)).ravel()


def _base_bytes(base: int, n: int) -> int:
    return ((base**n - 1).bit_length() + 7) // 8


def digits_encode(v: np.ndarray) -> bytes:
    """Triplets of unsigned numbers, dimension by dimension: DIGITS of them in a number of whole bytes, SHARE numbers to a base."""
    out = [struct.pack("<HB", DIGITS, SHARE)]
    for dim in range(3):
        own = np.asarray(v)[dim::3].tolist()
        for start in range(0, len(own), DIGITS * SHARE):
            part = own[start : start + DIGITS * SHARE]
            base = max(2, max(part) + 1)
            out.append(struct.pack("<I", base))
            for k in range(0, len(part), DIGITS):
                digits = part[k : k + DIGITS]
                out.append(_joined(digits, [base] * len(digits)).to_bytes(_base_bytes(base, len(digits)), "little"))
    return b"".join(out)


def digits_decode(data: bytes, n: int) -> np.ndarray:
    group, share = struct.unpack_from("<HB", data)
    out, at = np.zeros(n, np.int64), 3
    for dim in range(3):
        own: list[int] = []
        while len(own) < n // 3:
            (base,) = struct.unpack_from("<I", data, at)
            at += 4
            for _ in range(share):
                count = min(group, n // 3 - len(own))
                if not count:
                    break
                size = _base_bytes(base, count)
                own += _parted(int.from_bytes(data[at : at + size], "little"), [base] * count)
                at += size
        out[dim::3] = own
    return out


def _stream(v: list[int] | np.ndarray, always_chain: bool, speed: int) -> bytes:
    v = np.asarray(v, np.int64)
    if not len(v):
        return struct.pack("<I", 0)
    if always_chain:
        coded = chain_encode(v, speed >= 5)
        return struct.pack("<II", len(v), len(coded)) + coded
    plain = digits_encode(v)
    if speed >= 5 or speed >= 3 and int((v >= 16384).sum()) <= len(v) // 10:
        coded = chain_encode(v, speed >= 5)
        if len(coded) < len(plain):
            return struct.pack("<IBI", len(v), 1, len(coded)) + coded
    return struct.pack("<IBI", len(v), 0, len(plain)) + plain


def streams_encode(q: np.ndarray, n_atoms: int, speed: int = 2) -> bytes:
    """The stream form. Large values are direct unless differences inside, then between frames are much smaller (1.5 times)."""
    v = np.asarray(q, np.int64).reshape(-1, 3)
    least = v.min(0) if len(v) else np.zeros(3, np.int64)
    above = v - least
    steps = zigzag(np.diff(v, axis=0, prepend=np.zeros((1, 3), np.int64)))
    between = zigzag(v[n_atoms:] - v[:-n_atoms]) if len(v) > n_atoms else np.zeros((0, 3), np.int64)
    width = sum(np.log2(float(m) + 2) for m in above.max(0)) if len(v) else 0
    small = _best_base(steps.max(1)[1:], width, STREAM_RUN, 3) if len(v) > 1 else 0
    fits = (steps.max(1) < BASES[small]).tolist()
    instructions: list[int] = []
    runs: list[int] = []
    kinds: dict[int, list[np.ndarray]] = {DIRECT: [], INSIDE: [], BETWEEN: []}
    differences: list[np.ndarray] = []
    now, current, waiting = DIRECT, 0, []

    def kind_of(i: int) -> int:
        best, kind = float(above[i].max()), DIRECT
        if i and 1.5 * steps[i].max() < best:
            best, kind = float(steps[i].max()), INSIDE
        if i >= n_atoms and 1.5 * between[i - n_atoms].max() < best:
            kind = BETWEEN
        return kind

    def put_large(i: int) -> None:
        kinds[now].append({DIRECT: above, INSIDE: steps}[now][i] if now != BETWEEN else between[i - n_atoms])

    def flush() -> None:
        while waiting:
            part = waiting[:STREAM_LARGE_RUN]
            del waiting[:STREAM_LARGE_RUN]
            if len(part) < 3:
                instructions.extend([LARGE] * len(part))
            else:
                instructions.append(LARGES)
                runs.append(len(part))
            for i in part:
                put_large(i)

    for kind, i, run in _segments(fits, None, STREAM_RUN):
        if kind != SMALL and (wanted := kind_of(i)) != now:
            flush()
            instructions.append(wanted)
            now = wanted
        if kind == LARGE:
            waiting.append(i)
            continue
        flush()
        if run != current:
            instructions.append(SET_RUN)
            runs.append(run)
            current = run
        instructions.append(kind)
        if kind == BOTH:
            put_large(i)
            i += 1
        differences.append(steps[i : i + run].ravel())
    flush()
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    head = struct.pack("<III", *zigzag(least).tolist())
    large = [_stream(flat(kinds[k]), False, speed) for k in (DIRECT, INSIDE, BETWEEN)]
    return head + _stream(instructions, True, speed) + _stream(runs, True, speed) + b"".join(large) + _stream(flat(differences), False, speed)


def streams_decode(data: bytes, n: int, n_atoms: int) -> np.ndarray:
    least, at = unzigzag(np.array(struct.unpack_from("<III", data), np.int64)).tolist(), 12
    streams: list[list] = []
    for k in range(6):
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        if not count:
            streams.append([])
            continue
        by_chain = True
        if k >= 2:
            by_chain = data[at] == 1
            at += 1
        (size,) = struct.unpack_from("<I", data, at)
        part = data[at + 4 : at + 4 + size]
        at += 4 + size
        found = chain_decode_from(part, 0)[0] if by_chain else digits_decode(part, count)
        streams.append((unzigzag(found) if k >= 3 else found).tolist())
    instructions, runs, *numbers = streams
    next_run, places = iter(runs), [0] * 4
    out: list[list[int]] = []
    before, run, flipped, kind, total = least, 0, False, DIRECT, n // 3

    def take(stream: int) -> list[int]:
        at = places[stream]
        places[stream] += 3
        return numbers[stream][at : at + 3]

    def read_large(swapping: bool) -> None:
        nonlocal before
        d = take(kind - DIRECT)
        start = least if kind == DIRECT else before if kind == INSIDE else out[len(out) - n_atoms + swapping]
        before = [a + b for a, b in zip(d, start, strict=True)]
        out.append(before)

    for code in instructions:
        if len(out) >= total:
            break
        if code in (BOTH, LARGE, SMALL):
            if code != SMALL:
                read_large(code == BOTH and flipped)
            first = len(out)
            if code != LARGE:
                for _ in range(run):
                    before = [a + b for a, b in zip(before, take(3), strict=True)]
                    out.append(before)
                if code == BOTH and flipped:
                    out[first - 1], out[first] = out[first], out[first - 1]
        elif code == LARGES:
            for _ in range(next(next_run)):
                read_large(False)
        elif code == SET_RUN:
            run = next(next_run)
        elif code == FLIP:
            flipped = not flipped
        else:
            kind = code
    return np.array(out, np.int64).ravel()


def quite_large(triplet: np.ndarray, small: int, margin: int = 3) -> bool:
    """Whether a triplet's differences exceed a base some places above the small one; always so near the table's end."""
    at = small + margin
    return at >= len(BASES) or bool((zigzag(np.asarray(triplet)) > BASES[at]).any())
