"""Scalar functions on numbers, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647.0
FULL32, SIGN32 = 0xFFFFFFFF, 0x80000000
LOW31 = 0x7FFFFFFF


def quantise(x: Column, precision: float) -> Column:
    """floor(x / precision + 0.5) as a long: half goes up. Values beyond 32 bits, and those that aren't finite, raise an error."""
    scaled = x / F.lit(precision) + 0.5
    fits = F.abs(scaled) < INT_MAX  # not so for NaN either: NaN is above all numbers
    return F.when(x.isNull() | fits, F.floor(scaled)).otherwise(F.raise_error(F.lit("value out of range at this precision")).cast("long"))


def quantise_or_null(x: Column, precision: float) -> Column:
    """As quantise(), but null where it raises an error."""
    scaled = x / F.lit(precision) + 0.5
    return F.when(F.abs(scaled) < INT_MAX, F.floor(scaled))


def quantise_reciprocal(x: Column, precision: float) -> Column:
    """By the reciprocal, as raw bytes are quantised; may differ from quantise() in the last place."""
    return F.floor(x * F.lit(1.0 / precision) + 0.5)


def dequantise(q: Column, precision: float) -> Column:
    return q.cast("double") * F.lit(precision)


def zigzag(q: Column) -> Column:
    """0, 1, -1, 2, -2, ... -> 0, 1, 2, 3, 4, ..."""
    q = q.cast("long")
    return F.when(q > 0, 2 * q - 1).otherwise(-2 * q)


def unzigzag(v: Column) -> Column:
    v = v.cast("long")
    half = F.floor((v + 1) / 2)
    return F.when(v % 2 == 0, -half).otherwise(half)


def fixed_unsigned(x: Column, top: float) -> Column:
    """A number from 0 to top in 32 bits, cut off towards 0."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(top)) / top * float(FULL32))


def fixed_signed(x: Column, top: float) -> Column:
    """Sign and 31 bits of magnitude."""
    ratio = F.least(F.greatest(x / top, F.lit(-1.0)), F.lit(1.0))
    size = F.floor(F.abs(ratio) * float(LOW31))
    return F.when(ratio < 0, size + SIGN32).otherwise(size)


def unfixed(v: Column, top: float) -> Column:
    """Back from fixed_unsigned(). It reads no sign."""
    return v.cast("double") * (top / float(FULL32))


def fixed_pair(x: Column) -> tuple[Column, Column]:
    """High and low word: sign and integer part, and the fraction in parts of 2^32 - 1."""
    size = F.abs(x)
    whole = F.floor(size)
    high = F.least(whole, F.lit(LOW31)) + F.when(x < 0, SIGN32).otherwise(0)
    return high.cast("long"), fixed_unsigned(size - whole, 1.0)


def unfixed_pair(high: Column, low: Column) -> Column:
    negative = high.bitwiseAND(F.lit(SIGN32)) != 0
    size = high.bitwiseAND(F.lit(LOW31)).cast("double") + unfixed(low, 1.0)
    return F.when(negative, -size).otherwise(size)


def precision_of_record(precision: float) -> float:
    """What a precision becomes once it is stored as a pair of words."""
    size = abs(precision)
    whole = min(int(size), LOW31)
    low = int(min(max(size - int(size), 0.0), 1.0) * float(FULL32))
    value = whole + low * (1.0 / float(FULL32))
    return -value if precision < 0 else value


def bit_length(v: Column) -> Column:
    """Bits of a number that isn't negative; 0 has none."""
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0).cast("long")


def pair_swap(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """First and second of three neighbours change places in delta form. Its own inverse."""
    return a + b, -b, b + c


def swap_pays(normal: Column, swapped: Column) -> Column:
    """Whether the larger delta of swapped triplets is smaller by a sixth of a bit at least."""
    return swapped / normal < 2 ** (-1 / 6)


def keep_in_box(v: Column, low: float, high: float) -> Column:
    return F.pmod(v - low, F.lit(high - low)) + low


def int_sine(i: Column, amplitude: int = 32767, steps: int = 128) -> Column:
    """A sine from a table of so many steps a period; negative arguments give 0."""
    return F.when(i < 0, 0).otherwise(F.floor(F.sin(F.pmod(i, F.lit(steps)) * (2 * 3.141592653589793 / steps)) * amplitude + 0.5)).cast("long")


def int_cosine(i: Column, amplitude: int = 32767, steps: int = 128) -> Column:
    return int_sine(F.when(i < 0, -1).otherwise(i + steps // 4), amplitude, steps)
