"""Functions on strings, and on arrays of small numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_STRING


def bounded_length(s: Column, most: int = MAX_STRING) -> Column:
    """Bytes that a string takes up, its end included."""
    return F.when(s.isNotNull(), F.least(F.octet_length(s) + 1, F.lit(most))).cast("long")


def truncated(s: Column, most: int = MAX_STRING) -> Column:
    """s cut at most - 1 bytes, at the start of a character. Cut where the last whole character ends."""
    fits = F.octet_length(s) < most
    # Of the first most - 1 characters, as many as have most - 1 bytes at most.
    chars = F.split(F.substring(s, 1, most - 1), "")
    upto = F.aggregate(chars, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, c: F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), F.when(a["on"] & (a["bytes"] + F.octet_length(c) < most), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (a["bytes"] + F.octet_length(c) < most)).alias("on")))
    return F.when(fits | s.isNull(), s).otherwise(F.substr(s, F.lit(1), upto["n"]))


def name_fits(s: Column, most: int) -> Column:
    """Whether a name fits into most bytes with its end; nothing fits into none."""
    return F.lit(most > 0) & (F.octet_length(s) <= most - 1)


def vals16(v: Column) -> Column:
    """1 to 3 digits of 15 bits, lowest first; bit 15 says that another follows."""
    v = v.cast("long")
    low, high = v.bitwiseAND(F.lit(0x7FFF)), F.shiftrightunsigned(v, 15)
    mid, top = high.bitwiseAND(F.lit(0x7FFF)), F.shiftrightunsigned(v, 30)
    more = F.lit(0x8000).cast("long")
    return F.when(v <= 0x7FFF, F.array(v)).when(high <= 0x7FFF, F.array(low + more, high)).otherwise(F.array(low + more, mid + more, top))


def from_vals16(digits: Column) -> Column:
    """The number of one value's digits."""
    zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("at"))
    add = lambda a, d: F.struct((a["v"] + d.bitwiseAND(F.lit(0x7FFF)) * F.pow(F.lit(2.0), a["at"]).cast("long")).alias("v"), (a["at"] + 15).alias("at"))
    return F.aggregate(digits, zero, add, lambda a: a["v"])


def matches(name: Column, idx: Column, wanted_name: str = "", wanted_id: int = -1) -> Column:
    """The empty name and the id -1 match all."""
    return (F.lit(wanted_name == "") | (name == wanted_name)) & (F.lit(wanted_id == -1) | (idx == wanted_id))


def rotations(s: Column) -> Column:
    """All rotations of a string, sorted: rows of its block-sorting matrix. For short strings."""
    n = F.char_length(s)
    return F.when(n > 0, F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(s, i, n), F.substr(s, F.lit(1), i - 1))))).otherwise(F.array().cast("array<string>"))


def block_sorted(s: Column) -> Column:
    """The last column of the block-sorting matrix."""
    return F.array_join(F.transform(rotations(s), lambda r: F.substr(r, F.char_length(r), F.lit(1))), "")


def move_to_front(s: Column, alphabet: str) -> Column:
    """Places of a string's letters in a list that starts as alphabet and moves each letter met to its front."""
    zero = F.struct(F.lit(alphabet).alias("list"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        at = F.locate_column(a["list"], c) if hasattr(F, "locate_column") else F.instr(a["list"], c)
        return F.struct(F.concat(c, F.replace(a["list"], c, F.lit(""))).alias("list"), F.array_append(a["out"], (at - 1).cast("int")).alias("out"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), zero, step, lambda a: a["out"])
