"""Column functions at their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orbweave.functions import numeric, text


def column(spark, rows, kind, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(expression).collect()]


def test_quantise_halves_go_up(spark):
    assert column(spark, [0.5, -0.5, 1.5, -1.5, -2.5, 0.0, None], "double", numeric.quantise(F.col("x"), 1.0)) == [1, 0, 2, -1, -2, 0, None]


@pytest.mark.parametrize("bad", [3e9, float("nan"), float("inf")])
def test_quantise_out_of_range(spark, bad):
    with pytest.raises(Exception, match="out of range"):
        column(spark, [bad], "double", numeric.quantise(F.col("x"), 1.0))
    assert column(spark, [bad, 2.0], "double", numeric.quantise_or_null(F.col("x"), 1.0)) == [None, 2]


def test_zigzag(spark):
    numbers = [0, 1, -1, 2, -2, 2147483647, -2147483647]
    assert column(spark, numbers, "long", numeric.zigzag(F.col("x")))[:5] == [0, 1, 2, 3, 4]
    assert column(spark, numbers, "long", numeric.unzigzag(numeric.zigzag(F.col("x")))) == numbers


def test_fixed_point(spark):
    values = [0.0, 1.5, -1.5, 123.25, -0.001, 3e9]
    high, low = numeric.fixed_pair(F.col("x"))
    back = column(spark, values, "double", numeric.unfixed_pair(high, low))
    assert all(abs(a - b) < 1e-9 for a, b in zip(back[:5], values, strict=False)) and back[5] == pytest.approx(2147483647)
    assert column(spark, [2.0, -1.0, 0.5], "double", numeric.fixed_unsigned(F.col("x"), 1.0)) == [0xFFFFFFFF, 0, 0x7FFFFFFF]
    assert column(spark, [1.0, -1.0, 0.0, -5.0], "double", numeric.fixed_signed(F.col("x"), 1.0)) == [0x7FFFFFFF, 0xFFFFFFFF, 0, 0xFFFFFFFF]
    assert numeric.precision_of_record(0.01) == pytest.approx(0.01, abs=1e-9)


def test_pair_swap_is_its_own_inverse(spark):
    row = spark.createDataFrame([(10, 3, -5)], "a long, b long, c long")
    once = row.select(*(c.alias(n) for c, n in zip(numeric.pair_swap(F.col("a"), F.col("b"), F.col("c")), "abc", strict=True)))
    assert once.first() == (13, -3, -2)
    assert once.select(*numeric.pair_swap(F.col("a"), F.col("b"), F.col("c"))).first() == (10, 3, -5)


def test_box_and_sines(spark):
    assert column(spark, [-101.0, 200.0, 5.0], "double", numeric.keep_in_box(F.col("x"), -100.0, 200.0)) == [199.0, -100.0, 5.0]
    assert column(spark, [-3, 0, 32, 96], "long", numeric.int_sine(F.col("x"))) == [0, 0, 32767, -32767]
    assert column(spark, [0, 64], "long", numeric.int_cosine(F.col("x"))) == [32767, -32767]


def test_strings(spark):
    assert column(spark, ["", "abc", "x" * 2000, None], "string", text.bounded_length(F.col("x"))) == [1, 4, 1024, None]
    assert column(spark, ["abcdef", "aéé", "ab", "", None], "string", text.truncated(F.col("x"), 4)) == ["abc", "aé", "ab", "", None]
    assert column(spark, ["abc", "abcd"], "string", text.name_fits(F.col("x"), 4)) == [True, False]
    assert column(spark, ["abc"], "string", text.name_fits(F.col("x"), 0)) == [False]


def test_vals16(spark):
    numbers = [0, 0x7FFF, 0x8000, 0x3FFFFFFF, 0x40000000, 0xFFFFFFFF]
    assert [len(x) for x in column(spark, numbers, "long", text.vals16(F.col("x")))] == [1, 1, 2, 2, 3, 3]
    assert column(spark, numbers, "long", text.from_vals16(text.vals16(F.col("x")))) == numbers


def test_block_sorting_and_move_to_front(spark):
    assert column(spark, ["banana", "a", ""], "string", text.block_sorted(F.col("x"))) == ["nnbaaa", "a", ""]
    assert column(spark, ["ccac"], "string", text.move_to_front(F.col("x"), "abc")) == [[2, 0, 1, 1]]
