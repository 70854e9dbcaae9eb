"""Codecs: round trips over random and odd arrays, and small results worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.functions.codecs import bits, container, entropy, instructions, simple

small_numbers = st.lists(st.integers(-(2**20), 2**20), max_size=60)
triplets = st.lists(st.tuples(*[st.integers(-(2**29), 2**29)] * 3), min_size=1, max_size=40).map(lambda x: np.array(x, np.int64).ravel())
symbols = st.lists(st.integers(0, 255), max_size=256)
quick = settings(max_examples=60, deadline=None)


@quick
@given(small_numbers, st.integers(1, 19))
def test_stop_bits(q, parameter):
    data = simple.stop_bits_encode(np.array(q, np.int64), parameter)
    assert simple.stop_bits_decode(data, len(q), parameter).tolist() == q


@quick
@given(triplets, st.integers(1, 19))
def test_triplets(q, parameter):
    assert (simple.triplets_decode(simple.triplets_encode(q, parameter), len(q), parameter) == q).all()


def test_stop_bits_by_hand():
    # 1 -> 1: 01 and no more: 010. -4 -> 8 = 1000: 00 and more, then one bit at a time: 0 and more, 1 and no more.
    assert simple.stop_bits_encode(np.array([1]), 2) == bytes([0b01000000])
    assert simple.stop_bits_encode(np.array([-4]), 2) == bytes([0b00101100])


@quick
@given(symbols)
def test_symbol_codecs(v):
    a = np.array(v, np.int64)
    assert entropy.runs_decode(entropy.runs_encode(a), len(v)).tolist() == v
    assert entropy.front_decode(entropy.front_encode(a)).tolist() == v
    assert entropy.sort_decode(*entropy.sort_encode(a)).tolist() == v
    assert entropy.matches_decode(*entropy.matches_encode(a), len(v)).tolist() == v
    if v:
        assert entropy.container_decode(entropy.container_encode(a)).tolist() == v


@quick
@given(st.lists(st.integers(0, 2**32 - 1), max_size=80), st.booleans())
def test_digits_and_the_chain(v, matches):
    a = np.array(v, np.int64)
    assert entropy.from_digits(entropy.to_digits(a)).tolist() == v
    assert entropy.chain_decode(entropy.chain_encode(a, matches)).tolist() == v


def test_runs_by_hand():
    # 6 = 110: bits 0 and 1 below the highest, lowest first; then 7 + 2. A single 3: 5.
    assert entropy.runs_encode(np.array([7] * 6 + [3])).tolist() == [0, 1, 9, 5]
    assert entropy.front_encode(np.array([2, 2, 0, 2])).tolist() == [2, 0, 1, 1]


def test_block_sorting_by_hand():
    last, row = entropy.sort_encode(np.array([ord(c) for c in "banana"]))
    assert "".join(map(chr, last)) == "nnbaaa" and row == 3


def test_matches_with_overlap():
    v = np.array([5] * 300 + list(range(40)) * 10)
    codes, lengths, distances = entropy.matches_encode(v)
    assert len(codes) < 60 and 299 in lengths.tolist() and 40 in distances.tolist()
    assert (entropy.matches_decode(codes, lengths, distances, len(v)) == v).all()


def test_dictionary_and_codes():
    s, n = entropy.dictionary(np.array([5, 1, 5, 9]))
    assert s.tolist() == [1, 5, 9] and n.tolist() == [1, 2, 1]
    assert entropy.code_lengths(np.array([7])).tolist() == [1]
    assert sorted(entropy.code_lengths(np.array([1, 2, 1]))) == [1, 2, 2]
    long = entropy.code_lengths(np.array([int(1.618**i) + 1 for i in range(45)]))  # would need more bits than a code may have
    assert long.max() <= entropy.CODE_BITS and abs(sum(0.5**x for x in long.tolist()) - 1) < 1e-9


@pytest.mark.parametrize("how", [0, 1, 2])
def test_every_form_of_a_dictionary(how):
    v = np.random.default_rng(3).integers(0, 300, 500)
    assert (entropy.container_decode(entropy.container_encode(v, True, how)) == v).all()


@quick
@given(triplets)
def test_instruction_coders(q):
    assert (instructions.bits_decode(instructions.bits_encode(q), len(q)) == q).all()
    for speed in (2, 5):
        assert (instructions.streams_decode(instructions.streams_encode(q, 1, speed), len(q), 1) == q).all()
    assert (instructions.digits_decode(instructions.digits_encode(np.abs(q)), len(q)) == np.abs(q)).all()


def test_stream_form_reads_swaps_and_kinds():
    """A stream as another encoder may write it: a swap, large values inside and between frames."""
    i = instructions
    streams = [
        ([i.FLIP, i.SET_RUN, i.BOTH, i.INSIDE, i.LARGE, i.BETWEEN, i.LARGES], True), ([1, 4], True),
        ([0, 0, 0], False), (bits.zigzag(np.array([5, 5, 5])).tolist(), False), (bits.zigzag(np.array([1, 1, 1] * 4)).tolist(), False), (bits.zigzag(np.array([2, 2, 2])).tolist(), False),
    ]
    data = np.array([0, 0, 0], "<u4").tobytes() + b"".join(i._stream(v, chained, 2) for v, chained in streams)
    # Large 0 and small 2 swapped: 2, 0; then 5 from what was decoded last (2): 7. Three atoms a frame, and four values one above those before.
    assert i.streams_decode(data, 21, 3).reshape(-1, 3)[:, 0].tolist() == [2, 0, 7, 3, 1, 8, 4]


def walk(frames: int, atoms: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.integers(-3, 4, (frames, atoms, 3)), 0) + rng.integers(0, 3000, (1, atoms, 3))


@pytest.mark.parametrize("mark", [container.POSITIONS, container.VELOCITIES])
def test_every_pair_of_codecs(mark):
    q = walk(4, 7)
    for first, _ in container.FIRST[mark]:
        for rest in container.WAYS[mark]:
            data = container.compress_quantised(q, 7, 0.01, mark, 5, (first, -1, rest, -1))
            found, precision, own = container.uncompress_quantised(data)
            assert (found == q).all() and own == mark and abs(precision - 0.01) < 1e-9


@pytest.mark.parametrize("speed", range(0, 8))
def test_chosen_codecs(speed):
    q = walk(9, 30)
    assert (container.uncompress_quantised(container.compress_quantised(q, 30, 0.001, speed=speed))[0] == q).all()


def test_one_frame_and_one_atom():
    q = walk(1, 1)
    assert (container.uncompress_quantised(container.compress_quantised(q, 1, 0.5))[0] == q).all()


def test_compressed_values_are_near():
    x = walk(20, 50) * 0.01 + 0.003
    assert np.abs(container.uncompress(container.compress(x, 50, 0.01)).reshape(x.shape) - x).max() <= 0.55 * 0.01
    with pytest.raises(OverflowError):
        container.compress(np.full((1, 1, 3), 1e12), 1, 0.001)


def test_smooth_paths_shrink():
    """Sizes as golden sizes lie: dozens of times smaller than doubles for paths that hardly move."""
    t = np.arange(100)[:, None, None]
    q = np.floor(50 * np.sin(t / 9 + np.arange(100)[None, :, None] / 7 + np.arange(3)) + 0.5).astype(np.int64)
    assert q.size * 8 / len(container.compress_quantised(q, 100, 0.01, speed=6)) > 20


def test_bit_streams():
    assert bits.packed(np.array([5, 1]), np.array([3, 2])) == bytes([0b10101000])
    assert bits.zigzag(np.array([0, 1, -1, 2, -2])).tolist() == [0, 1, 2, 3, 4]
    assert bits.unzigzag(np.arange(5)).tolist() == [0, 1, -1, 2, -2]


def test_zlib_length_is_checked():
    data = simple.zlib_encode(b"abc")
    assert simple.zlib_decode(data, 3) == b"abc"
    with pytest.raises(ValueError):
        simple.zlib_decode(data, 4)
