"""The made-up trajectories, and codec sizes that were published for them."""

from __future__ import annotations

import numpy as np
import pytest

from orbweave.functions.codecs import container
from orbweave.plans import codecs
from orbweave.sources import workload


def test_sines():
    assert workload.sine([0, 1, 16, 32, 64, 96, 127, 128]).tolist() == [0, 3215, 46340, 65535, 0, -65535, -3215, 0]
    assert workload.cosine([0, 32, 64]).tolist() == [65535, 0, -65535]


def test_chunks_of_frames_are_the_whole():
    whole = workload.positions(0, 20, 500, 10000)
    assert whole.shape == (20, 500, 3) and whole.min() >= 0 and whole.max() <= 10000
    assert (np.concatenate([workload.positions(f, 5, 500, 10000) for f in range(0, 20, 5)]) == whole).all()
    assert (workload.positions(3, 2, 100, 0) == 0).all()
    assert workload.positions(0, 1, 1, 100).shape == (1, 1, 3)


def test_first_atoms_by_hand():
    # Frame 0: the first chain is one atom at (0, 1 + 65535 // 32, 2), the second starts a twentieth of the box further and winds.
    first = workload.positions(0, 1, 3, 10000)[0]
    assert first[0].tolist() == [0, 2048, 2]
    assert first[1:].tolist() == [[500 + 2 * 0 + 2 * workload.sine(3) // 256, 2548 + 2 * workload.cosine(3) // 256, 502 + 2 * workload.cosine(3) // 256], [500, 2548 + 2 * 65535 // 256, 502 + 2 * 65535 // 256]]


@pytest.mark.parametrize("case", [c for c in codecs.CASES if c.test in (8, 20, 66, 69, 78)], ids=lambda c: str(c.test))
def test_cases_come_back(case):
    q = workload.positions(0, 5, case.atoms, case.box)
    data = container.compress_quantised(q, case.atoms, 0.01, container.POSITIONS, 5, case.positions)
    assert (container.uncompress_quantised(data)[0] == q).all()
    if case.velocities != codecs.V_NONE:
        v = workload.velocities(0, 5, case.atoms)
        assert (container.uncompress_quantised(container.compress_quantised(v, case.atoms, 0.1, container.VELOCITIES, 5, case.velocities))[0] == v).all()


def test_exact_sizes(spark):
    found = {r["test"]: r["bytes"] for r in codecs.published_sizes_exact(spark, "").collect()}
    assert found == {c.test: c.published for c in codecs.CASES if c.test in codecs.EXACT}
