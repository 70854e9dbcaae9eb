"""Codecs called from SQL."""

from __future__ import annotations

import numpy as np
import pytest

from orbweave.functions import sql
from orbweave.functions.codecs import instructions

from .test_storage import synthetic


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)
    return spark


def test_round_trips(registered):
    values = np.round(np.random.default_rng(1).normal(0, 5, 60), 2).tolist()
    registered.createDataFrame([(values, list(range(60))), (None, None)], "v array<double>, n array<bigint>").createOrReplaceTempView("codec_rows")
    rows = registered.sql("""
        select v, uncompress_frames(compress_positions(v, 10, 0.01, 2)) as p, uncompress_frames(compress_velocities(v, 10, 0.01, 4)) as w, uncompress_quantised(compress_positions(v, 10, 0.01, 2)) as q,
               chain_decoded(chain_encoded(n)) as c, unpacked_digits(packed_digits(n), 60) as d from codec_rows order by v desc""").collect()
    assert np.allclose(rows[0]["p"], values, atol=0.0051) and np.allclose(rows[0]["w"], values, atol=0.0051)
    assert rows[0]["q"] == np.floor(np.array(values) / 0.01 + 0.5).astype(int).tolist() and rows[0]["c"] == rows[0]["d"] == list(range(60))
    assert list(rows[1]) == [None] * 6


def test_blocks_of_a_file(registered):
    registered.createDataFrame([(bytearray(synthetic()[0]),)], "content binary").createOrReplaceTempView("files")
    rows = registered.sql("select b.* from files, lateral blocks_of(files.content) b").collect()
    assert len(rows) == 2 + 4 + 12 * 7 and all(r["hash_ok"] for r in rows)


def test_quite_large():
    assert instructions.quite_large([1000, 0, 0], 5) and not instructions.quite_large([1, 1, 1], 5) and instructions.quite_large([0, 0, 0], 90)
