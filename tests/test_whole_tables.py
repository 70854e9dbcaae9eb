"""Queries that must cover whole tables, on a scale where a range would show."""

from __future__ import annotations

import math

import numpy as np

import __spark_entry__
from orbweave.plans import codecs, relational

from .conftest import same_rows

SF = "/root/testdata/sf0.01"


def test_move_to_front_of_all_events(spark):
    last, want = {}, []
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type").orderBy("event_id").collect()
    assert len(rows) > 2000
    for frame, sym in rows:
        seen = last.setdefault(frame // 100, {})
        want.append((frame // 100, frame, sym, sum(x > seen[sym] for x in seen.values()) if sym in seen else None))
        seen[sym] = frame
    got = relational.QUERIES["mtf_ranks"].run(spark, SF).select("frame_set", "frame", "sym", "mtf")
    same_rows(got.collect(), want)


def deltas_of_all_frames(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    q = {r[0]: [math.floor(float(x) / relational.PRECISION + 0.5) for x in r[1][:63]] for r in rows}
    want, last = [], {}
    for frame in sorted(q):
        before = last.get(frame // 100, [0] * 63)
        want += [(frame, i // 3, i % 3, q[frame][i] - before[i]) for i in range(63)]
        last[frame // 100] = q[frame]
    return want


def test_inter_frame_deltas_of_all_frames(spark):
    want = deltas_of_all_frames(spark, SF)
    assert max(r[0] for r in want) > 299
    got = relational.QUERIES["delta_inter"].run(spark, SF)
    same_rows(got.select("frame", "particle", "dim", "delta").collect(), want)


def test_entry_has_all_frames(spark, sf):
    same_rows(__spark_entry__.entry(spark).select("frame", "particle", "dim", "delta").collect(), deltas_of_all_frames(spark, sf))


def test_container_of_values_next_to_halves(spark, table):
    """Halves and their neighbours; the first set's large numbers spread beyond the bit form's bases, the second's beyond 32 bits, the third goes through the container."""
    halves = (((np.arange(250 * 63) - 7000) % 1201 - 600 + 0.5) * 0.01).astype(np.float32).reshape(250, 63)
    halves[1::3], halves[2::3] = np.nextafter(halves[1::3], np.float32(9)), np.nextafter(halves[2::3], np.float32(-9))
    halves[:100, 5], halves[100:200, 5] = np.linspace(-2e7, 2e7, 100), np.linspace(-3e10, 3e10, 100)
    halves[200:, 5] = np.linspace(1e6, 9e6, 50)
    d = table("embeddings", [(i, x.tolist(), 0) for i, x in enumerate(halves)], "vec_id long, embedding array<float>, label int")
    want = [(i, k // 3, k % 3, math.floor(float(x) / relational.PRECISION + 0.5)) for i, own in enumerate(halves) for k, x in enumerate(own)]
    same_rows(codecs.QUERIES["container_roundtrip"].run(spark, d).select("frame", "particle", "dim", "q").collect(), want)
