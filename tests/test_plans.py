"""Physical plans: what must reach the scan, and what must not be there."""

from __future__ import annotations

import re

import pytest

from orbweave.plans import relational

SMALL_RANGES = {"particle_to_molecule", "particle_names", "particle_names_corrected"}
#: Single-row sides: the largest width, or a parameter.
ONE_ROW = {"triplet_cost", "codec_choice", "wildcard_match"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(relational.QUERIES))
def test_no_python_and_no_cartesian_products(spark, sf, name):
    found = plan(relational.QUERIES[name].run(spark, sf))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", found)
    assert "BroadcastNestedLoopJoin" not in found or name in SMALL_RANGES | ONE_ROW


def test_ranges_reach_the_scan(spark, sf):
    found = plan(relational.QUERIES["frame_range_dense"].run(spark, sf))
    assert "GreaterThanOrEqual(vec_id,50)" in found and "LessThanOrEqual(vec_id,149)" in found
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in found and "Exchange" not in found
    found = plan(relational.QUERIES["frame_range_strided"].run(spark, sf))
    assert "GreaterThanOrEqual(event_id,777)" in found and "ReadSchema: struct<event_id:bigint,value:double>" in found


@pytest.mark.parametrize("name", ["grid_scan", "quantise", "dequantise", "zigzag", "delta_intra", "undo_intra", "fixpoint_pair", "vals16", "block_md5", "pair_swap"])
def test_no_shuffle_inside_frames(spark, sf, name):
    assert "Exchange" not in plan(relational.QUERIES[name].run(spark, sf))


@pytest.mark.parametrize(("name", "most"), [("delta_inter", 1), ("undo_inter", 2), ("bounding_box", 1), ("histogram_dict", 2), ("rle_runs", 2), ("frame_set_directory", 2)])
def test_few_shuffles(spark, sf, name, most):
    assert plan(relational.QUERIES[name].run(spark, sf)).count("Exchange hashpartitioning") + plan(relational.QUERIES[name].run(spark, sf)).count("Exchange SinglePartition") <= most
