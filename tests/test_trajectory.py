"""The trajectory object, over a file with all kinds of blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orbweave import schema
from orbweave.operators.topology import Builder
from orbweave.trajectory import open_trajectory, write_trajectory

from .test_storage import rows_of, synthetic


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("api") / "one"
    path.write_bytes(synthetic()[0])
    return open_trajectory(spark, str(path))


def test_header_and_counts(opened):
    assert opened.frames_per_set == 10 and opened.num_frames() == 120 and opened.num_frame_sets() == 12
    assert opened.num_molecules() == 200 and opened.num_particles() == 600
    assert opened.name("program_first") == "p"
    with pytest.raises(ValueError):
        opened.name("forcefield", 10)
    with pytest.raises(ValueError):
        opened.name("program_first", 0)


def test_topology(spark, opened):
    found = opened.particles(spark.createDataFrame([(0,), (599,), (600,)], "particle long")).orderBy("particle").collect()
    assert [(r["molecule"], r["chain"], r["residue"], r["atom"], r["global_residue"]) for r in found] == [("water", "W", "WAT", "O", 0), ("water", "W", "WAT", "HO2", 199), (None, None, None, None, None)]
    assert opened.bonds().count() == 400
    assert opened.find_molecule("water").first()["mol_id"] == 1 and opened.find_molecule("ice").count() == 0
    assert opened.find_chain(0, "W").first()["chain_id"] == 1 and opened.find_residue(0, res_id=0, chain_idx=0).first()["name"] == "WAT"
    assert opened.find_atom(0).first()["name"] == "HO2"


def test_sets_and_times(spark, opened):
    assert opened.frame_set_of(37).first()["frame_set"] == 3 and opened.frame_set_of(120).count() == 0
    assert opened.frame_set(4).first()["first_frame"] == 40
    row = opened.directory().where("frame_set = 5").first()
    assert (row["prev"], row["next"], row["medium_prev"], row["long_next"]) == (4, 6, 3, 8)
    seconds = opened.times(spark.createDataFrame([(50,), (100,)], "frame long")).orderBy("frame").collect()
    assert [r["seconds"] for r in seconds] == pytest.approx([1e-13, 2e-13])


def test_blocks(opened):
    assert opened.positions(5, 14).select("frame").distinct().count() == 10 and opened.velocities().count() == 0 and opened.forces().count() == 0
    assert opened.box_shape().first()["values"][4] == 145.5
    assert opened.frames_with(schema.POSITIONS) == 120 and opened.frames_with(schema.FORCES) == 0
    meta = opened.block(schema.POSITIONS).first()
    assert meta["name"] == "POSITIONS" and meta["dependency"] == 3 and meta["stride"] == 1
    assert opened.strided(schema.POSITIONS, 30, 31).select("frame").distinct().count() == 2
    with pytest.raises(KeyError):
        opened.strided(schema.FORCES, 0, 1)
    assert opened.damaged().count() == 0
    assert opened.next_frames(schema.POSITIONS).where("frame = 9").first()["next_frame"] == 10


def test_write_open_and_modes(spark, tmp_path):
    b = Builder()
    m = b.add_molecule("m", 3)
    b.add_atom(m, None, "A", "T")
    t = write_trajectory(rows_of(spark, 25), f"{tmp_path}/t", {"frames_per_set": 10, "program_first": "x"}, b, time_per_frame=1.0)
    assert t.num_frames() == 25 and t.num_particles() == 3 and t.molecules.first()["name"] == "m"
    again = t.copy(f"{tmp_path}/u")
    assert again.positions(24, 24).count() == 3
    t.to_tables(f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables").where(F.col("block_id") == schema.POSITIONS).count() == 75
    with pytest.raises(FileNotFoundError):
        open_trajectory(spark, f"{tmp_path}/missing")
    with pytest.raises(ValueError):
        open_trajectory(spark, f"{tmp_path}/t", "x")
    assert open_trajectory(spark, f"{tmp_path}/t", "w").frame_sets.count() == 0
    with pytest.raises(ValueError):
        write_trajectory(rows_of(spark, 5), f"{tmp_path}/t", {"medium_stride": 9, "long_stride": 3})
