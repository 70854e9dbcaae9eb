"""Files of the binary format, the data source, tables and streams."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import schema
from orbweave.operators import storage
from orbweave.sources import blockfile as bf
from orbweave.sources import datasource
from orbweave.streaming import append

WATER = {"id": 1, "name": "water", "quaternary": 0, "cnt": 200, "chains": [(1, "W")], "residues": [(0, 0, "WAT")], "atoms": [(0, 0, "O", "O"), (0, 1, "HO1", "H"), (0, 2, "HO2", "H")], "bonds": [(0, 1), (0, 2)]}
GENERAL = {"program_first": "p", "forcefield": "f" * 2000, "frames_per_set": 10, "created": 5, "medium_stride": 2, "long_stride": 3}


def synthetic() -> tuple[bytes, np.ndarray]:
    """Twelve sets of ten frames and 600 particles, four mappings in each, a static box, charges, masses and comments."""
    rng = np.random.default_rng(4)
    box = np.diag([150.0, 145.5, 155.5]).reshape(1, 1, 9)
    static = [
        bf.Block(schema.BOX_SHAPE, "BOX SHAPE", box, False, False), bf.Block(schema.PARTIAL_CHARGES, "PARTIAL CHARGES", np.tile([-0.834, 0.417, 0.417], 200).reshape(1, 600, 1), False, True, dtype=bf.FLOAT),
        bf.Block(schema.MASSES, "ATOM MASSES", np.tile([16.0, 1.008, 1.008], 200).reshape(1, 600, 1), False, True, dtype=bf.FLOAT, codec=bf.ZLIB), bf.Block(schema.GENERAL_COMMENTS, "COMMENTS", np.array([[["a note", "öö"]]], object), False, False, dtype=bf.CHAR),
    ]
    k = np.arange(150)
    mappings = [(0, k), (150, 599 - k), (300, k + 150), (450, 449 - k)]
    x = rng.uniform(0, 100, (1, 600, 3)) + np.cumsum(rng.uniform(-1, 1, (120, 600, 3)), 0)
    sets = []
    for i in range(12):
        s = {"first_frame": 10 * i, "n_frames": 10, "first_time": 2e-15 * 10 * i, "time_per_frame": 2e-15}
        codec = bf.ZLIB if i < 6 else bf.QUANTISED
        blocks = [bf.Block(schema.POSITIONS, "POSITIONS", x[10 * i : 10 * i + 10], first_frame=10 * i, codec=codec), bf.Block(schema.BOX_SHAPE + 9, "sparse", np.arange(2.0).reshape(2, 1, 1) + i, True, False, 10 * i, 5, dtype=bf.INT)]
        sets.append((s, bf.set_body(s, mappings, blocks)))
    return b"".join(bf.file_bytes(GENERAL, [WATER], static, sets)), x


@pytest.fixture(scope="module")
def whole(tmp_path_factory):
    data, x = synthetic()
    path = tmp_path_factory.mktemp("traj") / "one"
    path.write_bytes(data)
    return str(path), data, x


def test_file_without_spark(whole):
    file = bf.File(io.BytesIO(whole[1]))
    general, molecules, static = file.top()
    assert general["medium_stride"] == 2 and len(general["forcefield"]) == 1023 and general["distance_unit_exp"] == -9
    assert molecules == [WATER] and len(static) == 4
    sets = list(file.frame_sets(1, False))
    assert len(sets) == 12 and sets[-1][0].at == general["last_set"] and sets[0][0].at == general["first_set"]
    at = [h.at for h, _ in sets]
    for i, (_, s) in enumerate(sets):
        for name, n in (("", 1), ("medium_", 2), ("long_", 3)):
            assert s[f"{name}next"] == (at[i + n] if i + n < 12 else -1) and s[f"{name}prev"] == (at[i - n] if i >= n else -1)
    assert all(file.verified(h, file.content(h)) for h in file.headers())


def test_tables_of_a_file(spark, whole):
    read = lambda t: storage.read_files(spark, whole[0], t)
    assert read("general_info").first()["frames_per_set"] == 10
    assert [r["name"] for r in read("atoms").orderBy("atom_idx").collect()] == ["O", "HO1", "HO2"]
    assert read("molecule_counts").first()["cnt"] == 200
    assert [tuple(r) for r in read("bonds").select("from_atom", "to_atom").collect()] == [(0, 1), (0, 2)]
    sets = read("frame_sets").orderBy("frame_set").collect()
    assert [r["first_frame"] for r in sets] == list(range(0, 120, 10)) and sets[5]["first_time"] == pytest.approx(1e-13) and sets[0]["n_particles"] == 600
    charges = read("static_particle_values").where(F.col("block_id") == schema.PARTIAL_CHARGES).orderBy("particle").limit(3).collect()
    assert [round(r["values"][0], 3) for r in charges] == [-0.834, 0.417, 0.417]
    static = {r["block_id"]: r for r in read("static_values").collect()}
    assert static[schema.BOX_SHAPE]["values"][0] == 150 and static[schema.GENERAL_COMMENTS]["strings"] == ["a note", "öö"]
    meta = read("data_blocks").where("frame_set = 7").orderBy("block_id").collect()
    assert [(r["codec"], r["stride"], r["hash_ok"]) for r in meta] == [(bf.QUANTISED, 1, True), (bf.RAW, 5, True)]
    assert read("blocks").where("not hash_ok").count() == 0
    assert read("mappings").where("frame_set = 3 and local_particle = 150").first()["real_particle"] == 599


def test_values_are_mapped(spark, whole):
    _, _, x = whole
    rows = storage.read_files(spark, whole[0]).where(F.col("frame").isin(5, 75)).collect()
    assert len(rows) == 1200
    k = np.arange(150)
    real = np.concatenate((k, 599 - k, k + 150, 449 - k))
    for r in rows[::37]:
        local = np.flatnonzero(real == r["particle"])
        assert any(np.abs(x[r["frame"], i] - r["values"]).max() <= 0.00055 for i in local)


def test_sparse_frames(spark, whole):
    rows = storage.read_files(spark, whole[0], "frame_values").where("frame between 40 and 59").orderBy("frame").collect()
    assert [(r["frame"], r["values"]) for r in rows] == [(40, [4.0]), (45, [5.0]), (50, [5.0]), (55, [6.0])]


def test_what_is_not_wanted_is_not_read(spark, whole):
    reader = datasource.Reader(whole[0], "particle_values", datasource.bounds_of({"block_ids": str(schema.POSITIONS), "first_frame": "31", "last_frame": "42"}))
    assert [o for p in reader.partitions() for o, _ in p.sets] == [3, 4] and reader.bounds.ids == {schema.POSITIONS}
    got = storage.read_files(spark, whole[0], block_ids=(schema.POSITIONS,), frames=(31, 42))
    assert got.select("frame").distinct().count() == 12 and storage.read_files(spark, whole[0], block_ids=(5,)).count() == 0
    assert storage.read_files(spark, whole[0], "frame_sets", sets=(2, 3)).count() == 2


def test_queries_on_one_table_do_not_mix(spark, whole):
    rows = storage.read_files(spark, whole[0], "frame_sets")
    assert [rows.where(f"frame_set = {i}").first()["first_frame"] for i in (4, 5)] == [40, 50] and rows.count() == 12


def test_broken_hash_is_told(spark, whole, tmp_path):
    data = bytearray(whole[1])
    file = bf.File(io.BytesIO(whole[1]))
    h = next(h for h in file.headers() if h.block_id == schema.MOLECULES_BLOCK)
    data[h.content_at + 8] ^= 1
    (tmp_path / "bad").write_bytes(bytes(data))
    assert storage.read_files(spark, str(tmp_path / "bad"), "blocks").where("not hash_ok").count() == 1


def test_big_endian_headers():
    content = struct.pack(">qq", 0, 10) + struct.pack(">6q", *[-1] * 6) + struct.pack(">dd", -1.0, -1.0)
    name = b"TRAJECTORY FRAME SET\0"
    data = struct.pack(">QQQ", 48 + len(name), len(content), schema.FRAME_SET_BLOCK) + bf.NO_HASH + name + struct.pack(">Q", 8) + content
    file = bf.File(io.BytesIO(data))
    h, s = next(file.frame_sets(0, False))
    assert s["n_frames"] == 10 and s["first_time"] is None and file.verified(h, content) is None


def test_unquantisable_values_are_stored_raw():
    values = np.full((1, 2, 3), 1e15)
    b = bf.Block(schema.POSITIONS, "POSITIONS", values, codec=bf.QUANTISED)
    s = {"first_frame": 0, "n_frames": 1}
    file = bf.File(io.BytesIO(bf.set_body(s, [], [b])))
    found = bf.read_block(file, next(file.headers()), s)
    assert found.codec == bf.RAW and (found.values == values).all()


def rows_of(spark, n_frames: int):
    values = [(schema.POSITIONS, f, p, [f + p / 10.0, 1.0, -f * 1.0]) for f in range(n_frames) for p in range(3)]
    return spark.createDataFrame(values, "block_id long, frame long, particle long, values array<double>")


def test_write_read_and_copy(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    rows = rows_of(spark, 45)
    storage.write_files(storage.encoded(rows, 10), a, {"frames_per_set": 10})
    storage.copy_files(spark, a, b)
    for path in (a, b):
        got = storage.read_files(spark, path).select("frame", "particle", F.round(F.element_at("values", 1), 3).alias("x"))
        assert got.exceptAll(rows.select("frame", "particle", F.round(F.element_at("values", 1), 3).alias("x"))).count() == 0
        assert got.count() == 135
    assert storage.read_files(spark, a, "frame_sets").count() == 5
    storage.write_files(storage.encoded(rows.where("frame < 10"), 10), a, {"frames_per_set": 10})  # overwrites
    assert storage.read_files(spark, a, "frame_sets").count() == 1


def test_uneven_frames_are_refused(spark):
    with pytest.raises(Exception, match="evenly spaced"):
        storage.encoded(rows_of(spark, 10).where("frame in (0, 1, 3)"), 10).collect()


def test_missing_and_unknown(spark, tmp_path):
    with pytest.raises(Exception, match="no such table"):
        storage.read_files(spark, str(tmp_path), "nothing")
    with pytest.raises(FileNotFoundError):
        bf.listed(f"{tmp_path}/missing")


def test_partitioned_tables_are_pruned(spark, tmp_path):
    storage.write_tables(rows_of(spark, 30).withColumn("frame_set", F.expr("frame div 10")), f"{tmp_path}/t")
    found = storage.read_tables(spark, f"{tmp_path}/t").where("frame_set = 1")
    assert found.count() == 30
    assert "frame_set" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_growing_file_as_a_stream(spark, whole, tmp_path):
    folder = tmp_path / "grow"
    folder.mkdir()
    (folder / "a").write_bytes(whole[1])
    q = append.follow(spark, str(folder), "frame_sets").writeStream.format("memory").queryName("grown").start()
    try:
        q.processAllAvailable()
        assert spark.table("grown").count() == 12
        (folder / "b").write_bytes(whole[1])
        q.processAllAvailable()
        assert spark.table("grown").count() == 24
    finally:
        q.stop()


def test_appended_frames(spark, tmp_path):
    spark.range(0, 250).withColumnRenamed("id", "frame").where("frame < 30 or frame > 120").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("frame long").parquet(f"{tmp_path}/in")
    append.append(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    sizes = spark.read.parquet(f"{tmp_path}/out").groupBy("frame_set").count().orderBy("frame_set").collect()
    assert [tuple(r) for r in sizes] == [(0, 30), (1, 79), (2, 50)]
    late = append.with_sets(spark.range(0, 10).withColumnRenamed("id", "frame"), 5, first_open=5)
    assert late.count() == 5


def test_appended_files_are_as_many_as_tasks(spark, tmp_path):
    """Not as many as sets; a second batch goes on with the set that the first left open."""
    for k, (first, end) in enumerate(((0, 30_050), (30_050, 40_000))):
        spark.range(first, end, 1, 2).withColumnRenamed("id", "frame").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("frame long").parquet(f"{tmp_path}/in")
        append.append(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert len(list(tmp_path.glob(f"out/batch={k}/**/*.parquet"))) <= 8
    sizes = spark.read.parquet(f"{tmp_path}/out").groupBy("frame_set").agg(F.min("frame"), F.count("*")).orderBy("frame_set").collect()
    assert [tuple(r) for r in sizes] == [(i, i * 100, 100) for i in range(400)]
