"""Operators on small tables worked out by hand."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import schema
from orbweave.operators import blocks, deltas, frames, mapping, runs, topology

from .conftest import same_rows


def test_repeated_bonds(spark):
    b = topology.Builder()
    m = b.add_molecule("m", 2)
    for n in "ab":
        b.add_atom(m, None, n, "T")
    b.add_bond(m, 0, 1)
    t = b.tables(spark)
    same_rows(topology.bonds_expanded(t["molecules"], t["bonds"]).select("src", "dst").collect(), [(0, 1), (2, 3)])


def test_bonds_of_many_instances(spark):
    """More than a task's share: spans of instances are dealt out, and are whole at their ends."""
    b = topology.Builder()
    none, many = b.add_molecule("none", 0), b.add_molecule("many", 9_000_001)
    for m in (none, many):
        for n in "abc":
            b.add_atom(m, None, n, "T")
        b.add_bond(m, 0, 1)
    t = b.tables(spark)
    got = topology.bonds_expanded(t["molecules"], t["bonds"]).groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("instance"), F.sum("src"), F.sum("dst"), F.sum(F.col("src") % 1009 * (F.col("instance") % 1013))).collect()
    i = np.arange(9_000_001)
    assert [sum(r[k] for r in got) for k in range(1, 6)] == [len(i), i.sum(), (3 * i).sum(), (3 * i + 1).sum(), (3 * i % 1009 * (i % 1013)).sum()]
    assert max(r[1] for r in got) < 6_000_000


def two_types(spark):
    b = topology.Builder()
    for i, res_id in enumerate((10, 20)):
        m = b.add_molecule(f"mol{i}", 1)
        c = b.add_chain(m, "A")
        r = b.add_residue(m, c, f"R{i}", res_id)
        b.add_atom(m, r, f"A{i}", f"T{i}")
    return b.tables(spark)


def test_first_particle(spark):
    t = two_types(spark)
    p = spark.createDataFrame([(0,), (1,), (9,)], "particle long")
    found = topology.particle_to_atom(p, t["molecules"], t["atoms"], t["residues"], t["chains"])
    rows = {r["particle"]: r for r in found.collect()}
    assert [rows[0][c] for c in ("molecule", "chain", "residue", "res_id", "atom", "atom_type")] == ["mol0", "A", "R0", 10, "A0", "T0"]
    assert rows[1]["molecule"] == "mol1" and rows[9]["molecule"] is None and rows[9]["atom_type"] == ""


def test_modulo_or_corrected(spark):
    molecules = spark.createDataFrame([(0, 1, "x", 2, 1, 1), (1, 2, "y", 3, 1, 2)], "mol_idx long, mol_id long, name string, n_atoms long, n_residues long, cnt long")
    atoms = spark.createDataFrame([(m, a, a, 0, f"{m}{a}", "T") for m, n in ((0, 2), (1, 3)) for a in range(n)], "mol_idx long, atom_idx long, atom_id long, res_idx long, name string, atom_type string")
    residues = spark.createDataFrame([(0, 0, 0, None, "r"), (1, 0, 0, None, "r")], schema.RESIDUES)
    chains = spark.createDataFrame([], schema.CHAINS)
    p = spark.range(2, 8).withColumnRenamed("id", "particle")
    names = lambda c: [r["atom"] for r in topology.particle_to_atom(p, molecules, atoms, residues, chains, corrected=c).orderBy("particle").collect()]
    assert names(False) == ["12", "10", "11", "12", "10", "11"]
    assert names(True) == ["10", "11", "12", "10", "11", "12"]


def test_residues_stand_by_chain(spark):
    b = topology.Builder()
    m = b.add_molecule("m", 1)
    a, c = b.add_chain(m, "A"), b.add_chain(m, "B")
    for chain, name in ((a, "a0"), (c, "b0"), (a, "a1")):
        b.add_atom(m, b.add_residue(m, chain, name), name, "T")
    t = b.tables(spark)
    assert [tuple(r) for r in t["residues"].orderBy("res_idx").select("name", "res_id").collect()] == [("a0", 0), ("a1", 1), ("b0", 0)]
    assert [r[0] for r in t["atoms"].orderBy("atom_idx").select("res_idx").collect()] == [0, 2, 1]
    assert topology.find(t["residues"], "res_idx", name="a1").first()["res_idx"] == 1
    assert topology.find(t["residues"], "res_idx", wanted_id=0, id_col="res_id").first()["name"] == "b0"
    with pytest.raises(ValueError):
        b.set_count(m, -1)


def test_many_uneven_spans(spark, monkeypatch):
    spans = spark.createDataFrame([(i * i, 2 * i + 1, i) for i in range(60)], "low long, size long, nr long")
    rows = spark.range(0, 3700).withColumnRenamed("id", "at")
    want = {r["at"]: int(r["at"] ** 0.5) if r["at"] < 3600 else None for r in rows.collect()}
    for small in (1000, 5):
        monkeypatch.setattr(frames, "SMALL", small)
        got = {r["at"]: r["nr"] for r in frames.locate(rows, spans, "at", "low", "size", ["nr"]).collect()}
        assert got == want


def test_ranges(spark):
    rows = spark.range(0, 20000).withColumnRenamed("id", "frame").where("frame % 5000 = 0")
    assert frames.in_range_strided(rows, 0, 5000, 5000).count() == 2
    assert frames.in_range_strided(rows, 7777, 18888, 5000).count() == 2
    with pytest.raises(ValueError):
        frames.in_range_strided(rows, 1, 1, 5000)
    with pytest.raises(ValueError):
        frames.in_range(rows, 5, 4)
    with pytest.raises(ValueError):
        frames.directory(rows, 5, 5)


def test_times(spark):
    rows = spark.createDataFrame([(50,), (100,)], "frame long")
    at = frames.time_of_frame(F.col("frame"), F.lit(0), F.lit(0.0), F.lit(2e-15))
    assert [r[0] for r in rows.select(at).collect()] == pytest.approx([1e-13, 2e-13])
    with pytest.raises(Exception, match="no time"):
        rows.select(frames.time_of_frame(F.col("frame"), F.lit(0), F.lit(0.0), F.lit(0.0))).collect()


def test_next_frame_over_sets(spark):
    rows = spark.createDataFrame([(3,), (95,), (350,), (351,)], "frame long")
    same_rows(frames.next_with_data(rows).select("frame", "next_frame").collect(), [(3, 95), (95, 350), (350, 351), (351, None)])


def test_deltas_by_hand(spark):
    q = [[0, 0, 0, 1, 1, 1], [1, 1, 1, 3, 4, 5], [2, 3, 4, 9, 9, 9]]
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(q)], "frame long, frame_set long, q array<long>")
    assert [r[0] for r in deltas.inter(rows).orderBy("frame").select("delta").collect()] == [[0, 0, 0, 1, 1, 1], [1, 1, 1, 2, 3, 4], [1, 2, 3, 6, 5, 4]]
    intra = deltas.intra(rows).orderBy("frame")
    assert [r[0] for r in intra.select("delta").collect()] == [[0, 0, 0, 1, 1, 1], [1, 1, 1, 2, 3, 4], [2, 3, 4, 7, 6, 5]]
    assert [r[0] for r in deltas.undo_intra(intra.drop("q")).select("q").collect()] == q


def test_mappings(spark):
    values = spark.createDataFrame([(s, p) for s in (0, 1) for p in range(4)], "frame_set long, particle long")
    blocks_ = spark.createDataFrame([(0, 0, [3, 2]), (0, 2, [1])], "frame_set long, first long, numbers array<long>")
    got = mapping.applied(values, mapping.exploded(blocks_)).select("frame_set", "particle", "real_particle").collect()
    same_rows(got, [(0, 0, 3), (0, 1, 2), (0, 2, 1), (0, 3, None), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3)])
    spans = spark.createDataFrame([(0, 0, 10, 5), (0, 1, 5, 5), (0, 2, 15, 5), (1, 3, 10, 5)], "frame_set long, block long, first long, n long")
    # A block that ends where an earlier one starts clashes; one that starts where an earlier one ends doesn't.
    same_rows(mapping.overlaps(spans).collect(), [(0, 0, 1)])


def test_runs_over_sets(spark):
    rows = spark.createDataFrame([(i, i // 3, s) for i, s in enumerate("aabbba")], "frame long, frame_set long, sym string")
    parts = runs.runs(rows)
    same_rows(parts.select("start", "sym", "n").collect(), [(0, "a", 2), (2, "b", 1), (3, "b", 2), (5, "a", 1)])
    same_rows(runs.joined_runs(parts).select("start", "sym", "n").collect(), [(0, "a", 2), (2, "b", 3), (5, "a", 1)])


def test_runs_across_many_groups(spark):
    """Runs over several whole groups, groups of one run, and equal symbols at both ends of a group."""
    text = "aabb" + "bbbb" + "bbbb" + "bcbb" + "abca" + "aaaa" + "abab"
    parts = runs.runs(spark.createDataFrame([(i, i // 4, c) for i, c in enumerate(text)], "frame long, frame_set long, sym string"))
    want, at = [], 0
    for c, own in groupby(text):
        n = len(list(own))
        want.append((at, c, n))
        at += n
    same_rows(runs.joined_runs(parts).select("start", "sym", "n").collect(), want)


def test_long_frames_are_summed_up(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 9, 28, 1000, 30_001):
        delta = rng.integers(-50, 50, n)
        want = [int(delta[i % 3 : i + 1 : 3].sum()) for i in range(n)] if n < 2000 else None
        got = deltas.undo_intra(spark.createDataFrame([(delta.tolist(),), (None,)], "delta array<long>")).collect()
        if want is None:
            want = np.zeros(n, np.int64)
            for k in range(3):
                want[k::3] = np.cumsum(delta[k::3])
            want = want.tolist()
        assert [r["q"] for r in got] == [want, None]
    assert runs.canonical_dictionary(spark).count() == 0x20004


def test_blocks(spark):
    rows = spark.createDataFrame([("a", "0cc175b9c0f1b6a831c399e269772661"), ("b", "0" * 32), ("c", "1" * 32)], "content string, md5 string")
    assert [r["hash_ok"] for r in blocks.verified(rows).orderBy("content").collect()] == [True, None, False]
    old = spark.createDataFrame([(1, 0, "a"), (1, None, "b"), (2, 0, "c")], "block_id long, frame_set long, name string")
    new = spark.createDataFrame([(1, None, "x")], "block_id long, frame_set long, name string")
    same_rows(blocks.replaced(old, new).collect(), [(1, 0, "a"), (1, None, "x"), (2, 0, "c")])
    assert blocks.described(old, 1).first()["name"] == "b"
    values = spark.createDataFrame([(schema.BOX_SHAPE, 0, 0, [1.0] * 9), (schema.BOX_SHAPE, 0, 1, [1.0] * 3)], schema.FRAME_VALUES)
    assert blocks.box_shape(values, 0, 0).count() == 1
    with pytest.raises(Exception, match="nine"):
        blocks.box_shape(values).collect()
    with pytest.raises(ValueError):
        blocks.authored(values, 5, 0, 100)


def test_block_catalog(spark):
    rows = schema.block_catalog(spark)
    assert rows.count() == 96 and rows.select("block_id").distinct().count() == 96
    assert rows.where("name = 'ATOM_SELECTION_GROUP'").first()["block_id"] == 0x1000000010000080
