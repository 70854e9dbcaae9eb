"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from orbweave.llm import similar

from .odd import DOCS, documents, empty
from .test_near_duplicates import brute_components


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_equals_brute_force(spark):
    """Copies at similarities on both sides of 0.8: those at it or above go, however far their fingerprints are apart."""
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for _ in range(40):
        base = rng.choice(words, 200)
        for changes in (0, 1, 2, 3, 4, 5, 6, 8):
            near = base.copy()
            near[rng.choice(200, changes, replace=False)] = rng.choice(words, changes)
            rows.append((len(rows), " ".join(near), "en", "s", 0))
    rows += [(len(rows) + i, t, "en", "s", 0) for i, t in enumerate(["", None, "one two", "One  two", "one two three"])]
    own = {r[0]: brute_set(r[1]) for r in rows}
    between = [jaccard(own[i], own[j]) for g in range(40) for i in range(g * 8, g * 8 + 8) for j in range(g * 8, i)]
    assert sum(0.8 <= x < 0.9 for x in between) > 100 and sum(0.6 < x < 0.8 for x in between) > 100
    root = brute_components(own, lambda a, b: jaccard(a, b) >= 0.8)
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, k), k)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_odd_documents(spark):
    docs = documents(spark, extra=True)
    kept = similar.dedup(docs)
    assert kept.columns == docs.columns
    keys = [frozenset(similar.shingles(r["text"]).tolist()) for r in kept.collect()]
    assert len(set(keys)) == len(keys)
    assert similar.dedup(empty(spark)).count() == 0


def test_sets_are_compared_exactly():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(60)]
    got = set(zip(*(x.tolist() for x in similar.similar(own[:30], own[20:], 0.5)), strict=True))
    assert got == {(i, j) for i in range(30) for j in range(40) if jaccard(set(own[i].tolist()), set(own[20 + j].tolist())) >= 0.5}


def test_groups_of_many_blocks(spark):
    """Stars, chains and singles in one group that is cut into blocks: components are those of all links."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 60)
    sets = []
    for _ in range(150):
        x = base.copy()
        x[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(0, 2**62, 1)
        sets.append(frozenset(np.unique(x).tolist()))
    sets = list(dict.fromkeys(sets))
    rows = [(7, i, len(x), bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "group long, c long, n long, own binary")
    for block in (20, 1000):
        got = {r["node"]: r["root"] for r in similar.components(similar.exact_links(members, 0.8, block)).collect()}
        want = brute_components(dict(enumerate(sets)), lambda a, b: jaccard(a, b) >= 0.8)
        groups = lambda m: {frozenset(k for k in range(len(sets)) if m.get(k, k) == r) for r in set(m.values())}
        assert {g for g in groups(got) if len(g) > 1} == {g for g in groups(want) if len(g) > 1}


def test_tables_follow_the_number_of_classes():
    """Below a node stand about as many whatever the corpus, and the chance of a miss stays."""
    differ = np.arccos(2 * 0.8 / 1.8) / np.pi
    for n in (10, 1000, 10**6, 10**10):
        tables = similar.wide_tables(n)
        depth = int(tables.depth[0])
        assert n / 2**depth <= similar.SHARE and (1 - (1 - differ) ** depth) ** len(tables.order) <= similar.MISS + 1e-12
