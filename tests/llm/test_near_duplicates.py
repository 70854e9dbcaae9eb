"""SimHash (5), embeddings (10) and their components."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import embedding, simhash
from orbweave.llm.components import components

from .odd import DOCS, documents, empty, odd_documents


def brute_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    """nodes: values by key. The set of keys reachable from each key."""
    keys, root = list(nodes), {k: k for k in nodes}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(nodes[a], nodes[b]):
                root[top(a)] = top(b)
    return {k: top(k) for k in keys}


def test_fingerprints():
    for _, t, *_ in odd_documents():
        if len(t or "") < 5000:
            assert simhash.fingerprint(t) & (2**64 - 1) == brute_fingerprint(t), t


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    rows = []
    for g in range(25):
        base = rng.choice(words, 120)
        for _ in range(rng.integers(1, 5)):
            near = base.copy()
            near[rng.integers(0, 120, rng.integers(0, 3))] = rng.choice(words)
            rows.append((len(rows), " ".join(near), "en", "s", 0))
    rows += [(len(rows) + i, None if i else "", "en", "s", 0) for i in range(2)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {k: int(v[0], 16) for k, v in got.items()} == fps
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least: dict = {}
    for k, r in root.items():
        least[r] = min(least.get(r, k), k)
    assert {k: v[1] for k, v in got.items()} == {k: least[r] for k, r in root.items()}


@pytest.mark.parametrize("node", [40_000, 64])
def test_links_of_random_fingerprints(spark, node):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(8):
            for b in rng.integers(0, 63, rng.integers(1, 4)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= {(-1 << 62) | i for i in range(40)}
    edges = simhash.links(spark.createDataFrame([(f,) for f in sorted(fps)], "fp long"), 4, node=node)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    mask = 2**64 - 1
    want = brute_components({f: f & mask for f in fps}, lambda a, b: (a ^ b).bit_count() <= 4)
    for f in fps:
        got.setdefault(f, f)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(got) == groups(want)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**10 - 1), min_size=2, max_size=60), st.integers(0, 3))
def test_trie_join(keys, distance):
    k = np.sort(np.array([x << 54 | x for x in keys], np.uint64))
    label = simhash.trie_join(k, 0, distance)
    want = brute_components({i: int(x) for i, x in enumerate(k.tolist())}, lambda a, b: (a ^ b).bit_count() <= distance)
    pairs = [(i, j) for i in range(len(k)) for j in range(i)]
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i, j in pairs)


def test_odd_documents_are_deduplicated(spark):
    docs = documents(spark, extra=True)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    keys = [brute_fingerprint(r["text"]) if len(r["text"] or "") < 5000 else -1 for r in rows]
    assert len(set(keys)) == len(keys)
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} >= {0, 3, 5}
    assert simhash.dedup(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1 and got[0] != got[1000]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int"


def brute_vectors(rows):
    ok = {}
    for i, (k, v, label) in enumerate(rows):
        x = None if v is None or any(y is None for y in v) else np.array(v, float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            ok[i] = (k, x / np.sqrt((x * x).sum()), label)
    near = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) >= 0.98
    links = {i: sum(near(ok[i], ok[j]) for j in ok if j != i) for i in ok}
    root = brute_components(ok, near)
    out = []
    for i, (k, _, _) in enumerate(rows):
        least = min(ok[j][0] for j in ok if root[j] == root[i]) if i in ok else k
        out.append((k, links.get(i, 0), least, k == least))
    return out


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.02).tolist(), int(g % 3)))
    rows += [(500, [0.0] * 16, 1), (501, None, 1), (502, [1.0, None], 1), (503, [float("nan")] * 16, 1), (504, [float("inf")] * 16, 1), (505, rows[0][1], None), (506, rows[0][1], 2), (507, [], 1), (508, [x * 1e200 for x in rows[0][1]], 0), (509, rows[0][1][:8], 0)]
    docs = spark.createDataFrame(rows, VECTORS).withColumn("h1", F.lit(1)).withColumn("id", F.lit(2)).withColumn("node", F.lit(3))
    got = [tuple(r) for r in embedding.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(brute_vectors(rows))


@pytest.mark.parametrize("block", [2048, 20])
def test_one_hot_group_of_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.001).tolist(), 1) for i in range(150)] + [(200 + i, base.tolist(), 1) for i in range(50)]
    got = {r["vec_id"]: r for r in embedding.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(r["n_links"] == 199 and r["component_id"] == 0 for r in got.values()) and sum(r["kept"] for r in got.values()) == 1


def test_recall_right_at_the_threshold(spark):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9801 + 0.002 * rng.random()
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, VECTORS)).where("n_links > 0").count()
    assert got >= 0.9 * 800


def test_no_vectors(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_hashes_follow_the_vectors():
    for n in (0, 1, 100, 10**4, 10**6, 10**8):
        tables, projections = embedding.hashes(n)
        near, unrelated = embedding.same_step(0.2, embedding.WIDTH), embedding.same_step(2**0.5, embedding.WIDTH)
        assert (1 - near**projections) ** tables <= embedding.MISS
        assert n * unrelated**projections <= 1 + 1e-9
    assert embedding.hashes(10, cosine=1.0) == (1, embedding.hashes(10)[1])
