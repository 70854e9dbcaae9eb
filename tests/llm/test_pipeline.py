"""The corpus pipeline: stages by brute force, and odd documents all the way through."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from orbweave.llm import packing, quality, secrets

from .odd import DOCS, documents, empty
from .test_near_duplicates import brute_components
from .test_similar import brute_set, jaccard

LABELS = "doc_id long, quality int, toxic int"


def staged(spark, docs, folder, tmp_path):
    """Input and output of each stage, as the driver runs them."""
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage{i}")
        done = spark.read.parquet(f"{tmp_path}/stage{i}")
        out.append((name, docs, done))
        docs = done
    return out


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = {n: (a.collect(), b.collect(), b.columns) for n, a, b in staged(spark, docs, sf, tmp_path)}
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mix", "pack"]
    assert all(c == docs.columns for n, (_, _, c) in stages.items() if n != "pack")
    before, after, _ = stages["quality"]
    verdict = {r["doc_id"]: r["kept"] for r in quality.report(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, v in verdict.items() if v)
    assert len(after) >= 0.6 * len(before)
    before, after, _ = stages["near_duplicates"]
    root = brute_components({r["doc_id"]: brute_set(r["text"]) for r in before}, lambda a, b: jaccard(a, b) >= 0.8)
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, k), k)
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    before, after, _ = stages["secrets"]
    assert len(before) == len(after)
    texts = {r["doc_id"]: r["text"] for r in before}
    changed = [r for r in after if r["text"] != texts[r["doc_id"]]]
    assert changed and all(secrets.MARK in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r["text"]) for r in after)
    before, after, _ = stages["mix"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    size = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(size(after) - size(before)) < 0.05 * size(before)
    before, after, _ = stages["pack"]
    assert sum(r["length"] for r in after) == sum(len(packing.encoder(packing.default_tokenizer())(r["text"] or "")) // 4 + 1 for r in before)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_and_no_documents(spark, table, tmp_path, rows):
    folder = table("labels", [(5, 1, 0), (0, 0, 0), (None, 1, 1)], LABELS)
    docs = documents(spark, extra=True) if rows == "odd" else empty(spark)
    for name, before, after in staged(spark, docs, folder, tmp_path):
        assert name == "pack" or after.columns == before.columns
        assert rows == "odd" or after.count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_clean_documents_stay(spark, table):
    """Documents that pass, differ and hold no secrets come through the filtering stages as they are."""
    words = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, 80)), "en", "s", 0) for i in range(20)]
    folder = table("labels", [], LABELS)
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert sorted(r["doc_id"] for r in docs.collect()) == list(range(20)), name
