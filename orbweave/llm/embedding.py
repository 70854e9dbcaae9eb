"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, and each projection, shifted at random, is cut into steps of WIDTH.
A table's bucket is several such steps. Unit vectors at cosine 0.98 lie 0.2 apart and share a projection's step with
probability 0.92, unrelated ones (at a right angle) with 0.49. Projections and tables follow the rows of the largest label:
projections so that a vector meets about one unrelated vector a table, tables so that a pair right at the threshold is missed
with a probability of MISS at most (less above it). With n rows a label, 30,000 take 15 and 14, 10^8 take 26 and 38. Vectors
that meet are compared exactly, in double precision, once for each pair: in the first table they share.

Equal vectors are one class from the start. Only class keys move for finding buckets; vectors follow for members of buckets
of two or more. A bucket of more than BLOCK classes is cut into blocks, and each pair of blocks is a unit of work. Links are
counted where they are found, and each unit gives a spanning forest of them, never the pairs.

Defined cases. Null label, or a vector that is null, empty, zero or holds null or non-finite components: no links. Vectors
of different lengths don't link. Null ids: least of a component only if it has no other. Repeated rows: one class, linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import saved, table

COSINE = 0.98
MISS, WIDTH, SEED = 0.01, 2.0, 20
#: Classes of a block of a large bucket; members of a unit, about.
BLOCK, UNIT = 2048, 8000
#: Buckets of so many classes or fewer are compared together, TOGETHER pairs at once (or a row's).
SMALL, TOGETHER = 64, 1 << 16


def same_step(distance: float, width: float) -> float:
    """The probability that vectors so far apart share a projection's step of that width."""
    if distance == 0:
        return 1.0
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def hashes(n: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Tables and projections for n vectors of a label."""
    near, unrelated = same_step(math.sqrt(2 - 2 * cosine), width), same_step(math.sqrt(2), width)
    projections = max(1, math.ceil(math.log(max(n, 1)) / -math.log(unrelated)))
    meet = near**projections
    return (1 if meet >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-meet))), projections


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # else squares may overflow
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def bucket_keys(vectors: np.ndarray, labels: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """Keys of the rows of vectors (finite, not zero) in each table."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([SEED, dim])
    directions, shifts = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
    steps = np.floor((_unit(vectors) @ directions + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(dim), (len(vectors), tables)).copy()
    key ^= labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(projections):
        key = (key ^ steps[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _classes(rows: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """node, h1, h2, id, n, label, vector (bytes of doubles), keys: one row for each distinct vector of a label."""
    one = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, keys = b.column("vector"), np.zeros((len(b), tables), np.int64)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            sizes, labels = np.diff(offsets), b.column("label").to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                keys[at] = bucket_keys(flat[offsets[at][:, None] + np.arange(dim)], labels[at], tables, projections, width)
            own = [b.column(c) for c in ("node", "h1", "h2", "id", "n", "label")]
            raw = pa.array([flat[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*own, raw, pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "h1", "h2", "id", "n", "label", "vector", "keys"])

    return one.mapInArrow(run, f"node long, h1 long, h2 long, id {rows.schema['id'].dataType.simpleString()}, n long, label long, vector binary, keys array<long>")


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether table t is the first in which rows a and b of keys meet."""
    return (keys[a] == keys[b]).argmax(1) == t


def _near_in_small(vectors: np.ndarray, ends: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near pairs. ends: where the group of each row ends (the row's own place, if it has none); groups are small."""
    after = ends - np.arange(len(vectors)) - 1
    after = np.maximum(after, 0)
    upto = np.cumsum(after)
    start = 0
    while start < len(vectors):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TOGETHER, "right")))
        a = np.repeat(np.arange(start, stop), after[start:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[start:stop]) - after[start:stop], after[start:stop])
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
        yield a[near], b[near]
        start = stop


def _join(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """a: a node; b: null with n links of a, or another node of a spanning forest (n is 0)."""
    out = [pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})]
    for _, same in rows.groupby(rows["vector"].str.len(), sort=False):
        same = same.sort_values(["t", "key", "i", "j", "block", "node"], kind="stable")
        vectors = _unit(np.frombuffer(b"".join(same["vector"])).reshape(len(same), -1))
        keys = np.stack(same["keys"].to_numpy())
        node, n, label, t, i, j, block = (same[c].to_numpy() for c in ("node", "n", "label", "t", "i", "j", "block"))
        groups = same[["t", "key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]).any(1))))
        sizes = np.diff(np.append(starts, len(same)))
        whole = (i == j)[starts]
        small = whole & (sizes <= SMALL)
        ends = np.where(np.repeat(small, sizes), np.repeat(starts + sizes, sizes), np.arange(len(same)))
        found = list(_near_in_small(vectors, ends, cosine))
        for start, size, own in zip(starts[~small].tolist(), sizes[~small].tolist(), whole[~small].tolist(), strict=True):
            x = np.arange(start, start + size)
            x, y = (x, x) if own else (x[block[x] == i[start]], x[block[x] == j[start]])
            p, q = np.nonzero(vectors[x] @ vectors[y].T >= cosine)
            p, q = x[p], y[q]
            found.append((p[p < q], q[p < q]) if own else (p, q))
        p, q = (np.concatenate(k) for k in zip(*found, strict=True))
        new = (label[p] == label[q]) & _first_shared(keys, p, q, t[p])
        p, q = p[new], q[new]
        links = (np.bincount(p, n[q], len(same)) + np.bincount(q, n[p], len(same))).astype("int64")
        some = links > 0
        out.append(pd.DataFrame({"a": node[some], "b": pd.array([None] * int(some.sum()), "Int64"), "n": links[some]}))
        top = np.arange(len(same))
        while (apart := top[p] != top[q]).any():
            p, q = p[apart], q[apart]
            u, v = top[p], top[q]
            np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
            while ((up := top[top]) != top).any():
                top = up
        tied = np.flatnonzero(node != node[top])
        out.append(pd.DataFrame({"a": node[tied], "b": pd.array(node[top[tied]], "Int64"), "n": 0}))
    return pd.concat(out)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, miss: float = MISS, width: float = WIDTH) -> DataFrame:
    """A row for each vector: id, n_links (other vectors linked to it), component_id (least id of its component), kept."""
    v, label = F.col(vector_col).cast("array<double>"), F.col(label_col).cast("long")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite, F.lit(False))).withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "label"))
    n = rows.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, projections = hashes(n, cosine, width, miss)
    classes = saved(_classes(rows, tables, projections, width), "vector-classes")
    keys = classes.select("node", F.posexplode("keys").alias("t", "key"))
    buckets = saved(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "vector-buckets")  # so that a large bucket's rows can be split in the join
    members = keys.join(buckets, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "t", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    work = members.join(classes.select("node", "n", "label", "vector", "keys"), "node")
    units = max(1, classes.count() * tables // UNIT)
    out = work.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(units)).alias("unit")).applyInPandas(lambda rows: _join(rows, cosine), "a long, b long, n long")
    out = saved(out, "vector-links")
    links = out.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(out.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    per = classes.select("node", "h1", "h2", "id", "n").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = saved(per, "vector-rooted")
    least = saved(per.groupBy("root").agg(F.min("id").alias("component_id")), "vector-least")  # so that a large component's rows can be split in the join
    per = per.join(least, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("ok"))
    done = rows.select("id", "h1", "h2", "ok").join(per, ["h1", "h2", "ok"], "left").withColumn("component_id", F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id")))
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
