"""SimHash near-duplicates: a fingerprint for each document, linked by a self-join of binary tries.

Of DISTANCE + k blocks of bits, fingerprints within DISTANCE bits of each other agree in k. For each choice of k blocks, those
that share these bits stand below one node of a binary trie which has them at its top. The join starts with each such
node paired with itself and goes down pair by pair, adding up the bits in which the two paths differ; a pair is dropped
when they exceed the budget, and when all that stands below it is linked already. Equal fingerprints are one node. k grows
with the number of fingerprints, so that nodes stay small: 5 tables up to some 40 million, 15 up to 20 thousand million.

Nodes below which more than NODE fingerprints stand nevertheless are cut into blocks, and each pair of blocks becomes a unit
of its own. A unit gives a spanning forest of its links, not the pairs, so a large group of near copies
costs as many rows as it has members; components of all forests are formed in contraction rounds.

Defined cases. Null and empty texts have no word: fingerprint zero, linked like any other. Fewer words than a shingle: all
of them are one. Null ids: never the least of a component unless it has no other. Repeated rows: dedup() keeps one.
Other columns are kept by dedup(), whatever their names. An empty table: no rows. Very long texts: hashed whole, and their
shingles' bits are added up piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import saved, table

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of a unit of the join, about, and of a trie node that is joined in one piece.
UNIT, NODE = 20_000, 40_000
#: Pairs that are compared at once.
PAIRS = 1 << 18
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit hashes of a text's k-word shingles, in their order; none if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of a text's k-word shingles, as a signed number."""
    hashes = shingle_hashes(text, k)
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """id, fp, and k1, k2: a row's 128-bit name, made of its id and text."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("k1", "k2", "fp"))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), k) for t in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), fp], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), *row_name(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def row_name(id_col: str, text_col: str) -> tuple:
    return F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")


class Tables(NamedTuple):
    """Tries over the bits of fingerprints, each with its own order of bits."""

    #: Bits (0 is the top bit) of a table's trie from its root, 64 each.
    order: np.ndarray
    #: Levels above the nodes that are joined: what meets in a table agrees there.
    depth: np.ndarray
    #: Error budget of the 64 bits of a trie, and of whole fingerprints.
    lead: int
    budget: int


def block_tables(n: int, distance: int = DISTANCE, node: int = 10_000) -> Tables:
    """For 64-bit fingerprints. Of distance + k blocks of bits, k agree; there is a table for each choice of k. k grows with
    the number n of fingerprints, so that about node of them share a table's top bits at most."""
    for k in range(1, 65 - distance):
        edges = [round(i * 64 / (distance + k)) for i in range(distance + k + 1)]
        parts = [list(range(a, z)) for a, z in zip(edges, edges[1:], strict=False)]
        chosen = list(combinations(range(distance + k), k))
        depth = np.array([sum(len(parts[i]) for i in c) for c in chosen])
        if n <= node << int(depth.min()) or len(chosen) > 200:
            break
    order = [[b for i in c for b in parts[i]] + [b for i, p in enumerate(parts) if i not in c for b in p] for c in chosen]
    return Tables(np.array(order), depth, distance, distance)


def bits_of(fps: list[bytes]) -> np.ndarray:
    """Rows of bits of fingerprints, the top bit first."""
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)


def lead_of(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The 64 bits of each row in a trie's order, as numbers."""
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8")[:, 0].astype(np.uint64)


class _Forest:
    """Sets of numbers 0..n-1; label is the least of a number's set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]) is not None and (up != self.label).any():
                self.label = up


def trie_join(keys: np.ndarray, depth: int, distance: int, wide: np.ndarray | None = None, budget: int = 0) -> np.ndarray:
    """keys: sorted unsigned 64-bit numbers. Labels of the components of links at distance bits at most between keys that
    share their first depth bits. wide: if given, whole fingerprints (rows of 64-bit words), which differ by budget bits at most."""
    n, forest = len(keys), _Forest(len(keys))
    if n < 2:
        return forest.label

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.flatnonzero(np.bitwise_count(keys[a] ^ keys[b]) <= distance)
        return found if wide is None else found[np.bitwise_count(wide[a[found]] ^ wide[b[found]]).sum(1) <= budget]

    near = close(np.arange(n - 1), np.arange(1, n))
    near = near[(keys[near] ^ keys[near + 1]) >> np.uint64(64 - depth) == 0] if depth else near
    forest.link(near, near + 1)
    tops = keys >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1])))
    hi = np.append(lo[1:], n)
    many = hi - lo > 1
    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int64))]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        # All of both nodes in one set: nothing to find.
        label = forest.label
        run = np.cumsum(np.concatenate(([0], label[1:] != label[:-1])))
        open_ = ~((run[alo] == run[ahi - 1]) & (run[blo] == run[bhi - 1]) & (label[alo] == label[blo]))
        alo, ahi, blo, bhi, diff = (x[open_] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        product = (ahi - alo) * (bhi - blo)
        small = (product <= 1024) | (d >= 64)
        s = np.flatnonzero(small)
        done = 0
        upto = np.cumsum(product[s])
        while done < len(s):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, "right")))
            part = s[done:stop]
            count = product[part]
            which = np.repeat(part, count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            width = (bhi - blo)[which]
            a, b = alo[which] + at // width, blo[which] + at % width
            keep = (a != b) & (forest.label[a] != forest.label[b])
            a, b = a[keep], b[keep]
            keep = close(a, b)
            forest.link(a[keep], b[keep])
            done = stop
        large = ~small
        if large.any():
            alo, ahi, blo, bhi, diff = (x[large] for x in (alo, ahi, blo, bhi, diff))
            if len(alo) > 4096:  # depth first beyond this, so that the frontier stays small
                half = len(alo) // 2
                stack.append((d, *(x[half:] for x in (alo, ahi, blo, bhi, diff))))
                alo, ahi, blo, bhi, diff = (x[:half] for x in (alo, ahi, blo, bhi, diff))
            bit = np.uint64(1 << (63 - d))
            above = np.uint64((~((1 << (64 - d)) - 1)) & ((1 << 64) - 1)) if d else np.uint64(0)
            amid = np.clip(np.searchsorted(keys, (keys[alo] & above) | bit), alo, ahi)
            bmid = np.clip(np.searchsorted(keys, (keys[blo] & above) | bit), blo, bhi)
            same = alo == blo
            new = [
                (alo, amid, blo, bmid, diff, None), (amid, ahi, bmid, bhi, diff, None),
                (alo, amid, bmid, bhi, diff + 1, None), (amid, ahi, blo, bmid, diff + 1, ~same),
            ]
            parts = []
            for p, q, r, t, e, which in new:
                ok = (q > p) & (t > r) & (e <= distance) & ~((p == r) & (q - p < 2))
                ok = ok if which is None else ok & which
                parts.append([x[ok] for x in (p, q, r, t, e)])
            if sum(len(p[0]) for p in parts):
                stack.append((d + 1, *(np.concatenate([p[i] for p in parts]) for i in range(5))))
    return forest.label


EDGES = "u long, v long"


def placed(fps: DataFrame, tables: Tables, per: int) -> DataFrame:
    """fps: node (long), fp (binary, top byte first). A row for each table: unit (per of them for each table, by the bits that agree), node, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 2048):
                part = b.slice(start, 2048)
                bits = bits_of(part.column(1).to_pylist())
                for t, (order, depth) in enumerate(zip(tables.order, tables.depth.tolist(), strict=True)):
                    top = lead_of(bits, order) >> np.uint64(64 - depth) if depth else np.zeros(len(part), np.uint64)
                    top = (top ^ top >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
                    yield pa.RecordBatch.from_arrays([pa.array((t * per + top % np.uint64(per)).astype(np.int64)), *part.columns], names=["unit", "node", "fp"])

    return fps.select("node", "fp").mapInArrow(run, "unit long, node long, fp binary")


def trie_links(fps: DataFrame, tables: Tables, unit: int = UNIT, node: int = NODE) -> DataFrame:
    """fps: node, fp, one row for each fingerprint. Edges u, v: spanning forests of all links that a table finds."""
    n = fps.count()
    per = max(1, -(-n // unit))
    rows, pair = placed(fps, tables, per), ["unit"]
    large = saved(rows.groupBy("unit").agg(F.count("*").alias("members")).where(F.col("members") > node), "simhash-large") if n > node else None
    if large is not None and not large.isEmpty():
        # A unit that is too large is cut into blocks of its members; each pair of blocks is joined by itself.
        own = rows.join(large, "unit", "left").withColumn("blocks", F.ceil(F.coalesce("members", F.lit(1)) / node).cast("int"))
        own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows, pair = own.select("unit", "node", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), ["unit", "i", "j"]

    def join(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        t = int(key[0]) // per
        bits, node = bits_of(own["fp"].tolist()), own["node"].to_numpy()
        lead = lead_of(bits, tables.order[t])
        wide = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64) if bits.shape[1] > 64 else None
        order = np.argsort(lead, kind="stable")
        label = trie_join(lead[order], int(tables.depth[t]), tables.lead, None if wide is None else wide[order], tables.budget)
        node = node[order]
        least = node.copy()
        np.minimum.at(least, label, node)
        to = least[label]
        return pd.DataFrame({"u": node, "v": to})[node != to]

    return rows.groupBy(*pair).applyInPandas(join, EDGES)


def links(fps: DataFrame, distance: int = DISTANCE, unit: int = UNIT, node: int = NODE) -> DataFrame:
    """fps: fp, distinct longs. Edges u, v: spanning forests of all links at distance bits at most."""
    n = fps.count()
    whole = fps.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    return trie_links(whole, block_tables(n, distance, max(1, node // 4)), unit, node)


def classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fps: id, k1, k2, fp. fp, rep: for each fingerprint the first row of its component, as a struct (none, id, k1, k2)."""
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("rep")
    own = saved(fps.groupBy("fp").agg(rep), "simhash-classes")
    roots = components(links(own.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    own = saved(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    reps = saved(own.groupBy("root").agg(F.min("rep").alias("rep")), "simhash-reps")  # so that a large component's rows can be split in the join
    return own.drop("rep").join(reps, "root").drop("root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """A row for each document: id, fingerprint (16 hexadecimal digits), component_id (the least id of its component)."""
    fps = saved(fingerprints(docs, id_col, text_col, k), "simhash-fps")
    found = fps.select("id", "fp").join(classes(fps, distance), "fp")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep.id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that are the first of their component, each once."""
    names, plain = docs.columns, docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    fps = saved(fingerprints(plain, at[id_col], at[text_col], k), "simhash-fps")
    kept = classes(fps, distance).select(F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")).distinct()
    once = Window.partitionBy("k1", "k2").orderBy("k1", "k2")
    rows = plain.select("*", *row_name(at[id_col], at[text_col])).join(kept, ["k1", "k2"], "left_semi")
    return rows.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
