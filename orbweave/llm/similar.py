"""SimHash near-duplicates by the similarity of shingle sets: wide fingerprints for candidates, and exact checks.

Documents of equal sets of SHINGLE-word shingles are one class. A class has a SimHash of WIDTH bits, which at a Jaccard
similarity of SIMILARITY or more differ with a probability of acos(2 s / (1 + s)) / pi each (0.152 at 0.8), and of unrelated
texts in half of them. Tables of tries over random orders of the bits (simhash.py) join what agrees in a table's top bits
within the error budget. Depth and number of the tables grow with the classes, so that about SHARE of them stand below a node,
and a pair right at SIMILARITY is missed with a probability of about MISS (less above; more if sets are of a few shingles).

Components of these links are groups of candidates, which are checked exactly on their shingle sets: a group of one block's size
in one task; in a larger one, first each block by itself and with PIVOTS classes of the group, then what isn't yet in the
group's largest component with all others, block by block. Rows are never pairs: tasks give spanning forests.

Defined cases. Null and empty texts have no shingle and are one class. Fewer words than a shingle: all of them are one. Null
ids: never the least of a component unless it has no other. Repeated rows: one is kept. Other columns are kept. An empty
table: no rows. Very long texts: their whole sets are compared, a block of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import saved
from .simhash import EDGES, Tables, _Forest, row_name, shingle_hashes, trie_links

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, classes below a node of a trie, the chance of a miss at SIMILARITY, and standard deviations of the error budgets.
WIDTH, SHARE, MISS, WITHIN, SEED = 128, 1024, 1e-4, 3.7, 11
#: Bits of the filter of candidates' names for each of them, and at most.
FILTER, MOST = 64, 1 << 25
#: Classes and shingles of a block, about; classes that all blocks of a large group are compared with.
BLOCK, WEIGHT, PIVOTS = 512, 300_000, 8
#: Shingles that are compared at once.
COLUMNS = 4096
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingle_hashes(text, k))


def fingerprint(own: np.ndarray, width: int = WIDTH) -> bytes:
    """SimHash of a set of 64-bit hashes, each mixed into width bits."""
    set_bits = np.zeros(width, np.int64)
    for start in range(0, len(own), 255):
        part = own[start : start + 255, None] + np.arange(width // 64, dtype=np.uint64) * np.uint64(STEP)
        part = (part ^ part >> np.uint64(30)) * MIX1
        part = (part ^ part >> np.uint64(27)) * MIX2
        part ^= part >> np.uint64(31)
        set_bits += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * set_bits > len(own)).tobytes()


def wide_tables(n: int, least: float = SIMILARITY, width: int = WIDTH) -> Tables:
    """Tables for n classes."""
    differ = np.arccos(2 * least / (1 + least)) / np.pi
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / SHARE)), 0, 40))
    meet = (1 - differ) ** depth
    count = int(np.ceil(np.log(MISS) / np.log1p(-meet))) if meet < 1 else 1
    within = lambda bits: int(np.ceil(differ * bits + WITHIN * np.sqrt(differ * (1 - differ) * bits)))
    order = np.array([np.random.default_rng([SEED, t]).permutation(width)[:64] for t in range(count)])
    return Tables(order, np.full(count, depth), within(64 - depth), within(width))


def sets(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """id, k1 and k2 (the row's name), c (the hash of its shingle set), n (the set's size), fp."""
    longs = [T.StructField(x, T.LongType()) for x in ("k1", "k2", "c", "n")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs, T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n, fp = np.zeros(len(b), np.uint64), np.zeros(len(b), np.int64), []
            for i, text in enumerate(b.column(3)):
                own = shingles(text.as_py(), k)
                c[i], n[i] = xxhash.xxh64_intdigest(own.tobytes(), 1), len(own)
                fp.append(fingerprint(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(c.view(np.int64)), pa.array(n), pa.array(fp, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), *row_name(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common members of each set of a and each of b."""
    found = np.zeros((len(a), len(b)), np.float32)
    ids = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b)]
    both = np.intersect1d(*ids)
    at = []
    for x, own in zip((a, b), ids, strict=True):
        column = np.searchsorted(both, own)
        kept = np.flatnonzero((column < len(both)) & (both[np.minimum(column, len(both) - 1)] == own)) if len(both) else np.zeros(0, int)
        order = kept[np.argsort(column[kept], kind="stable")]
        at.append((np.repeat(np.arange(len(x)), [len(y) for y in x])[order], column[order]))
    for start in range(0, len(both), COLUMNS):
        dense = []
        for (row, column), x in zip(at, (a, b), strict=True):
            one = np.zeros((len(x), COLUMNS), np.float32)
            p, q = np.searchsorted(column, [start, start + COLUMNS])
            one[row[p:q], column[p:q] - start] = 1
            dense.append(one)
        found += dense[0] @ dense[1].T
    return found


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets with a Jaccard similarity of least or more; two empty sets are alike."""
    common = overlaps(a, b).astype(float)
    total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None] - common
    return np.nonzero(common >= least * total - 1e-9)


def _forest(c: np.ndarray, p: np.ndarray, q: np.ndarray) -> pd.DataFrame:
    """Edges of a spanning forest of links between places of c."""
    forest = _Forest(len(c))
    forest.link(p, q)
    to = c[forest.label]
    return pd.DataFrame({"u": c, "v": to})[c != to]


def exact_links(members: DataFrame, least: float = SIMILARITY, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """members: group, c, n, own (the sorted set, as bytes), one row for each class. Edges u, v between similar classes of a group, whose components are those of all such links."""
    none = pd.DataFrame({"u": [], "v": []}, dtype="int64")
    salted = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "c"), "c")).getField("c")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / weight)).cast("int")
    groups = members.groupBy("group").agg(blocks.alias("blocks"), F.array_distinct(F.array(*map(salted, range(PIVOTS)))).alias("pivots"))
    large = saved(groups.where("blocks > 1"), "similar-large")  # the others aren't joined: their members stay together in any case
    units = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // weight))
    placed = members.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    everywhere = F.when((F.col("blocks") > 1) & F.array_contains("pivots", F.col("c")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    unit = F.when(F.col("blocks") > 1, F.xxhash64("group", "in")).otherwise(F.pmod(F.xxhash64("group"), F.lit(units)))

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [none]
        for _, part in rows.groupby(["group", "in"], sort=False):
            own, c = [np.frombuffer(x, np.uint64) for x in part["own"]], part["c"].to_numpy()
            found.append(_forest(c, *similar(own, own, least)))
        return pd.concat(found)

    near = saved(placed.withColumn("in", F.explode(everywhere)).select(unit.alias("unit"), "group", "in", "c", "own").groupBy("unit").applyInPandas(first, EDGES), "similar-first")
    large = large.select("group", "blocks")
    if large.isEmpty():
        return near
    roots = components(near).select(F.col("node").alias("c"), "root")
    rooted = saved(members.join(large, "group").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "similar-rooted")
    main = rooted.groupBy("group", "root").agg(F.count("*").alias("size")).groupBy("group").agg(F.max(F.struct("size", "root")).getField("root").alias("main"))
    left = saved(rooted.join(saved(main, "similar-main"), "group").where("root <> main").drop("main"), "similar-left")
    parts = saved(left.groupBy("group").agg(blocks.alias("parts")), "similar-parts")
    a = left.drop("blocks").join(large, "group").join(parts, "group").withColumns({"i": F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(0)})
    b = rooted.join(parts, "group").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "j": F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"), "side": F.lit(1)})
    columns = ["group", "i", "j", "side", "c", "root", "own"]

    def rest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, c, root, side = [np.frombuffer(x, np.uint64) for x in rows["own"]], rows["c"].to_numpy(), rows["root"].to_numpy(), rows["side"].to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return none
        p, q = similar([own[i] for i in x], [own[i] for i in y], least)
        p, q = x[p], y[q]
        new = root[p] != root[q]
        return _forest(c, p[new], q[new])

    return near.unionByName(saved(a.select(columns).unionByName(b.select(columns)).groupBy("group", "i", "j").applyInPandas(rest, EDGES), "similar-rest"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that are the first of their component, each once."""
    names, plain = docs.columns, docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    named = plain.select("*", *row_name(at[id_col], at[text_col]))
    found = saved(sets(plain, at[id_col], at[text_col], k), "similar-sets")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("rep")
    own = saved(found.groupBy("c").agg(rep, F.min("n").alias("n"), F.min("fp").alias("fp")), "similar-classes")
    some = own.where("n > 0").select(F.col("c").alias("node"), "fp")
    group = components(trie_links(some, wide_tables(some.count(), least))).select(F.col("node").alias("c"), F.col("root").alias("group"))
    reps = saved(own.join(group, "c").select("group", "c", "n", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")), "similar-candidates")

    # Only texts whose name is in a bitmap of the candidates' names become sets, and only sets move.
    size = min(MOST, 1 << max(15, (FILTER * reps.count()).bit_length()))
    spot = F.pmod(F.xxhash64(F.lit(SEED), "k1"), F.lit(size))
    bitmap = np.zeros(size // 8, np.uint8)
    for r in reps.select(spot.alias("spot")).groupBy(F.expr("spot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("bits")).collect():  # MOST / 8 bytes at most
        bitmap[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            b = b.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for start in range(0, len(b), 512):
                part = b.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([shingles(t.as_py(), k).tobytes() for t in part.column(3)], pa.binary())], names=["k1", "k2", "own"])

    own_sets = named.select(spot.alias("spot"), "k1", "k2", F.col(at[text_col]).alias("text")).mapInArrow(as_sets, "k1 long, k2 long, own binary")
    members = own_sets.join(reps, ["k1", "k2"]).select("k1", "k2", "group", "c", "n", "own")
    members = saved(members.dropDuplicates(["k1", "k2"]).drop("k1", "k2"), "similar-members")  # repeated rows; dealt as the join is
    roots = components(exact_links(members, least)).select(F.col("node").alias("c"), "root")
    firsts = own.join(roots, "c", "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("rep").alias("rep"))
    kept = firsts.select(F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
    once = Window.partitionBy("k1", "k2").orderBy("k1", "k2")
    rows = named.join(kept, ["k1", "k2"], "left_semi").withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
