"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation, in numpy.

A word's class is itself for the most frequent training words, else one of the rare classes by a hash of its ending; the end
of a text is a class too. The model predicts the next class from the two before it: the sum of their vectors, each through
its position's matrix, times the class's own vector, plus a bias. Context words stand in coarser classes. Sizes follow the
training tokens (Sizes): classes as their fifth root, contexts as their eighth, so the table of class triples grows as about
their square root. All triples of all training documents are counted, added up over the cluster in a tree; noise-contrastive
estimation then runs on the counts, in batches of contexts, with expected noise in place of drawn noise, so it covers the
whole corpus and is the same in each run. One matrix product over the classes makes the normalising sums of all pairs of
contexts. Inside a rare class a word has its smoothed share of the class's training tokens; unseen words of a class share
one place. So a text's score is the log-probability of its tokens under one normalised model.

Word counts are exact and never in one place: documents are tokenised once into blocks of about BLOCK tokens, each with
its own vocabulary; counts are summed by word, and go back to the blocks that hold the word. A word moves once for
each block, however often it occurs.

Defined cases. Null and empty texts: the end alone. Null ids: crc32 of the empty text (0), so held out. Repeated rows: each
counts and is scored. A corpus without training documents: N = V = 0, all scores from the untrained model. An empty table:
no rows. Very long texts are a block of their own. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import saved, table

#: Words of classes and contexts are CLASS_FACTOR * N ** CLASS_POWER and CONTEXT_FACTOR * N ** CONTEXT_POWER for N training tokens.
CLASS_FACTOR, CLASS_POWER, CONTEXT_FACTOR, CONTEXT_POWER = 20, 1 / 5, 8, 1 / 8
#: Hashes of endings, of which the rare classes are remainders.
ENDINGS = 1 << 15
#: Size of the vectors, noise samples for each true one, rate of the training, its least steps and passes, cells of a batch.
DIM, NOISE, RATE, SEED, STEPS, PASSES, CELLS = 24, 8, 0.05, 7, 160, 8, 1 << 20
#: Tokens of a block, about.
BLOCK = 1_500_000
FOLDS, HELD_OUT, SMOOTH = 10, 0, 0.1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Triples travel in pieces of so many codes (16 bits); tasks whose pieces are added together at once.
PIECE, FAN = 1 << 16, 64


@dataclass(frozen=True)
class Sizes:
    """Classes: the end, the own most frequent words, and rare ones. The first context_own of them are context classes too."""

    own: int
    rare: int
    contexts: int

    @classmethod
    def of(cls, n: int) -> Sizes:
        """For n training tokens."""
        words = CLASS_FACTOR * max(n, 1) ** CLASS_POWER
        return cls(round(words * 0.75), min(ENDINGS, round(words * 0.25)), round(CONTEXT_FACTOR * max(n, 1) ** CONTEXT_POWER))

    @property
    def classes(self) -> int:
        return 1 + self.own + self.rare

    @property
    def context_own(self) -> int:
        return self.contexts * 5 // 8

    def context(self, classes: np.ndarray) -> np.ndarray:
        """A class as context: the end, the most frequent, and the others folded."""
        return np.where(classes <= self.context_own, classes, self.context_own + 1 + classes % (self.contexts - self.context_own - 1))

    def contexts_of(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tokens of texts that each end with class 0: the context classes two and one before each. Before a text is its predecessor's end."""
        near = self.context(np.concatenate(([0], classes[:-1])))
        far = np.concatenate(([0], near[:-1]))
        far[near == 0] = 0  # nothing of the text before
        return far, near


def _ending(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % ENDINGS


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """Tokenised documents in blocks: ids, held, lengths (without ends), tokens (places in words, packed), words, their
    training counts and endings' hashes."""
    id_type = docs.schema[id_col].dataType
    fields = {"block": T.LongType(), "ids": T.ArrayType(id_type), "held": T.ArrayType(T.BooleanType()), "lengths": T.ArrayType(T.IntegerType()), "tokens": T.BinaryType(), "words": T.ArrayType(T.BinaryType()), "counts": T.ArrayType(T.LongType()), "endings": T.ArrayType(T.ShortType())}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)

        def made(ids: list, held: list, lengths: list, parts: list, vocabulary: dict) -> pa.RecordBatch:
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            training = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(tokens[training], minlength=len(vocabulary))
            words = list(vocabulary)
            columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.ListArray.from_arrays([0, len(held)], pa.concat_arrays(ids)), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack.compress(tokens.tobytes())], pa.binary())]
            columns += [pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([np.fromiter(map(_ending, words), np.int16, len(words))], pa.list_(pa.int16()))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def empty() -> tuple:
            return [], [], [], [], {}

        now, n = empty(), 0
        for b in batches:
            start = 0
            for i, (held, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
                vocabulary = now[4]
                now[3].append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
                now[1].append(held)
                now[2].append(len(words))
                n += len(words)
                if n >= size:
                    now[0].append(b.column(0).slice(start, i + 1 - start))
                    done = made(*now)
                    now, n, start = empty(), 0, i + 1
                    yield done
                    pa.default_memory_pool().release_unused()
            if start < len(b):
                now[0].append(b.column(0).slice(start))
        if now[1]:
            yield made(*now)

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def word_counts(parts: DataFrame) -> DataFrame:
    """word, ending, c: training counts of all words that training documents hold."""
    each = parts.select(F.explode(F.arrays_zip("words", "counts", "endings")).alias("x"))
    return each.where("x.counts > 0").groupBy(F.col("x.words").alias("word"), F.col("x.endings").alias("ending")).agg(F.sum("x.counts").alias("c"))


class Unigrams:
    """N, V, the sizes that follow from N, the most frequent words, and each rare class's tokens and types."""

    def __init__(self, counts: DataFrame, n_ends: int):
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = n + n_ends, v + (n_ends > 0)
        self.sizes = Sizes.of(self.n)
        top = counts.orderBy(F.desc("c"), "word").limit(self.sizes.own).collect()
        self.top = {bytes(r["word"]): 1 + i for i, r in enumerate(top)}
        rare = F.pmod("ending", F.lit(self.sizes.rare)).alias("rare")
        sums = {r["rare"]: (r["n"], r["v"]) for r in counts.groupBy(rare).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
        self.tokens, self.types = (np.array([sums.get(i, (0, 0))[k] for i in range(self.sizes.rare)], float) for k in (0, 1))
        for r in top:  # a class of its own isn't part of its ending's
            self.tokens[r["ending"] % self.sizes.rare] -= r["c"]
            self.types[r["ending"] % self.sizes.rare] -= 1

    def own_classes(self, counts: DataFrame) -> DataFrame:
        """word, own: as many rows as sizes.own at most."""
        rows = [(bytearray(w), i) for w, i in self.top.items()]
        return counts.sparkSession.createDataFrame(rows, "word binary, own short")

    def classes(self, words: list[bytes], endings: np.ndarray) -> np.ndarray:
        found = endings.astype(np.int64) % self.sizes.rare + 1 + self.sizes.own
        own = [(i, self.top[w]) for i, w in enumerate(words) if w in self.top]
        if own:
            at, to = np.array(own).T
            found[at] = to
        return found.astype(np.int32)


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: float | int) -> np.ndarray:
    """values of texts' words, and end after each text."""
    return np.insert(values, np.cumsum(lengths), end)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.int32), row["lengths"].astype(np.int64)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks: tokens as bytes, words as a list, ids as an Arrow array, the others as numpy arrays."""
    as_is = {"ids": lambda x: x, "words": pa.Array.to_pylist}
    for b in batches:
        for i in range(len(b)):
            row = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
            yield {n: x.as_py() if n in ("block", "tokens") else as_is.get(n, lambda x: x.to_numpy(zero_copy_only=False))(x.values) for n, x in row.items() if x.is_valid}


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _packed(low: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(low.astype(np.uint16).tobytes() + counts.astype(np.int64).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n = len(data) // 10
    return np.frombuffer(data, np.uint16, n).astype(np.int64), np.frombuffer(data[2 * n :], np.int64)


def triples(parts: DataFrame, unigrams: Unigrams, n_blocks: int) -> DataFrame:
    """at, counts: pieces of the counts of all training triples. Each task adds up its blocks; tasks' pieces are added in a
    tree, about FAN at once, however many tasks there are."""
    size = unigrams.sizes
    schema = "at long, shard long, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for row in _one_by_one(batches):
            tokens, lengths = _tokens(row)
            classes = _with_ends(unigrams.classes(row["words"], row["endings"])[tokens], lengths, 0)
            training = np.repeat(~row["held"].astype(bool), lengths + 1)
            far, near = size.contexts_of(classes)
            code = (far[training].astype(np.int64) * size.contexts + near[training]) * size.classes + classes[training]
            del tokens, classes, training, far, near
            new, n = np.unique(code, return_counts=True)
            codes, counts = _summed(np.concatenate((codes, new)), np.concatenate((counts, n)))
        at = np.unique(codes // PIECE)
        ends = np.searchsorted(codes, np.append(at, at[-1:] + 1) * PIECE)
        data = [_packed(codes[a:z] % PIECE, counts[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)] if len(at) else []
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(at), pa.int64()), pa.array(data, pa.binary())], names=["at", "shard", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, np.int64)
        for data in rows["counts"]:
            low, n = _unpacked(data)
            total[low] += n
        low = np.flatnonzero(total)
        return rows.head(1).assign(counts=[_packed(low, total[low])])

    pieces = parts.select("held", "lengths", "tokens", "words", "endings").mapInArrow(run, schema)
    shards = n_blocks  # no more tasks than blocks have any
    while True:
        shards = max(1, -(-shards // FAN))
        pieces = pieces.withColumn("shard", F.pmod("shard", F.lit(shards))).groupBy("at", "shard").applyInPandas(add, schema)
        if shards == 1:
            return pieces.select("at", "counts")


def trained(counts: DataFrame, sizes: Sizes) -> LogBilinear:
    """The model trained on what triples() counts, in one task: it holds the distinct triples, as many as about the square root of the corpus."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes, n = [], []
        for at, data in zip(rows["at"], rows["counts"], strict=True):
            low, some = _unpacked(data)
            codes.append(at * PIECE + low)
            n.append(some)
        model = LogBilinear(sizes).train(*_summed(np.concatenate(codes), np.concatenate(n)))
        return pd.DataFrame({"name": list(model.p), "data": [v.tobytes() for v in model.p.values()]})

    model = LogBilinear(sizes)
    for r in counts.groupBy().applyInPandas(run, "name string, data binary").collect():  # parameters, a few for each class
        model.p[r["name"]] = np.frombuffer(bytes(r["data"]), np.float32).reshape(model.p[r["name"]].shape)
    return model


class LogBilinear:
    """Vectors and biases, and what follows from them."""

    def __init__(self, sizes: Sizes) -> None:
        rng = np.random.default_rng(SEED)
        self.sizes = sizes
        self.p = {
            "r": rng.normal(0, 0.3, (sizes.contexts, DIM)), "q": rng.normal(0, 0.3, (sizes.classes, DIM)), "b": np.zeros(sizes.classes),
            "far": np.eye(DIM) * 0.5, "near": np.eye(DIM) * 0.5,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train(self, codes: np.ndarray, counts: np.ndarray, noise: int = NOISE) -> LogBilinear:
        """Noise-contrastive estimation with unigram noise, by Adam on batches of contexts. codes: sorted, (far * contexts + near) * classes + class."""
        total, p, size = counts.sum(), self.p, self.sizes
        if not total:
            return self
        pairs, classes = np.divmod(codes, size.classes)
        unigram = (np.bincount(classes, counts, size.classes) + SMOOTH) / (total + SMOOTH * size.classes)
        p["b"][:] = np.log(unigram)
        log_noise = np.log(noise * unigram).astype(np.float32)
        used, row = np.unique(pairs, return_inverse=True)
        n_batches = -(-len(used) * size.classes // CELLS)
        passes = max(PASSES, -(-STEPS // n_batches))
        starts = np.append(np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))), len(row))
        share = (counts / total * n_batches).astype(np.float32)
        moved = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        rng = np.random.default_rng(SEED)
        steps, step = passes * n_batches, 0
        for _ in range(passes):
            for batch in np.array_split(rng.permutation(len(used)), n_batches):
                step += 1
                true = np.zeros((len(batch), size.classes), np.float32)
                lengths = starts[batch + 1] - starts[batch]
                at = np.repeat(starts[batch] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                true[np.repeat(np.arange(len(batch)), lengths), classes[at]] = share[at]
                far, near = np.divmod(used[batch], size.contexts)
                hidden = (p["r"] @ p["far"])[far] + (p["r"] @ p["near"])[near]
                is_true = 1 / (1 + np.exp(log_noise - (hidden @ p["q"].T + p["b"])))
                fake = true.sum(1, keepdims=True) * (noise * unigram).astype(np.float32)
                slope = (true + fake) * is_true - true  # of the loss by the score
                to_hidden = slope @ p["q"]
                d_far, d_near = np.zeros_like(p["r"]), np.zeros_like(p["r"])
                np.add.at(d_far, far, to_hidden)
                np.add.at(d_near, near, to_hidden)
                grads = {"q": slope.T @ hidden, "b": slope.sum(0), "far": p["r"].T @ d_far, "near": p["r"].T @ d_near, "r": d_far @ p["far"].T + d_near @ p["near"].T}
                rate = RATE * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    m, v = moved[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return self

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log-probability of a class in a context is far[f, class] + near[n, class] - norm[f, n]."""
        p = {k: v.astype(float) for k, v in self.p.items()}
        far, near = p["r"] @ p["far"] @ p["q"].T, p["r"] @ p["near"] @ p["q"].T + p["b"]
        top_far, top_near = far.max(1, keepdims=True), near.max(1, keepdims=True)
        return far, near, np.log(np.exp(far - top_far) @ np.exp(near - top_near).T) + top_far + top_near.T


class Model:
    """All that scoring needs besides the words' counts: a few figures for each class and pair of contexts."""

    def __init__(self, unigrams: Unigrams, n_ends: int, model: LogBilinear):
        self.u, self.n_ends = unigrams, n_ends
        self.far, self.near, self.norm = ((x / np.log(10)).astype(np.float32) for x in model.parts())

    def score(self, row: dict) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of a block's texts. row has training counts (c) and own classes (or 0) of its words."""
        u, size = self.u, self.u.sizes
        tokens, lengths = _tokens(row)
        c, rare = row.get("c", np.zeros(0)).astype(float), row["endings"].astype(np.int64) % size.rare
        own = row.get("own", np.zeros(0)).astype(np.int32)
        classes = np.where(own > 0, own, (rare + 1 + size.own).astype(np.int32))
        share = np.where(classes <= size.own, 0.0, np.log10((c + SMOOTH) / (u.tokens + SMOOTH * (u.types + 1))[rare]))
        below = np.log10(u.n + SMOOTH * (u.v + 1))
        of_text = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(of_text, x[tokens], len(lengths))
        base = add(np.log10(c + SMOOTH)) + np.log10(self.n_ends + SMOOTH) - (lengths + 1) * below
        seen = _with_ends(classes[tokens], lengths, 0)
        far, near = size.contexts_of(seen)
        each = self.far[far, seen] + self.near[near, seen] - self.norm[far, near]
        score = np.bincount(np.repeat(np.arange(len(lengths)), lengths + 1), each, len(lengths)) + add(share)
        return [lengths + 1, add(c > 0).astype(np.int64) + (self.n_ends > 0), base, score]


def fitted(parts: DataFrame, counts: DataFrame) -> Model:
    """The model of blocks() and their word_counts()."""
    n_ends, n_blocks = parts.select(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)), F.count("*")).first()
    unigrams = Unigrams(counts, n_ends)
    return Model(unigrams, n_ends, trained(triples(parts, unigrams, n_blocks), unigrams.sizes))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    parts = saved(blocks(docs, id_col, text_col), "lm-blocks", "zstd")
    counts = saved(word_counts(parts), "lm-words", "zstd")
    model = fitted(parts, counts)
    known = parts.select("block", F.posexplode("words").alias("place", "word"))
    known = known.join(counts.select("word", "c"), "word", "left").join(F.broadcast(model.u.own_classes(counts)), "word", "left")
    known = known.select("block", "place", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("own", F.lit(0).cast("short")).alias("own"))
    known = known.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "c", "own"))).alias("k")).select("block", F.col("k.c").alias("c"), F.col("k.own").alias("own"))  # a block's words: bounded
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            n_tokens, n_known, base, score = model.score(row)
            figures = [pa.array(x) for x in (n_tokens, n_known, np.full(len(n_tokens), model.u.n), base, score)]
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(row["held"].astype(bool)), *figures], names=schema.names)

    return parts.select("block", "ids", "held", "lengths", "tokens", "endings").join(known, "block", "left").mapInArrow(run, schema)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
