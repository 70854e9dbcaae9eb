"""Quality rules: a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Features are hashed word n-grams (single words, pairs and triples) and, for pairs, the shapes of both words with whether they
are equal (a shape is the word with runs of lower-case letters, capitals, digits and other signs folded). Each kind falls into
a fixed number of buckets. Counts over all documents make the raw multinomial, those over trusted documents (labelled quality 1) the target.
A document's score is the mean of log(target / raw) over its features, so that length plays no part.

All labelled rows are halved by a hash of the id: the trusted documents are those of one half, and the threshold is where a
histogram of the other half's scores best tells quality 1 from 0 (greatest sum of both rates of right decisions, the middle of
such edges), so it isn't fitted on rows that the ratio was. Without labels of both kinds there all pass it. The corpus counts
cover all documents. Documents also fail by the base rules: fewer than 50 words, or over half of the words in repeated
three-word windows.

Labels are saved and broadcast up to BROADCAST bytes. Beyond that texts move once, in a join with the trusted ids, and all
documents are scored for the threshold, so that only ids and scores meet the other half; nothing is left out either way.

Defined cases. Null and empty texts: no words, so they fail. Null ids: not labelled. Ids labelled twice: the lower quality
holds. Repeated rows: each is judged alike. Extra columns are kept by keep(), whatever their names. An empty table: no rows.
Very long texts: all their features count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

#: Buckets of words, of pairs of shapes, and of pairs and triples of words.
WORDS, SHAPES, GRAMS = 1 << 15, 1 << 14, 1 << 15
SIZE = WORDS + SHAPES + 2 * GRAMS
#: Bytes of the labels (about: their ids, and ROW for each) up to which they are broadcast.
BROADCAST, ROW = 16 << 20, 32
#: Histogram of scores: from -LIMIT to LIMIT in steps of 1 / STEPS.
LIMIT, STEPS = 8, 100
CACHE, CACHE_BYTES = 400_000, 64
MIN_WORDS, MAX_REPEATED = 50, 50
#: Features that are counted at once, about.
TOGETHER, EMPTY = 1 << 20, np.zeros(0, np.int64)
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Of bytes: a letter (or part of one beyond ASCII), a capital, a digit, or the sign itself.
SHAPE = bytes(ord("a") if chr(b).islower() or b >= 128 else ord("A") if chr(b).isupper() else ord("9") if chr(b).isdigit() else b for b in range(256))
REPEATS = re.compile(rb"(.)\1+", re.S)


class _Codes(dict):
    """Word (bytes) -> 56 bits of its hash and 8 of its shape's."""

    def __missing__(self, word: bytes) -> int:
        shape = REPEATS.sub(rb"\1", word.translate(SHAPE))
        code = xxhash.xxh64_intdigest(word) & ~0xFF | xxhash.xxh32_intdigest(shape) & 0xFF
        if len(self) < CACHE and len(word) <= CACHE_BYTES:  # a full one keeps what came first: mostly the frequent words
            self[word] = code
        return code


_codes = _Codes()


def codes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def features(code: np.ndarray) -> np.ndarray:
    """Buckets of a document's features."""
    word = ((code >> np.uint64(8)) & np.uint64(WORDS - 1)).astype(np.int64)
    shape = (code & np.uint64(0xFF)).astype(np.int64)
    pair = ((shape[:-1] * 251 + shape[1:]) * 2 + (code[:-1] == code[1:])) % SHAPES
    two = code[:-1] * K1 + code[1:]
    three = two[:-1] * K2 + code[2:]
    two, three = (((x ^ x >> np.uint64(29)) * K1 >> np.uint64(49)).astype(np.int64) for x in (two, three))  # 15 bits: GRAMS
    return np.concatenate((word, WORDS + pair, WORDS + SHAPES + two, WORDS + SHAPES + GRAMS + three))


def repeated_words(code: np.ndarray) -> int:
    """Words in three-word windows that occur at least twice."""
    if len(code) < 4:
        return 0
    window = (code[:-2] * K1 + code[1:-1]) * K2 + code[2:]
    order = np.argsort(window)
    same = np.concatenate(([False], window[order][1:] == window[order][:-1], [False]))
    twice = np.zeros(len(code) + 2, bool)
    twice[order[same[1:] | same[:-1]]] = True
    return int((twice[: len(code)] | np.roll(twice, 1)[: len(code)] | np.roll(twice, 2)[: len(code)]).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def labelled(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """_id, _quality of all labelled rows, one for each id; _fits: which half is the target's."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(quality_col).cast("int").alias("_quality"))
    return one.withColumn("_fits", F.xxhash64(F.lit(1), "_id").bitwiseAND(F.lit(1)) == 0)


def _counts(rows: DataFrame) -> np.ndarray:
    """Features by bucket, of all rows and of those with _quality 1; rows: _text, _quality."""
    size = SIZE

    def add(raw: np.ndarray, target: np.ndarray, held: list, trusted: list) -> None:
        own = np.bincount(np.concatenate([EMPTY, *trusted]), minlength=size)
        target += own
        raw += own + np.bincount(np.concatenate([EMPTY, *held]), minlength=size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            held, trusted, n = [], [], 0
            for text, quality in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = features(codes(text.as_py()))
                (trusted if quality == 1 else held).append(found)
                n += len(found)
                if n >= TOGETHER:
                    add(raw, target, held, trusted)
                    held, trusted, n = [], [], 0
            add(raw, target, held, trusted)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counts = np.zeros((2, size))  # at most one row for each bucket, however large the corpus
    for r in rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        counts[:, r[0]] = r[1], r[2]
    return counts


class Model:
    """log(target / raw) by bucket, and the threshold."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        size = SIZE
        chosen = saved(labelled(labels), "quality-labels")
        texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        trusted, rest = chosen.where("_fits and _quality = 1").select("_id"), chosen.where("not _fits").select("_id", (F.col("_quality") == 1).alias("quality"))
        if (chosen.select(F.sum(F.octet_length(F.col("_id").cast("string")) + ROW)).first()[0] or 0) <= BROADCAST:
            told = texts.join(F.broadcast(trusted.withColumn("_quality", F.lit(1))), "_id", "left")
            counts, tested = _counts(told.select("_text", "_quality")), texts.join(F.broadcast(rest.select("_id")), "_id")
        else:
            counts, tested = _counts(texts.select("_text", F.lit(None).cast("int").alias("_quality"))), texts
            counts[1] = _counts(texts.join(trusted, "_id").select("_text", F.lit(1).alias("_quality")))[1]
        # One pseudo-count of the raw distribution for each bucket: rare features tell little.
        p_raw = (counts[0] + 1) / (counts[0].sum() + size)
        p_target = (counts[1] + size * p_raw) / (counts[1].sum() + size)
        self.ratio = np.log(p_target) - np.log(p_raw) if counts[1].sum() else np.zeros(size)
        self.threshold = -np.inf
        ratio = self.ratio

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = [int(np.clip(np.floor(score(codes(t.as_py()), ratio) * STEPS), -LIMIT * STEPS, LIMIT * STEPS)) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64())], names=["_id", "bin"])

        scored = tested.mapInArrow(bins, f"_id {texts.schema['_id'].dataType.simpleString()}, bin long")
        rows = scored.join(rest, "_id").groupBy("bin", "quality").count().collect()
        hist = np.zeros((2, 2 * LIMIT * STEPS + 1))
        for r in rows:
            hist[int(r["quality"]), r["bin"] + LIMIT * STEPS] += r["count"]
        if hist.sum(1).all():
            below = np.concatenate(([[0.0], [0.0]], hist.cumsum(1)), axis=1)[:, :-1] / hist.sum(1, keepdims=True)
            gain = np.round(below[0] - below[1], 12)
            best = np.flatnonzero(gain == gain.max())
            self.threshold = float((best[0] + best[-1]) // 2 - LIMIT * STEPS) / STEPS


def score(code: np.ndarray, ratio: np.ndarray) -> float:
    return float(ratio[features(code)].mean()) if len(code) else 0.0


def judge(text: str | None, ratio: np.ndarray, threshold: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    text, code = text or "", codes(text)
    n, repeated, s = len(code), repeated_words(code), score(code, ratio)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, not failed and s >= threshold, s


REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, the base rules' figures, the score and the verdict."""
    model = Model(docs, labels, id_col, text_col)
    ratio, threshold = model.ratio, model.threshold
    names = [f.split()[0] for f in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py(), ratio, threshold) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(ARROW))], names=[id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {REPORT}")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass."""
    model = Model(docs, labels, id_col, text_col)
    ratio, threshold, at = model.ratio, model.threshold, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), ratio, threshold)[6] for t in pc.cast(b.column(at), pa.string())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
