"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and an end id. Longer ones are cut from their end into whole sequences, so the first piece
may be shorter. A bin is filled greedily with the largest piece that fits; then its smallest piece is replaced by the two
unpacked pieces that fit the gap, widened by it, more tightly.

Pieces are dealt by a hash of their key into groups of about GROUP rows, which pack independently: at thousands of pieces
a group, what is lost at a group's end is some hundredths of a percent, and no task grows with the input.

Token ids equal those of the `tokenizers` library with the same file: an added token's string in a text is that token's id,
and what stands between such strings is encoded on its own. Ids are made word by word from a bounded cache: between two
non-space characters a single space always begins a new pre-token, so a text may be cut there.

Defined cases. Null text: empty, so the end id alone. Null ids and repeated rows: each row is a document of its own.
Ties: by a hash of id, piece and ids. An empty table: no rows. Very long texts: encoded whole, one text at a time, and cut.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import saved, table

LENGTH = 1024
END_ID = 2
#: Pieces that pack together, about.
GROUP = 4096
#: Entries of the word cache of a Python worker, and the longest text it keeps.
CACHE, CACHE_CHARS = 400_000, 48
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """Word -> the ids of a space and the word, as bytes."""

    def __init__(self, own):
        super().__init__()
        self.own, self.stop = own, {c: array("I", own.encode_ordinary(c)).tobytes() for c in ".,"}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # letters alone are one pre-token
            ids = array("I", self.own._encode_single_piece(" " + word)).tobytes()
        elif (stop := self.stop.get(word[-1])) and word[:-1].isalpha():  # the stop is another
            ids = self[word[:-1]] + stop
        else:
            ids = array("I", self.own.encode_ordinary(" " + word)).tobytes()
        if len(self) < CACHE and len(word) <= CACHE_CHARS:  # a full one keeps what came first: mostly the frequent words
            self[word] = ids
        return ids


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable letter; this is the way back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> its ids as bytes of unsigned 32-bit numbers."""
    import public_tokenizers
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))
    added = {x["content"]: array("I", [x["id"]]).tobytes() for x in model.get("added_tokens", ())}
    odd = [x["content"] for x in model.get("added_tokens", ()) if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized")]
    if odd or model.get("normalizer"):
        raise ValueError(f"{path}: added tokens with flags, and normalizers, aren't supported: {odd}")
    back = _byte_of_letter()
    ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = _Words(own)

    def plain(text: str) -> bytes:
        first, *rest = BETWEEN_WORDS.split(text)
        return array("I", own.encode_ordinary(first)).tobytes() + b"".join(map(words.__getitem__, rest))

    if not added:
        return plain
    between = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))

    def ids(text: str) -> bytes:
        out, at = [], 0
        for m in between.finditer(text):
            out += (plain(text[at : m.start()]), added[m[0]])
            at = m.end()
        return b"".join((*out, plain(text[at:]))) if out else plain(text)

    return ids


def _cut(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the pieces of n ids."""
    start, end = 0, n % length or length
    while start < n:
        yield start, min(end, n)
        start, end = end, end + length


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and ids if wanted."""
    path = tokenizer or default_tokenizer()
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                blob = encode(text.as_py() or "") + end
                for k, (a, b) in enumerate(_cut(len(blob) // 4, length)):
                    part = blob[4 * a : 4 * b]
                    for to, x in zip(rows, (i, k, a, b - a, zlib.crc32(part), part), strict=True):
                        to.append(x)
            out = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows[5], pa.binary())] * with_ids, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length. Equal lengths are taken in their order."""
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[i]), []).append(i)
    there = sum(1 << n for n in waiting)  # bit n: a piece of length n waits

    def largest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        own = waiting[n]
        i = own.pop()
        if not own:
            there ^= 1 << n
        return i

    def give(n: int, i: int) -> None:
        nonlocal there
        waiting[n].append(i)
        there |= 1 << n

    k = 0
    while there:
        n = there.bit_length() - 1
        own, gap = [(n, take(n))], size - n
        while (n := largest(gap)) > 0:
            own.append((n, take(n)))
            gap -= n
        if gap:
            least = own[-1][0]
            room, best, pair = gap + least, least, None
            a = largest(room - 1)
            while a > 0 and best < room and 2 * a > best:
                b = largest(min(a, room - a))
                if b == a and len(waiting[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = largest(a - 1)
            if pair:
                give(*own.pop())
                own += [(n, take(n)) for n in pair]
        at = 0
        for n, i in own:
            bins[i], offsets[i] = k, at
            at += n
        k += 1
    return bins, offsets


def pack(parts: DataFrame, id_col: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """parts, as pieces() makes them, with sequence_id and offset."""
    parts = saved(parts, "pack-pieces")
    groups = max(1, -(-parts.count() // group))
    tie = F.xxhash64(id_col, "piece", "start", "ids_crc32")
    out = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_tie"], ascending=[False, True], kind="stable")
        bins, offsets = best_two_fit(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[out.names]

    return parts.withColumn("_tie", tie).withColumn("_group", F.pmod("_tie", F.lit(groups))).groupBy("_group").applyInPandas(run, out)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
