"""The codecs as SQL functions: register(spark), then SELECT uncompress_frames(data) and so on.

Scalar functions are Arrow-batched pandas functions. blocks_of() is a table function: the blocks of a file's bytes, one row each.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import blockfile as bf
from .codecs import container, entropy, instructions


def _compressor(mark: int):
    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series, n_atoms: pd.Series, precision: pd.Series, speed: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else container.compress(np.asarray(v, float), int(n), float(p), mark, int(s)) for v, n, p, s in zip(values, n_atoms, precision, speed, strict=True)])

    return run


#: values of whole frames, atoms, precision, speed -> container.
compress_positions, compress_velocities = _compressor(container.POSITIONS), _compressor(container.VELOCITIES)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def uncompress_frames(data: pd.Series) -> pd.Series:
    """All values of a container, frame by frame."""
    return data.map(lambda d: None if d is None else container.uncompress(bytes(d)).ravel())


@F.pandas_udf(T.ArrayType(T.LongType()))
def uncompress_quantised(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else container.uncompress_quantised(bytes(d))[0].ravel())


@F.pandas_udf(T.BinaryType())
def chain_encoded(values: pd.Series) -> pd.Series:
    """Unsigned numbers through the entropy chain."""
    return values.map(lambda v: None if v is None else entropy.chain_encode(np.asarray(v, np.int64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def chain_decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else entropy.chain_decode(bytes(d)))


@F.pandas_udf(T.BinaryType())
def packed_digits(values: pd.Series) -> pd.Series:
    """Triplets of unsigned numbers in shared bases."""
    return values.map(lambda v: None if v is None else instructions.digits_encode(np.asarray(v, np.int64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked_digits(data: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else instructions.digits_decode(bytes(d), int(k)) for d, k in zip(data, n, strict=True)])


class BlocksOf:
    """at, block_id, name, size, hash_ok of the blocks in a file's bytes."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        file = bf.File(io.BytesIO(bytes(content)))
        for h in file.headers():
            yield h.at, h.block_id, h.name, h.size, file.verified(h, file.content(h))


BLOCK = T.StructType([T.StructField(n, t) for n, t in {"at": T.LongType(), "block_id": T.LongType(), "name": T.StringType(), "size": T.LongType(), "hash_ok": T.BooleanType()}.items()])
blocks_of = F.udtf(BlocksOf, returnType=BLOCK)


def register(spark: SparkSession) -> None:
    for name in ("compress_positions", "compress_velocities", "uncompress_frames", "uncompress_quantised", "chain_encoded", "chain_decoded", "packed_digits", "unpacked_digits"):
        spark.udf.register(name, globals()[name])
    spark.udtf.register("blocks_of", blocks_of)
